"""Order-preserving packing of documents into sequences of bounded length.

Documents stay in ascending ``doc_id`` order. Dynamic programming chooses where sequences end: at
document ends for nothing, at sentence ends for ``sentence_cost``, elsewhere for ``token_cost``, plus
one unit per padding token. A sequence is padded to ``length`` unless its size is a power of two.
The best predecessor of a cut lies within the last ``length`` tokens, and its cost splits into a part
of the predecessor and a part of the cut, so a monotone queue gives it in amortised constant time.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm import store
from probewise.llm.tokens import encoder, in_order

SENTENCE_COST = 16.0
TOKEN_COST = 48.0
#: A run of documents that is solved at once; its last ``length`` tokens may be cut anywhere.
SEGMENT_TOKENS = 1 << 20
#: Without a sentence end for this long, every such step may be a cut.
STRIDE = 256


def choose_cuts(at: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Of candidate positions ``at`` (ascending, from 0 to the end, gaps at most ``length``) the
    chosen ones, 0 and the end included, at the least sum of costs and padding. Among equal totals
    the earliest start of a sequence wins, and a whole power of two only if it is strictly better."""
    m = len(at)
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    exact: dict[int, list[int]] = {}
    number = np.full(int(at[-1]) + 1, -1)
    number[at] = np.arange(m)
    for p in powers:
        later = int(np.searchsorted(at, p))
        where = number[at[later:] - p]
        hit = np.flatnonzero(where >= 0)
        for j, i in zip((hit + later).tolist(), where[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
    places, costs = at.tolist(), cost.tolist()
    best, came = [0.0] * m, [0] * m
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, m):
        end = places[j]
        while places[queue[0][1]] < end - length:
            queue.popleft()
        key, i = queue[0]
        total = key + length - end
        for k in exact.get(j, ()):
            if best[k] < total:
                total, i = best[k], k
        total += costs[j]
        best[j], came[j] = total, i
        key = total + end
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    chosen = [m - 1]
    while chosen[-1]:
        chosen.append(came[chosen[-1]])
    return [places[j] for j in reversed(chosen)]


def candidates(
    ids: np.ndarray, starts: np.ndarray, ends_sentence: np.ndarray, length: int, costs: tuple[float, float]
) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a segment with their costs."""
    total = len(ids)
    cost = np.full(total + 1, np.inf)
    cost[max(0, total - length) :] = costs[1]
    cost[np.flatnonzero(ends_sentence[ids]) + 1] = costs[0]
    cost[starts] = 0.0
    known = np.flatnonzero(cost < np.inf)
    stride = min(STRIDE, length)
    wide = np.flatnonzero(np.diff(known) > stride)
    for a, b in zip(known[wide].tolist(), known[wide + 1].tolist(), strict=True):
        cost[np.arange(a + stride, b, stride)] = costs[1]
    at = np.flatnonzero(cost < np.inf)
    return at, cost[at]


def sentence_ends(spec: str) -> np.ndarray:
    """Which ids close a sentence: their text without the word-end mark ends in . ! or ?"""
    model = json.loads(spec)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    found = np.zeros(max(model["vocab"].values()) + 4096, bool)
    for word, i in model["vocab"].items():
        found[i] = word.removesuffix(suffix).endswith((".", "!", "?"))
    return found


def pack(
    docs: DataFrame,
    spec: str,
    end_id: int,
    length: int = 4096,
    sentence_cost: float = SENTENCE_COST,
    token_cost: float = TOKEN_COST,
    shards: int | None = None,
    keep_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``keep_ids`` the piece's ids as little-endian 32-bit integers.

    Every id lies in one piece; a sequence's pieces fill it from 0 without gaps. A null or empty text
    is the end id alone. Null ids come first; rows with equal ids stay apart, ordered by text. An
    empty table gives no rows. A range partition is packed by itself, in runs of about a million
    tokens, so memory is bounded by such a run or by the longest document; the end of a run is split
    at powers of two rather than padded where that costs less. The pieces are written once; sequence
    numbers then get the sums of the earlier partitions' totals, one row per partition.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    costs = (float(sentence_cost), float(token_cost))

    def run(keys: list, parts: list[np.ndarray], part: int, first: int, closes: np.ndarray) -> tuple[dict, int]:
        ids = np.concatenate(parts)
        lengths = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(lengths) - lengths
        at, cost = candidates(ids, np.append(starts, len(ids)), closes, length, costs)
        cuts = np.array(choose_cuts(at, cost, length), np.int64)
        begin = np.union1d(cuts[:-1], starts)
        end = np.append(begin[1:], len(ids))
        doc = np.searchsorted(starts, begin, "right") - 1
        sequence = np.searchsorted(cuts, begin, "right") - 1
        raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        row = {
            "doc_id": pa.array([keys[d] for d in doc.tolist()], pa.int64()),
            "start": begin - starts[doc],
            "length": end - begin,
            "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
            "doc_tokens": lengths[doc],
            "sequence_id": sequence + first,
            "offset": begin - cuts[sequence],
            "part": np.full(len(begin), part, np.int64),
        }
        if keep_ids:
            row["ids"] = pa.array(raw, pa.binary())
        return row, first + len(cuts) - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, closes = TaskContext.get().partitionId(), encoder(shared.value), sentence_ends(shared.value)
        keys, parts, size, first = [], [], 0, 0
        for names, ids, starts in enc.encode_batches(batches, end_id):
            for k, key in enumerate(names.to_pylist()):
                keys.append(key)
                parts.append(ids[starts[k] : starts[k + 1]])
                size += len(parts[-1])
                if size >= SEGMENT_TOKENS:
                    row, first = run(keys, parts, part, first, closes)
                    yield pa.RecordBatch.from_pydict(row)
                    keys, parts, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_pydict(run(keys, parts, part, first, closes)[0])

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long"
    fields += ", ids binary" * keep_ids
    placed = store.kept(in_order(docs, shards, doc_id, text).mapInArrow(place, fields), "packed")
    totals = placed.groupBy("part").agg((F.max("sequence_id") + 1).alias("n")).orderBy("part").collect()
    bases, base = [], 0
    for row in totals:
        bases.append((row["part"], base))
        base += row["n"]
    known = F.broadcast(spark.createDataFrame(bases, "part long, base long"))  # one row per partition
    out = placed.join(known, "part").withColumn("sequence_id", F.col("sequence_id") + F.col("base"))
    return out.drop("part", "base")
