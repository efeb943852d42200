"""Importance resampling towards a target: hashed n-gram counts, bucket gains and a seeded draw.

Separators collapse to single spaces, and one overlapped regular-expression scan for each n yields all
n-gram spans, bounded by lookarounds; their CRC-32 modulo ``BUCKETS`` numbers the feature. The scan's
buckets are kept as two bytes a feature in the shared folder, so that counting them over the whole
corpus and weighing them per document read no text again.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm import store, words
from probewise.llm.ordering import placed

BUCKETS, LONGEST, LEAST_WORDS, DRAWN_PERCENT, SEED = 10_000, 3, 20, 5, 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEPARATORS = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class Scanner:
    """Feature buckets of a text; a word is a run of ASCII letters, digits and anything beyond ASCII.

    A match of n words holds the runs of 1 to n words from the same start as nested groups, so a scan by
    overlapped matches gives all of them for every start but the last n - 1, which scans for fewer words take.
    """

    def __init__(self, buckets: int, longest: int):
        import regex

        self.buckets, self.scans = buckets, []
        for n in range(1, longest + 1):
            nested = rb"(" * n + rb"[^ ]+)" + rb" [^ ]+)" * (n - 1)
            self.scans.append((n, regex.compile(rb"(?<= )" + nested + rb"(?= )"), methodcaller("group", 0, *range(2, n + 1))))

    def __call__(self, text: bytes) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of every run of 1 to ``longest`` words."""
        spaced = _SEPARATORS.sub(b" ", text.translate(_LOWER)).strip(b" ")
        if not spaced:
            return 0, np.empty(0, "<u4")
        rest, found = b" " + spaced + b" ", []
        words = rest.count(b" ") - 1
        for n, scan, runs in reversed(self.scans):
            spans = scan.finditer(rest, overlapped=True)
            runs_of = map(runs, spans) if n == 1 else chain.from_iterable(map(runs, spans))
            found.append(np.fromiter(map(zlib.crc32, runs_of), np.uint32))
            if words >= n:
                at = len(rest) - 1
                for _ in range(n - 1):
                    at = rest.rfind(b" ", 0, at)
                rest = rest[at:]
        return words, (np.concatenate(found) % self.buckets).astype("<u4")


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(texts: DataFrame, text: str, keep: list[str], buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``keep`` with ``n_words``, ``n_features`` and ``found``, the buckets of all features as bytes."""
    kind = _width(buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(buckets, longest)
        for batch in words.slices(batches, "text"):
            rows = [scanner(t.as_buffer().to_pybytes()) for t in batch["text"].cast(pa.large_binary())]
            made = {n: batch[n] for n in keep} | {
                "n_words": pa.array([n for n, _ in rows], pa.int64()),
                "n_features": pa.array([len(b) for _, b in rows], pa.int64()),
                "found": pa.array([b.astype(kind).tobytes() for _, b in rows], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(made)

    rows = texts.select(*keep, F.col(text).alias("text"))
    fields = [f"`{n}` {t}" for n, t in rows.select(*keep).dtypes]
    return rows.mapInArrow(scan, ", ".join([*fields, "n_words long, n_features long, found binary"]))


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall in each bucket, over all rows; the driver gets a row for each bucket."""
    kind = _width(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch["found"]:
                n += np.bincount(np.frombuffer(row.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    per_task = scanned.select("found").mapInArrow(count, "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the floored thousandfold log of its smoothed
    frequency in the target over that in the corpus."""
    k = float(len(corpus))
    s_all, t_all = float(corpus.sum()) + k, float(target.sum()) + k
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    each = [math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in pairs]
    return np.array(each, np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths from the first 32 bits of a seeded SHA-256 of the id; a null id reads as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(scanned: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """The rows of ``features`` with ``weight`` and ``score`` in place of ``found``."""
    shared = scanned.sparkSession.sparkContext.broadcast(gain)
    kind = _width(len(gain))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            weight = np.array([gain[np.frombuffer(r.as_buffer(), kind)].sum() for r in batch["found"]], np.int64)
            extra = np.array([noise(seed, i) for i in batch["doc_id"].to_pylist()], np.int64)
            made = {n: batch[n] for n in ("doc_id", "n_words", "n_features")}
            yield pa.RecordBatch.from_pydict(made | {"weight": pa.array(weight), "score": pa.array(weight + extra)})

    kept = scanned.select("doc_id", "n_words", "n_features", "found")
    return kept.mapInArrow(add, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = DRAWN_PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Of the N rows with ``least_words`` or more words, the floor(percent * N / 100) highest scores are drawn
    and numbered from 1 in ``rank``, ties by smaller id, then by fewer features; other ranks are null.
    A null or empty text has no feature and weight 0; null ids come last in a tie, and repeated rows are
    scored and drawn each by itself. Texts of any length are read whole. An empty table gives no rows;
    with an empty target a gain only says how rare a bucket is. Other columns of either table are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = store.kept(features(rows, "text", ["doc_id"], buckets, longest), "features")
    aim = features(target.select(F.col(target_text).alias("text")), "text", [], buckets, longest)
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(aim, buckets))
    scored = store.kept(weigh(scanned, gain, seed), "scored")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.col("able").cast("int") * -1, -F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features")]
    ranked = placed(scored.withColumn("able", able), order, [])
    rank = F.when(F.col("able") & (F.col("at") < drawn), F.col("at") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
