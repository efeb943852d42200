"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint's bit is set where more than half of the text's shingle hashes have it. Fingerprints
that differ in at most ``radius`` bits agree in at least ``keep`` of ``radius + keep`` bit blocks, so
pairs are sought only among fingerprints that agree in some choice of ``keep`` blocks. There, bit
planes are stored vertically: one operation on a machine word updates the distances of one
fingerprint to 64 others, carry-save counters add the differing bits, and a block of words is left as
soon as all its counters have passed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm import store

SHINGLE_WORDS = 4
RADIUS = 4
#: Fingerprints of one key that a task compares with each other; larger groups go in pairs of chunks.
CHUNK = 2048
#: Expected fingerprints of one key if bits were even; decides how many blocks a key takes.
KEY_LOAD = 64
_WORDS_AT_ONCE = 1 << 15


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """A-Z lower-cased, words between ASCII white space, shingles joined by spaces, XXH64 of seed 42."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    count = np.zeros(64, np.int64)
    for a in range(0, n, _WORDS_AT_ONCE):
        spans = zip(starts[a : a + _WORDS_AT_ONCE].tolist(), ends[a : a + _WORDS_AT_ONCE].tolist(), strict=True)
        h = np.array([digest(joined[i:j], 42) for i, j in spans], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame, words: int = SHINGLE_WORDS, doc_id: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """(doc_id, row, fp): the 64-bit fingerprint of every whole text as a signed long; null texts as
    empty. ``row`` is null unless the name of a column of longs is given."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", words) for t in batch["text"]]
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], values], ["doc_id", "row", "fp"])

    number = F.col(row) if row else F.lit(None).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), number.alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, row long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """planes[b] holds bit b of all values, 64 values a word; the last word is filled with zeros."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_earlier(
    values: np.ndarray, begin: np.ndarray, radius: int = RADIUS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), begin[i] <= j < i, with at most ``radius`` differing bits.

    Each value meets the words that hold the earlier values of its group; lanes outside count as
    passed. Counters start short of a power of two by radius + 1, so passing the radius is a carry
    out of the top counter plane. After every eighth bit, words whose lanes have all passed are left.
    """
    planes = bit_planes(values)
    at = np.arange(len(values))
    first, words = begin // 64, at // 64 - begin // 64 + 1
    total, full, one = np.cumsum(words), ~np.uint64(0), np.uint64(1)
    width = radius.bit_length()
    short = (1 << width) - (radius + 1)
    a = 0
    while a < len(values):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _WORDS_AT_ONCE, "right")))
        row = np.repeat(at[a:b], words[a:b])
        step = np.arange(len(row)) - np.repeat(total[a:b] - words[a:b] - (total[a - 1] if a else 0), words[a:b])
        word = first[row] + step
        low, high = np.maximum(begin[row] - word * 64, 0), np.minimum(row - word * 64, 64)
        inside = np.where(high >= 64, full, (one << np.minimum(high, 63).astype(np.uint64)) - one)
        over = ~(inside & (full << low.astype(np.uint64)))
        count = [np.full(len(row), full if short >> k & 1 else 0, np.uint64) for k in range(width)]
        for bit in range(64):
            carry = planes[bit][word] ^ (np.uint64(0) - ((values[row] >> np.uint64(bit)) & one))
            for k in range(width):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if bit % 8 == 7:
                stay = np.flatnonzero(over != full)
                row, word, over, count = row[stay], word[stay], over[stay], [c[stay] for c in count]
                if not len(stay):
                    break
        lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        item, lane = np.nonzero(lanes)
        yield row[item], word[item] * 64 + lane
        a = b


def component_starts(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each of n items' component: hook roots to smaller ones, then flatten."""
    root = np.arange(n)
    for left, right in pairs:
        while True:
            a, b = root[left], root[right]
            other = a != b
            if not other.any():
                break
            left, right = left[other], right[other]
            np.minimum.at(root, np.maximum(a, b)[other], np.minimum(a, b)[other])
            while not np.array_equal(flat := root[root], root):
                root = flat
    return root


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` whose components are those of all pairs in the radius.

    ``n``, the number of fingerprints, only decides how many blocks form a key. A key's fingerprints
    are dealt to chunks; each two chunks meet in one task, which returns each one's link to the first
    of its component there, so links stay below rows and no link between components is lost.
    """
    keep = 1
    while keep < 8 and n >> (keep * 64 // (radius + keep)) > KEY_LOAD:
        keep += 1
    blocks = radius + keep
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    whole = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    masks = [sum(whole[k] for k in choice) for choice in combinations(range(blocks), keep)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "bits")
    )
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # kept, so that the join has a plain shuffle on either side and a hot key can be split
    keyed = keyed.join(store.kept(sizes, "sizes"), ["choice", "bits"])
    chunks = F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")
    own = F.pmod(F.xxhash64("fp", "choice"), chunks).cast("int")
    # a chunk meets every chunk, itself with the first: task (i, j) for i <= j
    meet = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")),
    )
    dealt = (
        keyed.withColumn("chunks", chunks)
        .withColumn("own", own)
        .withColumn("meets", F.explode(meet))
        .select("choice", "bits", F.col("meets.i").alias("i"), F.col("meets.j").alias("j"), "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            root = component_starts(len(keys), near_earlier(values, begin, radius))
            other = np.flatnonzero(root != np.arange(len(keys)))
            ends = [pa.array(values[k].view(np.int64)) for k in (other, root[other])]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

        held_k, held_v = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k = np.concatenate([held_k, batch["task"].to_numpy()])
            v = np.concatenate([held_v, batch["fp"].to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if cut:
                yield from emit(k[:cut], v[:cut])
            held_k, held_v = k[cut:], v[cut:]
        if len(held_k):
            yield from emit(held_k, held_v)

    # tasks are told apart by a hash; two that share it by chance are compared together, which is harmless
    tasks = dealt.select(F.xxhash64("choice", "bits", "i", "j").alias("task"), "fp")
    tasks = tasks.repartition("task").sortWithinPartitions("task", "fp")
    return tasks.mapInArrow(compare, "a long, b long").distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint of an edge table (a, b), one root per connected component.

    Each round, every node points to its neighbour of least hash, if that is below its own; edges are
    rewritten to the nodes pointed at. Every second round has another seed, so no order of nodes is
    slow, and a star is gone after two. Rounds are written to the shared folder, so none depends on executors that are lost.
    """
    nodes = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).distinct()
    label = store.kept(nodes.select("fp", F.col("fp").alias("root")), "roots")
    step = 0
    while True:
        rank = lambda c: F.struct(F.xxhash64(F.lit(step // 2), c).alias("h"), c.alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("low"))
        to = F.when(F.col("low") < rank(F.col("a")), F.col("low.v")).otherwise(F.col("a"))
        move = store.kept(low.select("a", to.alias("to")), "moves")
        label = label.join(move.withColumnRenamed("a", "root"), "root", "left")
        label = store.kept(label.select("fp", F.coalesce("to", "root").alias("root")), "roots")
        edges = edges.join(move, "a").select(F.col("to").alias("a"), "b")
        edges = edges.join(move.select(F.col("a").alias("b"), F.col("to").alias("c")), "b").select("a", F.col("c").alias("b"))
        edges = store.kept(edges.where("a != b").distinct(), "edges")
        step += 1
        if edges.isEmpty():
            return label


def _classes(scanned: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, n_same): every distinct fingerprint's component, by the smallest id it has."""
    distinct = store.kept(
        scanned.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same")), "distinct"
    )
    found = store.kept(links(distinct.select("fp"), distinct.count(), radius), "links")
    roots = component_roots(found)
    least = distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(least, "root").select("fp", "component_id", "root")
    classes = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id"), "n_same", F.coalesce("root", "fp").alias("root")
    )
    return store.kept(classes, "classes")


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) of every row.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest id that links reach, ``n_same``
    the rows with the same fingerprint. Texts of fewer words than a shingle are one shingle; a text
    without words, or null, has fingerprint zero and links like any other. Equal texts always share a
    component. Rows with equal or null ids stay; a null id is never a component id unless all of the
    component's are null. An empty table gives no rows.
    """
    scanned = store.kept(fingerprints(docs, words, doc_id, text), "fingerprints")
    out = scanned.join(_classes(scanned, radius), "fp")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select("doc_id", shown, "component_id", "n_same")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, less near duplicates: of each component the row with
    the smallest id stays, a null id only where there is no other; of different texts with that id the one
    with the least hash, of rows that repeat both id and text any one.

    Rows are told apart by id and text alone, so a task that runs again decides alike.
    """
    own, hashed = "own_id", "text_hash"
    while own in docs.columns or hashed in docs.columns:
        own, hashed = own + "_", hashed + "_"
    placed = docs.withColumn(hashed, F.xxhash64(F.col(text)))
    scanned = store.kept(fingerprints(placed, words, doc_id, text, hashed), "fingerprints")
    classes = _classes(scanned, radius).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    stay = scanned.join(classes, "fp").groupBy("root").agg(first)
    stay = store.kept(stay.select(F.col("first.doc_id").alias(own), F.col("first.row").alias(f"{hashed}_stay")), "stay")
    same = (F.col(hashed) == F.col(f"{hashed}_stay")) & F.col(doc_id).cast("long").eqNullSafe(F.col(own))
    kept = placed.join(stay, same, "left_semi")
    if not scanned.groupBy("doc_id", "row").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id, hashed])
    return kept.select(*docs.columns)
