"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points has a rolling hash; of every ``WINDOW`` successive hashes the least
is selected, the rightmost one among equals. Two texts that share a passage of WINDOW + GRAM - 1 code
points share a selected hash, and its kept positions tell where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 24
WINDOW = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POSITION_BITS = 24
_BLOCK = 1 << 18


def rolling(codes: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of every run of ``gram`` values, from hashes of runs half as long; 40 bits."""
    power, length, have = _BASE, 1, (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    out, out_length = None, 0
    while True:
        if gram & length:
            if out is None:
                out, out_length = have, length
            else:
                scale = np.uint64(pow(int(_BASE), length, 1 << 64))
                n = len(codes) - out_length - length + 1
                out = out[:n] * scale + have[out_length : out_length + n]
                out_length += length
        if length * 2 > gram:
            break
        n = len(codes) - 2 * length + 1
        have = have[:n] * power + have[length : length + n]
        power = np.uint64(pow(int(_BASE), length * 2, 1 << 64))
        length *= 2
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return (out ^ (out >> np.uint64(32))) >> np.uint64(24)


def select(texts: list[np.ndarray], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) selected from each text of code points.

    A text shorter than a gram is one gram; one with fewer grams than a window is one window; an empty
    text selects nothing. Long texts go in blocks that overlap by a window, so memory stays bounded.
    """
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        flat = np.concatenate([h[2] for h in held])
        index = np.arange(len(flat), dtype=np.uint64)
        low = np.uint64((1 << _POSITION_BITS) - 1)
        keys = rolling(flat, gram)
        keys = (keys << np.uint64(_POSITION_BITS)) | (low - index[: len(keys)])
        least, width = keys, 1
        while width < window:
            step = min(width, window - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        begin = 0
        for doc, offset, codes in held:
            part = least[begin : begin + len(codes) - gram - window + 2]
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            at = (low - (part & low)).astype(np.int64) - begin + offset
            found[doc].append((part >> np.uint64(_POSITION_BITS), at))
            begin += len(codes)
        held, size = [], 0

    for doc, codes in enumerate(texts):
        n = len(codes)
        grams = n - gram + 1
        if n == 0:
            continue
        if grams < window:
            h = rolling(codes, min(n, gram))
            at = len(h) - 1 - int(np.argmin(h[::-1]))
            found[doc].append((h[at : at + 1], np.array([at])))
            continue
        for a in range(0, grams - window + 1, _BLOCK):
            b = min(grams - window + 1, a + _BLOCK)
            held.append((doc, a, codes[a : b + window + gram - 2]))
            size += len(held[-1][2])
            if size >= _BLOCK:
                flush()
    flush()
    out = []
    for parts in found:
        hashes = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
        at = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
        new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, bool)
        out.append((hashes[new], at[new]))
    return out


def written(hashes: np.ndarray, at: np.ndarray) -> str:
    """Twelve hex digits a selected gram: ten of its hash, two of the distance from the one before."""
    raw = np.empty((len(hashes), 6), np.uint8)
    raw[:, :5] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    raw[:, 5] = np.diff(at, prepend=0)
    return raw.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct hashes (both ascending and distinct); 1 for two empty sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    return shared / union if union else 1.0


def with_next(docs: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, extra, doc_id, text) in descending ``doc_id`` order within a bucket; nulls last, equal
    ids by the text's hash. Each bucket ends with an extra copy of the row that follows it, the first
    of the next bucket in use, and the last bucket with the very first row.

    Only bucket edges and each bucket's first key come to the driver: a few values per bucket.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    edges = rows.agg(F.percentile_approx("doc_id", shares, 10 * buckets + 1000).alias("edges")).first()["edges"] or [0]
    splits = [-float("inf"), *sorted({float(e) for e in edges}), float("inf")]
    rows = rows.withColumn("place", F.col("doc_id").cast("double")).withColumn("hash", F.xxhash64("text"))
    rows = Bucketizer(splits=splits, inputCol="place", outputCol="bin", handleInvalid="keep").transform(rows)
    # the bin of nulls is the last; in descending order it stays last
    n = len(splits) - 1
    rows = rows.withColumn("bucket", F.when(F.col("bin") < n, n - 1 - F.col("bin")).otherwise(n).cast("int")).drop("place", "bin")
    key = F.struct("doc_id", F.bitwise_not("hash").alias("hash"))
    first = sorted(rows.groupBy("bucket").agg(F.max(key).alias("k")).collect(), key=lambda r: r["bucket"])
    known = [(r["bucket"], r["k"]["doc_id"], ~r["k"]["hash"], first[i - 1]["bucket"]) for i, r in enumerate(first)]
    firsts = docs.sparkSession.createDataFrame(known, "bucket int, first_id long, first_hash long, before int")
    rows = rows.join(F.broadcast(firsts), "bucket")  # one row per bucket
    own = F.struct("bucket", F.lit(False).alias("extra"))
    ahead = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    rows = rows.select("doc_id", "text", "hash", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    dealt = rows.select("to.bucket", "to.extra", "doc_id", "text", "hash").repartition("bucket")
    order = ["bucket", "extra", F.col("doc_id").desc_nulls_last(), "hash"]
    return dealt.sortWithinPartitions(*order).drop("hash")


def fingerprints(
    docs: DataFrame,
    gram: int = GRAM,
    window: int = WINDOW,
    buckets: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_selected.

    The edited text has its last third (rounded down) replaced by as many code points from the start
    of the next row's text, or all of it. Null and empty texts have an empty fingerprint; two empty
    fingerprints are alike. Rows with equal ids are ordered by text; a single row follows itself; an
    empty table gives no rows.
    """
    n = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if window > 255:
        raise ValueError("a written distance has two hex digits")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list) -> pa.RecordBatch:
            """All rows but the last, each with the one after it."""
            codes = [np.frombuffer(t.encode("utf-32-le"), "<u4") for _, _, _, t in rows]
            use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            changed = []
            for i in use:
                cut = len(codes[i]) // 3
                changed.append(np.concatenate([codes[i][: len(codes[i]) - cut], codes[i + 1][:cut]]))
            picked = select([*codes, *changed], gram, window)
            sets = [np.unique(h) for h, _ in picked]
            other = range(len(rows), len(picked))
            sha = [hashlib.sha256(c.tobytes().decode("utf-32-le").encode()).hexdigest() for c in changed]
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([rows[i][2] for i in use], pa.int64()),
                    "n_chars": pa.array([len(codes[i]) for i in use], pa.int64()),
                    "edited_sha256": pa.array(sha, pa.string()),
                    "fingerprint": pa.array([written(*picked[i]) for i in use], pa.string()),
                    "edited_fingerprint": pa.array([written(*picked[j]) for j in other], pa.string()),
                    "near_edited": pa.array([likeness(sets[i], sets[j]) for i, j in zip(use, other, strict=True)], pa.float64()),
                    "near_next": pa.array([likeness(sets[i], sets[i + 1]) for i in use], pa.float64()),
                    "n_selected": pa.array([len(picked[i][0]) for i in use], pa.int64()),
                }
            )

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c] for c in ("bucket", "extra", "doc_id", "text")), strict=True):
                held.append(tuple(v.as_py() for v in row))
                size += len(held[-1][3])
                if size > 4 << 20 and len(held) > 1:
                    yield emit(held)
                    held = held[-1:]
                    size = len(held[0][3])
        if len(held) > 1:
            yield emit(held)

    fields = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, n_selected long"
    )
    return with_next(docs, n, doc_id, text).mapInArrow(scan, fields)
