"""Token ids as flat binary files.

``write_token_files`` writes, per shard of documents in ascending ``doc_id`` order, a flat file of
unsigned ids, a file of document ids, and a file of 64-bit offsets that count from the first id of
the whole corpus: shard bases are prefix sums of the shards' totals. ``read_token_files`` maps the
files into memory and returns one row per document.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.llm import store, words

#: Words with other characters than these, or with a special token's opening, go to the library whole.
_ODD = r"[^\n\x21-\x7e¡-¬®-ɏ]|<\|"
_MARK = b"\0"
_CACHED_PIECES = 400_000
_SLICE_BYTES = 24 << 20


def _byte_alphabet() -> list[str]:
    """Byte-level BPE's letters for bytes: printable bytes stand for themselves, others follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    """Ids of a piece as bytes, computed where it is missing; bounded, emptied when full."""

    def __init__(self, enc: Encoder):
        super().__init__()
        self.model, self.dtype, self.letters = enc.model, enc.dtype, _byte_alphabet()
        self["\n"] = _MARK

    def __missing__(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        found = np.array([t.id for t in self.model.tokenize(text)], self.dtype).tobytes()
        if len(self) >= _CACHED_PIECES:
            self.clear()
            self["\n"] = _MARK
        self[piece] = found
        return found


class Encoder:
    """``tokenizers`` ids of whole columns of text.

    A tokenizer that drops white space and ends words with a suffix encodes each word by itself, so
    every distinct word of a batch is encoded once and ids are gathered by word number. Pieces that
    were met before come from a bounded cache. Other tokenizers encode whole texts.
    """

    def __init__(self, spec: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        rules = json.loads(spec)
        self.dtype = "<u2" if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
        pattern = steps[0].get("pattern", {}).get("Regex") if steps else None
        forms = (rules.get("normalizer") or {}).get("normalizers") or []
        self.by_word = bool(
            [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert")
            and [f.get("type") for f in forms] == ["NFC", "Replace", "Lowercase"]
            and rules["model"].get("end_of_word_suffix")
        )
        if self.by_word:
            self.pieces = regex.compile(pattern + "|\n")
            self.odd = regex.compile(_ODD)
            self.seen = _Pieces(self)

    def _words(self, spelt: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and each word's place and number of ids in them.

        All words are cut into pieces at once; a line feed between words, which no piece holds, stands
        for one marking byte."""
        joined = "\n".join(spelt)
        found = list(map(self.seen.__getitem__, self.pieces.findall(joined.lower())))
        found.append(_MARK)
        raw = np.frombuffer(b"".join(found), np.uint8)
        size = np.fromiter(map(len, found), np.int64, len(found))
        to = np.cumsum(size)
        marks = to[size == 1] - 1
        keep = np.ones(len(raw), bool)
        keep[marks] = False
        width = np.dtype(self.dtype).itemsize
        ids = raw[keep].view(self.dtype)
        ends = (marks - np.arange(len(marks))) // width
        sizes = np.diff(ends, prepend=0)
        place = ends - sizes
        starts = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)) + 1)
        odd = sorted({int(np.searchsorted(starts, m.start(), "right")) for m in self.odd.finditer(joined)})
        if odd:
            whole = [np.array(self.whole.encode(spelt[k], add_special_tokens=False).ids, self.dtype) for k in odd]
            sizes[odd] = [len(w) for w in whole]
            place[odd] = len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
            ids = np.concatenate([ids, *whole])
        return ids, place, sizes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by ``end_id``; and where each text starts."""
        if not self.by_word:
            found = self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)
            parts = [np.array([*f.ids, end_id], self.dtype) for f in found]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            return np.concatenate([*parts, np.empty(0, self.dtype)]), starts
        spelt, codes, ends = words.coded(texts)
        ids, place, sizes = self._words(spelt)
        ids = np.append(ids, np.array([end_id], self.dtype))
        place, sizes = np.append(place[: len(spelt)], len(ids) - 1), np.append(sizes[: len(spelt)], 1)
        codes = np.insert(codes, ends, len(spelt))
        counts = sizes[codes]
        to = np.cumsum(counts)
        source = np.repeat(place[codes] - (to - counts), counts)
        source += np.arange(len(source))
        closing = ends + np.arange(len(ends))
        return ids[source], np.concatenate([[0], to[closing]]).astype(np.int64)

    def encode_batches(
        self, batches: Iterator[pa.RecordBatch], end_id: int
    ) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(doc_id, ids, starts) of bounded runs of rows; a text that is longer makes a run of its own."""
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(size.astype(np.int64))
            at = 0
            while at < len(size):
                done = total[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(total, done + _SLICE_BYTES, "right")))
                texts = pc.fill_null(batch["text"].slice(at, to - at), "").cast(pa.large_string())
                ids, starts = self.encode(pa.concat_arrays([texts]), end_id)
                yield batch["doc_id"].slice(at, to - at), ids, starts
                at = to


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder of this tokenizer; its cache outlives the task."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def in_order(docs: DataFrame, shards: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) in ascending order over range partitions; nulls first, equal ids by text.

    The row number as last key lets a run of equal rows spread over several partitions.
    """
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("hash", F.xxhash64("text"))
    keys = ["doc_id", "hash", "row"]
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write_token_files(
    docs: DataFrame,
    out: str,
    spec: str,
    end_id: int,
    shards: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> list[dict]:
    """Encode every whole text and write the files under the address ``out``; returns the manifest.

    A null or empty text holds the end id alone. Null ids come first and are counted per shard. Rows
    with equal ids stay, ordered by text. An empty table gives an empty manifest. Each shard is
    written under a draft name and moved, so an attempt that dies leaves nothing that is read. The
    driver sees one row per shard: counts, from which it forms the bases.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, tag = task.partitionId(), f"try{task.taskAttemptId()}"
        enc, names, lengths = encoder(shared.value), [], []

        def chunks() -> Iterator[bytes]:
            for keys, ids, starts in enc.encode_batches(batches, end_id):
                names.append(keys)
                lengths.append(np.diff(starts))
                yield ids.tobytes()

        name = f"{out}/part-{shard:06d}"
        store.write_file(f"{name}.ids", chunks(), tag)
        n = np.concatenate([*lengths, np.empty(0, np.int64)])
        nulls = sum(k.null_count for k in names)
        keys = [pc.fill_null(k, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for k in names]
        store.write_file(f"{name}.docs", keys, tag)
        store.write_file(f"{name}.lengths", [n.astype("<u8").tobytes()], tag)
        row = {"shard": [shard], "n_docs": [len(n)], "n_null": [nulls], "n_tokens": [int(n.sum())], "dtype": [enc.dtype]}
        yield pa.RecordBatch.from_pydict(row)

    fields = "shard long, n_docs long, n_null long, n_tokens long, dtype string"
    written = in_order(docs, shards, doc_id, text).mapInArrow(write, fields).collect()
    manifest, base = [], 0
    for row in sorted((r.asDict() for r in written if r["n_docs"]), key=lambda r: r["shard"]):
        manifest.append(row | {"base": base, "name": f"part-{row['shard']:06d}"})
        base += row["n_tokens"]
    _write_offsets(spark, out, manifest)
    store.write_file(f"{out}/manifest.json", [json.dumps({"end_id": end_id, "shards": manifest}).encode()], "draft")
    return manifest


_MANIFEST = "shard long, n_docs long, n_null long, n_tokens long, dtype string, base long, name string"


def _per_shard(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    rows = spark.createDataFrame([tuple(m[f.split()[0]] for f in _MANIFEST.split(", ")) for m in manifest], _MANIFEST)
    return rows.repartition(max(1, len(manifest)))


def _write_offsets(spark: SparkSession, out: str, manifest: list[dict]) -> None:
    """The shards' 64-bit offsets, counted from the corpus' first id; one more than documents."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                n = store.read_array(f"{out}/{m['name']}.lengths", "<u8")
                at = np.concatenate([[0], np.cumsum(n)]).astype("<u8") + np.uint64(m["base"])
                store.write_file(f"{out}/{m['name']}.offsets", [at.tobytes()], f"try{TaskContext.get().taskAttemptId()}")
            yield batch.select(["shard"])

    if manifest:
        _per_shard(spark, manifest).mapInArrow(write, "shard long").count()


def read_token_files(spark: SparkSession, out: str, manifest: list[dict]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, and ids_crc32 over 32-bit ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                ids = store.read_array(f"{out}/{m['name']}.ids", m["dtype"])
                at = store.read_array(f"{out}/{m['name']}.offsets", "<u8").astype(np.int64)
                keys = store.read_array(f"{out}/{m['name']}.docs", "<i8")
                local = at - m["base"]
                for a in range(0, len(keys), 20_000):
                    b = min(len(keys), a + 20_000)
                    crc = [zlib.crc32(ids[local[i] : local[i + 1]].astype("<u4")) for i in range(a, b)]
                    null = np.arange(a, b) < m["n_null"]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(keys[a:b], pa.int64(), mask=null),
                            "start": pa.array(at[a:b]),
                            "n_tokens": pa.array(np.diff(at[a : b + 1])),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    return _per_shard(spark, manifest).mapInArrow(read, schema)
