"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-case words. Shared runs of ``TILE`` words are
found with a running Karp-Rabin hash. Only the ends of a match are listed (shared runs whose words before
or after differ), never its inner hits, so equal words cost one entry a diagonal. The longest match whose
words are still free on both sides becomes a tile, again and again, until none of TILE words is left. An item's coverage is the share of its words under tiles, in whatever order they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm import store, words

TILE = 4
COVERAGE = 0.5
#: Characters of benchmark text that one pass over the documents holds.
BLOCK_CHARS = 8 << 20
_BASE = np.uint64(0x100000001B3)
_WORD = re.compile(r"\w+")
_SIEVE_BITS = 22
#: Ends of matches listed at a time, or those of one document where it has more.
LISTED = 1 << 20


def word_hashes(word: str) -> list[int]:
    return [xxhash.xxh64_intdigest(w) for w in _WORD.findall(word.lower())]


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` values."""
    n = max(0, len(values) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _BASE + values[k : k + n]
    return out


def _apart(found: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Which matches share no word with a tile, on either side."""
    n, size = found[:, 2], tile[2]
    doc = (found[:, 0] >= tile[0] + size) | (found[:, 0] + n <= tile[0])
    item = (found[:, 1] >= tile[1] + size) | (found[:, 1] + n <= tile[1])
    return doc & item


def _cut(found: np.ndarray, tile: np.ndarray, length: int) -> np.ndarray:
    """The stretches of at least ``length`` words that a tile leaves of matches, on both sides."""
    keep = _apart(found, tile)
    p, q, n = found[~keep].T
    begin = np.sort([np.clip(tile[0] - p, 0, n), np.clip(tile[1] - q, 0, n)], axis=0)
    end = np.sort([np.clip(tile[0] + tile[2] - p, 0, n), np.clip(tile[1] + tile[2] - q, 0, n)], axis=0)
    parts = [found[keep]]
    for a, b in ((np.zeros_like(n), begin[0]), (end[0], begin[1]), (end[1], n)):
        left = b - a >= length
        parts.append(np.stack([(p + a)[left], (q + a)[left], (b - a)[left]], axis=1))
    return np.concatenate(parts)


def tile(found: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Tiles (doc position, item position, words), longest first; among equals the first in the
    document, then in the item. ``found`` are the longest matches of at least ``length`` words, alike."""
    out = []
    while len(found):
        best = found[found[:, 2] == found[:, 2].max()]
        best = best[np.lexsort((best[:, 1], best[:, 0]))]
        while len(best):
            first = best[0]
            out.append(tuple(first.tolist()))
            best = best[_apart(best, first)]
            found = _cut(found, first, length)
    return out


class Items:
    """A block of benchmark items with the sorted hashes of their runs, and by the word next to a run."""

    def __init__(self, rows: list[tuple[str, str]], length: int):
        self.ids = [r[0] for r in rows]
        self.words = [np.array([h for w in (r[1] or "").split() for h in word_hashes(w)], np.uint64) for r in rows]
        self.length = length
        seeds = [runs(w, length) for w in self.words]
        none = np.empty(0, np.uint64)
        flat = np.concatenate([*seeds, none])
        item = np.repeat(np.arange(len(rows)), [len(s) for s in seeds])
        place = np.concatenate([*(np.arange(len(s)) for s in seeds), np.empty(0, np.int64)]).astype(np.int64)
        self.known, group, self.count = np.unique(flat, return_inverse=True, return_counts=True)
        self.first = np.cumsum(self.count) - self.count
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.known >> np.uint64(64 - _SIEVE_BITS)] = True
        # the word before and after each run by its number; an item's edge has the last number, which no document has
        self.spelt = np.unique(np.concatenate([*self.words, none]))
        numbered = [np.searchsorted(self.spelt, w) for w in self.words]
        edge, some = [len(self.spelt)], [k for k, s in enumerate(seeds) if len(s)]
        before = np.concatenate([*(np.concatenate([edge, numbered[k][: len(seeds[k]) - 1]]) for k in some), []]).astype(np.int64)
        after = np.concatenate([*(np.concatenate([numbered[k][length:], edge]) for k in some), []]).astype(np.int64)
        self.sides = []
        for word in (before, after):
            code = group.astype(np.int64) * (len(self.spelt) + 1) + word
            order = np.argsort(code, kind="stable")
            self.sides.append((code[order], item[order], place[order]))

    def _beside(self, values: np.ndarray, group: np.ndarray, at: np.ndarray, edge: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """By run, the range of postings with the same word beside it; empty at the end of a document."""
        word = values[np.where(edge, 0, at)]
        number = np.minimum(np.searchsorted(self.spelt, word), len(self.spelt) - 1)
        code = np.where(~edge & (self.spelt[number] == word), group * (len(self.spelt) + 1) + number, -1)
        low, high = (np.searchsorted(self.sides[side][0], code, way) for way in ("left", "right"))
        begin = self.first[group]
        return np.where(high > low, low, begin), np.where(high > low, high, begin)

    def matches(self, values: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, position in ``values``, item position, words) of all longest matches between the
        items and the documents that ``values`` holds one after another; some documents at a time."""
        h = runs(values, self.length)
        at = np.flatnonzero(self.sieve[h >> np.uint64(64 - _SIEVE_BITS)])
        if not len(self.known) or not len(at):
            return
        group = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        doc = np.searchsorted(ends, at, "right")
        real = (self.known[group] == h[at]) & (at + self.length <= ends[doc])
        at, group, doc = at[real], group[real], doc[real]
        if not len(at):
            return
        starts = at == np.concatenate([[0], ends[:-1]])[doc]
        same = [
            self._beside(values, group, at - 1, starts, 0),
            self._beside(values, group, np.minimum(at + self.length, len(values) - 1), at + self.length == ends[doc], 1),
        ]
        listed = self.count[group] - (same[0][1] - same[0][0])
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        total = np.add.reduceat(listed, new)
        # documents whose matches are listed together: a new part where a budget is passed
        part = np.flatnonzero(np.diff((np.cumsum(total) - total) // LISTED, prepend=-1))
        cuts = np.append(new[part], len(at))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            both = []
            for side, (low, high) in enumerate(same):
                lo, hi, first = low[a:b], high[a:b], self.first[group[a:b]]
                begin = np.stack([first, hi], axis=1).ravel()
                size = np.stack([lo - first, first + self.count[group[a:b]] - hi], axis=1).ravel()
                posting = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                where = np.repeat(np.arange(a, b), size.reshape(-1, 2).sum(axis=1))
                item, place = self.sides[side][1][posting], self.sides[side][2][posting]
                order = np.lexsort((at[where], at[where] - place, item, doc[where]))
                both.append((doc[where][order], item[order], at[where][order], place[order]))
            begun, ended = both  # on a diagonal the k-th match begins at the k-th start and ends at the k-th end
            yield *begun, ended[2] - begun[2] + self.length


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    length: int = TILE,
    block_chars: int = BLOCK_CHARS,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item whose coverage reaches the threshold: doc_id, item_id, coverage,
    n_words, n_tiles, longest_tile, and the tiles as (start word, words) in the document.

    Null and empty texts match nothing, nor do items of fewer words than a tile. Repeated rows and
    equal ids give a row each. Among matches of one length the first in the document goes first, then the
    first in the item. Long texts are compared whole; memory grows with the longest matches of one
    document, not with its hits. The benchmark's distinct texts are gone through in blocks of about
    ``block_chars`` (more where one item alone is longer), each shared with all tasks; every block meets
    all documents, so any benchmark is compared whole.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where("item_text IS NOT NULL")
    items = items.withColumn("text_key", F.md5("item_text"))
    texts = items.groupBy("text_key").agg(F.first("item_text").alias("item_text"))
    total = texts.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = int(total // block_chars) + 1
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("text_key"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        part = [tuple(r) for r in texts.where(F.col("block") == block).select("text_key", "item_text").collect()]
        shared = spark.sparkContext.broadcast(part)  # a block, of bounded size
        matched = rows.mapInArrow(_matcher(shared, coverage, length), _FIELDS)
        found = matched if found is None else found.union(matched)
    columns = ["doc_id", "item_id", "coverage", "n_words", "n_tiles", "longest_tile", "tiles"]
    return found.join(items.select("text_key", "item_id"), "text_key").select(*columns)


def without(docs: DataFrame, benchmark: DataFrame, **choices) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text covers no benchmark item.

    A null or empty text stays, ties and repeated rows are judged alike, an empty table gives no rows, and
    long texts are compared whole. Equal texts are judged alike, so rows are told apart by a hash of id and text, and a task that runs
    again decides alike."""
    doc_id, text = choices.pop("doc_id", "doc_id"), choices.get("text", "text")
    name = "row"
    while name in docs.columns:
        name += "_"
    placed = docs.withColumn(name, F.xxhash64(doc_id, text))
    found = contaminated(placed, benchmark, doc_id=name, **choices).select(F.col("doc_id").alias(name)).distinct()
    return placed.join(store.kept(found, "contaminated"), name, "left_anti").select(*docs.columns)


_FIELDS = "doc_id long, text_key string, coverage double, n_words long, n_tiles long, longest_tile long, tiles array<struct<start:long,words:long>>"


def _matcher(shared, coverage: float, length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, length)
        for batch in words.slices(batches):
            spelt, codes, ends = words.coded(batch["text"])
            hashed = [word_hashes(w) for w in spelt]
            size = np.fromiter(map(len, hashed), np.int64, len(hashed))
            table = np.fromiter((h for hs in hashed for h in hs), np.uint64, int(size.sum()))
            source, ends = words.expand(codes, size, ends)
            values = table[source]
            begin = np.concatenate([[0], ends[:-1]])
            out: dict[str, list] = {f.split()[0]: [] for f in _FIELDS.split(", ")}
            for doc, item, at, place, run in items.matches(values, ends):
                new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
                bounds = np.append(new, len(at))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    d, k = int(doc[a]), int(item[a])
                    found = np.stack([at[a:b] - begin[d], place[a:b], run[a:b]], axis=1)
                    # fewer item words are in matches than the threshold asks for: no tiling can reach it
                    n = len(items.words[k])
                    under = np.bincount(place[a:b], minlength=n + 1) - np.bincount(place[a:b] + run[a:b], minlength=n + 1)
                    if (np.cumsum(under)[:n] > 0).sum() < coverage * n:
                        continue
                    tiles = tile(found, length)
                    share = sum(t[2] for t in tiles) / n
                    if share >= coverage:
                        row = (batch["doc_id"][d].as_py(), items.ids[k], share, n, len(tiles), max(t[2] for t in tiles))
                        for name, value in zip(out, row, strict=False):
                            out[name].append(value)
                        out["tiles"].append([{"start": t[0], "words": t[2]} for t in sorted(tiles)])
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            kinds.append(pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return scan
