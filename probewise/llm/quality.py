"""Quality by a byte-level convolutional network, in numpy.

Filters over eight bytes slide in steps of two over overlapping chunks that cover the whole text. Each
filter keeps its maximum per chunk; a document is the mean, maximum and minimum of its chunks' maxima
and its length, and a small dense layer makes one probability of these. Text of few distinct words
excites few filters, markup and shouting excite their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm import training, words

WIDTH = 8
FILTERS = 24
HIDDEN = 16
#: Positions (of two bytes) a chunk holds, and from one chunk's start to the next.
CHUNK = 256
STEP = 224
STEPS = 1000
BATCH = 32
#: Bytes of a short passage by class: poor text must be long enough to show what is poor.
PASSAGE = ((150, 600), (16, 600))
#: Bounds of the training sample: rows a class, and code points of a row.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 6000


def padded(text: bytes) -> np.ndarray:
    """Bytes with an even count and zeros behind, so that every pair of bytes starts a window."""
    out = np.zeros((max(1, len(text)) + 1) // 2 * 2 + WIDTH - 2, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def chunk_bounds(positions: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of overlapping chunks that cover all positions."""
    starts = np.arange(0, max(1, positions - (CHUNK - STEP)), STEP)
    return starts, np.minimum(starts + CHUNK, positions)


class Network:
    """Weights and what is computed with them. ``filters`` has one row a byte of each window place."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {
            "filters": rng.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "dense": rng.normal(0, 0.15, (3 * FILTERS + 1, HIDDEN)).astype(np.float32),
            "dense_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def pair_tables(self) -> np.ndarray:
        """filters of two neighbouring bytes added up, by the pair read as one 16-bit number."""
        f = self.w["filters"]
        return np.stack([(f[k + 1][:, None, :] + f[k][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)])

    @staticmethod
    def summary(pooled: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Per document from its chunks' maxima: mean, maximum, minimum, and the length's logarithm."""
        n = np.diff(np.append(begin, len(pooled)))[:, None]
        parts = [np.add.reduceat(pooled, begin) / n, np.maximum.reduceat(pooled, begin), np.minimum.reduceat(pooled, begin)]
        return np.concatenate([*parts, (np.log1p(length) / 5)[:, None]], axis=1).astype(np.float32)

    def probability(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum(features @ self.w["dense"] + self.w["dense_bias"], 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w["out"] + self.w["out_bias"], -30, 30)))

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on the mean log loss; a batch has as many documents of either class where both exist.

        Three in ten are cut to a short passage, so that few words alone don't count as poor text."""
        rng = np.random.default_rng(seed)

        def passage(i: int) -> bytes:
            if rng.random() > 0.3:
                return texts[i]
            size = int(np.exp(rng.uniform(*np.log(PASSAGE[labels[i]]))))
            begin = int(rng.integers(0, max(1, len(texts[i]) - size + 1)))
            return texts[i][begin : begin + size]

        groups = [g for g in (np.flatnonzero(np.array(labels) == v) for v in (0, 1)) if len(g)]
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, BATCH // len(groups)) for g in groups])
            taken = [passage(i) for i in pick]
            grads = self._gradients([padded(t) for t in taken], [len(t) for t in taken], np.array([labels[i] for i in pick]))
            pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)

    def _gradients(self, docs: list[np.ndarray], lengths: list[int], labels: np.ndarray) -> dict[str, np.ndarray]:
        w, pooled, windows, begin = self.w, [], [], []
        for d in docs:
            places = (len(d) - WIDTH) // 2 + 1
            view = np.lib.stride_tricks.sliding_window_view(d, WIDTH)[::2][:places]
            act = w["bias"] + sum(w["filters"][k][view[:, k]] for k in range(WIDTH))
            begin.append(len(pooled))
            for a, b in zip(*chunk_bounds(places), strict=True):
                at = act[a:b].argmax(axis=0)
                pooled.append(act[a:b][at, np.arange(FILTERS)])
                windows.append(view[a + at])
        pooled, begin = np.array(pooled), np.array(begin)
        x = self.summary(pooled, begin, np.array(lengths))
        pre = x @ w["dense"] + w["dense_bias"]
        hidden = np.maximum(pre, 0)
        error = ((1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"])))) - labels) / len(docs)
        to_hidden = np.outer(error, w["out"]) * (pre > 0)
        to_x = to_hidden @ w["dense"].T
        n = np.diff(np.append(begin, len(pooled)))
        doc = np.repeat(np.arange(len(docs)), n)
        mean, most, least = (x[:, k * FILTERS : (k + 1) * FILTERS] for k in range(3))
        to_pool = to_x[doc, :FILTERS] / n[doc][:, None]
        to_pool = to_pool + to_x[doc, FILTERS : 2 * FILTERS] * (pooled == most[doc]) + to_x[doc, 2 * FILTERS : 3 * FILTERS] * (pooled == least[doc])
        grad = np.zeros_like(w["filters"])
        window = np.array(windows)  # chunk, filter, byte
        for k in range(WIDTH):
            np.add.at(grad[k], (window[:, :, k], np.arange(FILTERS)[None, :]), to_pool)
        return {
            "filters": grad,
            "bias": to_pool.sum(0),
            "dense": x.T @ to_hidden + 2e-4 * w["dense"],
            "dense_bias": to_hidden.sum(0),
            "out": hidden.T @ error,
            "out_bias": error.sum(keepdims=True),
        }

    def score(self, texts: pa.Array, tables: np.ndarray) -> np.ndarray:
        """Probabilities of whole texts; long texts go piece by piece, chunk maxima are kept."""
        raw = texts.cast(pa.large_binary())
        sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        pooled, begin, held, spans, size = [], [], [], [], 0

        def flush() -> None:
            nonlocal held, spans, size
            if not spans:
                return
            pairs = np.concatenate(held).view("<u2")
            act = tables[0][pairs[: len(pairs) - WIDTH // 2 + 1]]
            for k in range(1, WIDTH // 2):
                act += tables[k][pairs[k : len(pairs) - WIDTH // 2 + 1 + k]]
            edges = np.array(spans, np.int64).ravel()
            pooled.append(np.maximum.reduceat(act, edges[:-1])[::2] + self.w["bias"])
            held, spans, size = [], [], 0

        done = 0
        for value in raw:
            d = padded(value.as_py())
            starts, ends = chunk_bounds((len(d) - WIDTH) // 2 + 1)
            begin.append(done)
            done += len(starts)
            for a in range(0, len(starts), 512):
                lo, hi = int(starts[a]), int(ends[min(a + 512, len(starts)) - 1])
                part = d[2 * lo : 2 * hi + WIDTH - 2]
                here = size // 2
                spans += [(here + s - lo, here + e - lo) for s, e in zip(starts[a : a + 512].tolist(), ends[a : a + 512].tolist(), strict=True)]
                held.append(part)
                size += len(part)
                if size > 1 << 17:
                    flush()
        flush()
        if not begin:
            return np.empty(0)
        return self.probability(self.summary(np.concatenate(pooled), np.array(begin), sizes)).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network:
    """Fit on a bounded sample of documents with label 0 or 1 that are not held out.

    With one class only, or none, the network is left as it starts but for what that class teaches.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~training.held_out(F.col("doc_id")))
    picked = F.broadcast(training.sampled(known, "label", rows, ["doc_id"]))  # a bounded sample of ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = training.texts(texts.join(picked, "doc_id"), "label", rows, chars)
    net = Network()
    if found:
        net.fit([t.encode() for t, _ in found], [v for _, v in found])
    return net


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts are scored as empty ones.

    Equal texts have equal scores. Rows with equal or null ids stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.pair_tables()
        for batch in words.slices(batches):
            found = pa.array(shared.value.score(batch["text"], tables))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], found], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(scan, "doc_id long, score double")
    return found.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least one half, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.pair_tables()
        for batch in batches:
            for part in words.slices([pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(len(batch)))], ["text", "row"])]):
                good = shared.value.score(part["text"], tables) >= 0.5
                yield batch.take(part["row"].filter(pa.array(good)))

    return docs.mapInArrow(scan, docs.schema)
