"""Language of documents and of spans in mixed-language text.

A word's script narrows the languages it can be of: those that were seen in that script. Its score for
each is the sum of log probabilities of its letter trigrams. Viterbi over a text's words, with a
penalty for every switch, labels each word; the document's language has the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm import training, words

#: First code points of script blocks, by the Unicode code charts.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "southeast"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0x10000, "other"), (0x20000, "han"), (0x30000, "han"),
]
SWITCH = 12.0
SMOOTH = 0.3
SEEN_SHARE = 0.002
_BITS = 16
#: Bounds of the training sample: rows a language, and code points of a row.
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 4000

_FIRST = np.array([s[0] for s in SCRIPTS])
_NAMES = sorted({s[1] for s in SCRIPTS})
_KIND = np.array([_NAMES.index(s[1]) for s in SCRIPTS])


def trigrams(spelt: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of all words' letter trigrams (ends marked), where each word's start, the words'
    letter counts and scripts. A word without letters has none, script -1, and one unused trigram."""
    codes = np.frombuffer("\n".join(spelt).lower().encode("utf-32-le"), "<u4").astype(np.int64)
    kinds, where = np.unique(codes, return_inverse=True)
    is_letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[where] if len(codes) else np.empty(0, bool)
    end = codes == 10
    word = np.cumsum(end) - end
    keep = is_letter | end
    n = len(spelt)
    letters = np.bincount(word[is_letter], minlength=n)[:n]
    script = np.full(n, -1, np.int64)
    at = np.flatnonzero(is_letter)[::-1]
    script[word[at]] = _KIND[np.searchsorted(_FIRST, codes[at], "right") - 1]  # the first letter's stays
    flat = np.concatenate([[10], codes[keep], [10]]).astype(np.uint64)
    h = flat[:-2] * np.uint64(0x9E3779B97F4A7C15) + flat[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + flat[2:] * np.uint64(0x165667B19E3779F9)
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)
    middle = flat[1:-1] != 10  # a trigram belongs to its middle letter's word
    starts = np.cumsum(letters) - letters
    return h[middle].astype(np.int64), starts, letters, script


@dataclass
class Model:
    languages: list
    table: np.ndarray  # 2^_BITS rows of log probabilities
    allowed: np.ndarray  # script by language
    prior: np.ndarray

    def word_scores(self, spelt: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by word and language, letters by word, and those letters that tell. Languages a
        script rules out get a low score; a word of a script that none was seen in, or without
        letters, leaves all alike and tells nothing."""
        grams, starts, letters, script = trigrams(spelt)
        scores = np.zeros((len(spelt), len(self.languages)), np.float32)
        some = np.flatnonzero(letters)
        if len(some):
            scores[some] = np.add.reduceat(self.table[grams], starts[some])
        scores -= scores.max(axis=1, keepdims=True)
        ruled = self.allowed[script]
        none = (script < 0) | ~ruled.any(axis=1)
        scores = np.where(ruled, scores, np.float32(-60))
        scores[none] = 0
        return np.maximum(scores, -60), letters, np.where(none, 0, letters)


def fit(found: list[tuple[str, object]], smooth: float = SMOOTH) -> Model:
    languages = sorted({lang for _, lang in found}, key=str)
    counts = np.zeros((len(languages), 1 << _BITS))
    seen = np.zeros((len(languages), len(_NAMES)))
    letters_of = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        texts = pa.array([t for t, v in found if v == lang], pa.large_string())
        spelt, codes, _ = words.coded(texts)
        grams, starts, letters, script = trigrams(spelt)
        times = np.bincount(codes, minlength=len(spelt))
        counts[k] = np.bincount(grams, np.repeat(times, letters), 1 << _BITS)
        known = script >= 0
        seen[k] = np.bincount(script[known], (times * letters)[known], len(_NAMES))
        letters_of[k] = max(1.0, (times * letters).sum())
    table = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * (1 << _BITS)))
    allowed = (seen / letters_of[:, None] >= SEEN_SHARE).T
    return Model(languages, np.ascontiguousarray(table.T.astype(np.float32)), allowed, letters_of / letters_of.sum() if len(languages) else letters_of)


def viterbi(scores: np.ndarray, ends: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word of texts that lie one after another; ``ends`` closes each text.

    Texts go side by side, longest first, one word of each at a time. Equal paths prefer to stay, and
    then the lower label."""
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - begin
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    n, langs = scores.shape
    came = np.empty((n, langs), np.uint8)
    own = np.arange(langs, dtype=np.uint8)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more than t words
    value = np.zeros((len(size), langs), np.float32)
    for t in range(longest):
        k = live[t]
        v = value[:k]
        if t:
            best = v.argmax(axis=1)
            jump = v[np.arange(k), best] - switch
            stay = v >= jump[:, None]
            came[begin[:k] + t] = np.where(stay, own, best[:, None])
            np.maximum(v, jump[:, None], out=v)
        v += scores[begin[:k] + t]
    label = np.zeros(n, np.uint8)
    state = value.argmax(axis=1).astype(np.uint8)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        label[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return label


def learn(docs: DataFrame, lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of texts whose language is known and whose id is not held out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(lang).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~training.held_out(F.col("doc_id")))
    return fit(training.texts(training.sampled(known, "lang", rows, ["doc_id", "text"]), "lang", rows, chars))


def label(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, and with ``spans`` the runs of words of one
    language as (first word, words, lang), words being what ASCII white space parts.

    ``score`` is the share of the text's letters in the language it gets; equal shares go to the
    language that comes first by name, also where no letter tells. A text that is null or has no letter is ``und`` with 0. Rows
    with equal or null ids stay; an empty table gives no rows. Without any learned language all texts
    are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in words.slices(batches):
            spelt, codes, ends = words.coded(batch["text"])
            n = len(ends)
            if not m.languages:
                share, best = np.zeros(n), np.zeros(n, np.int64)
                by_word = np.zeros(len(codes), np.uint8)
            else:
                scores, letters, telling = m.word_scores(spelt)
                by_word = viterbi(scores[codes], ends, switch)
                doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
                size = np.bincount(doc * len(m.languages) + by_word, telling[codes], n * len(m.languages)).reshape(n, -1)
                total = np.bincount(doc, letters[codes], n)
                best = np.where(total > 0, size.argmax(axis=1), len(m.languages))
                share = np.where(total > 0, size.max(axis=1) / np.maximum(total, 1), 0.0)
            out = [batch["doc_id"], pa.array(names[best], pa.string()), pa.array(share)]
            if spans:
                begin = np.concatenate([[0], ends[:-1]])
                new = np.ones(len(codes), bool)
                new[1:] = by_word[1:] != by_word[:-1]
                new[begin[begin < len(codes)]] = True
                at = np.flatnonzero(new)
                of = np.searchsorted(ends, at, "right")
                run = pa.StructArray.from_arrays(
                    [pa.array(at - begin[of]), pa.array(np.diff(np.append(at, len(codes)))), pa.array(names[by_word[at]], pa.string())],
                    ["first", "words", "lang"],
                )
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.searchsorted(at, ends)]).astype(np.int32)), run))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "spans"][: len(out)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fields = "doc_id long, lang_pred string, score double" + ", spans array<struct<first:long,words:long,lang:string>>" * spans
    found = rows.mapInArrow(scan, fields)
    rest = [F.size("spans").cast("long").alias("n_spans"), F.col("spans")] if spans else []
    return found.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *rest)
