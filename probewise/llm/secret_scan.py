"""Secrets in text: candidates by pattern, and a random forest that drops false positives.

A candidate is a value after a name and ``:`` or ``=``, a long token of mixed characters, a user's
password in an address, or a private key block. The forest judges its length, its characters'
transitions under the corpus' own letter bigrams, how much of it words of the corpus cover, the path
it comes from and the words next to it. It is trained on labelled findings.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm import words

# A run of characters is tried once, from where it begins, so no length needs a cap.
_ASSIGNED = re.compile(
    r"""(?<![A-Za-z0-9_.\-])[0-9_.\-]*+(?P<key>[A-Za-z][A-Za-z0-9_.\-]++)["']?\s{0,3}(?:=>|:=|[:=])\s{0,3}["'`]?(?P<value>[^\s"'`,;<>(){}\[\]]{8,}+)"""
)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.\-])\.*+(?P<value>[A-Za-z0-9+/_.\-]{20,}+={0,2})")
_ADDRESS = re.compile(r"[a-z][a-z0-9+]{1,12}://[^\s:/@]*+:(?P<value>[^\s:/@]{4,}+)@")
_BLOCK = re.compile(r"(?P<value>-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[^-]*+-----END [A-Z ]{0,24}PRIVATE KEY-----)?)")
#: Openings of keys that services publish in their documents.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-", "npm_", "SG.")
CUES = re.compile(r"(?i)secret|token|passw|pwd|api.?key|apikey|auth|credential|bearer|private|access.?key|signing|client.?key|session.?key|contraseñ|clave|passwort|schlüssel|jeton|motdepasse")
CALM = re.compile(r"(?i)commit|checksum|sha\d*|md5|digest|integrity|hash\b|uuid|guid|\bid\b|_id\b|revision|version|build|etag|fingerprint|url|path|file|class|function|import|example|sample|title|note|page|date|time|license")
DUMMY = re.compile(r"(?i)example|changeme|your|dummy|sample|placeholder|xxx|test|todo|none|null|redacted|\*\*\*|\$\{|123456|insert|replace")
TEST_PATH = re.compile(r"(?i)test|example|sample|fixture|mock|docs?/|demo")
CONFIG_PATH = re.compile(r"(?i)\.env|config|settings|\.ya?ml|\.ini|\.properties|\.tf|credentials|secrets?\b")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
NEAR = 40
#: The dictionary: the corpus' most frequent words of these lengths.
DICTIONARY_WORDS = 20_000
WORD_LETTERS = (3, 6)
LETTERS = string.ascii_lowercase + "0"  # any digit counts as 0, all else as one more
FEATURES = (
    "log length, entropy, digits, uppers, others, class changes, letter transitions, dictionary coverage, hex, opening, assigned,"
    " key cue, key calm, near cue, near calm, test path, config path, uuid, dummy, distinct, address, block"
).split(", ")


@dataclass
class Corpus:
    """What the whole corpus says of ordinary words: log probabilities of letter pairs, and a dictionary."""

    pairs: np.ndarray
    dictionary: frozenset[str]


@dataclass
class Candidate:
    start: int
    end: int
    value: str
    key: str
    before: str
    rule: str


def _classes(text: str) -> np.ndarray:
    """Letters 0-25 whatever their case, digits 26, other characters 27."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return _CLASS[raw]


_CLASS = np.full(256, 27, np.int64)
_CLASS[[ord(c) for c in string.ascii_lowercase]] = np.arange(26)
_CLASS[[ord(c) for c in string.ascii_uppercase]] = np.arange(26)
_CLASS[[ord(c) for c in string.digits]] = 26


def corpus(docs: DataFrame, text: str = "text", size: int = DICTIONARY_WORDS) -> Corpus:
    """Counts over all whole texts: letter pairs (a fixed 28 by 28 table) and short words. Tasks add up
    their own counts first; the driver gets the table and the ``size`` most frequent words."""
    low, high = WORD_LETTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(28 * 28, np.int64)
        for batch in words.slices(batches):
            spelt, codes, _ = words.coded(batch["text"])
            times = np.bincount(codes, minlength=len(spelt))
            for value in batch["text"]:
                c = _classes(value.as_py())
                pairs += np.bincount(c[:-1] * 28 + c[1:], minlength=28 * 28)
            some = [k for k, w in enumerate(spelt) if low <= len(w) <= high and w.isalpha()]
            names = [spelt[k].lower() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(times[some])], ["word", "n"])
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([f"{k:04d}" for k in at.tolist()], pa.string()), pa.array(pairs[at])], ["word", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    is_pair = F.col("word").rlike("^[0-9]{4}$")
    table = np.ones(28 * 28)
    top = counts.where(~is_pair & (F.col("n") > 1)).orderBy(F.desc("n"), "word").limit(size)
    found = counts.where(is_pair).union(top).collect()
    for r in found:
        if r["word"].isdigit():
            table[int(r["word"])] += r["n"]
    table = table.reshape(28, 28)
    known = frozenset(r["word"] for r in found if not r["word"].isdigit())
    return Corpus(np.log(table / table.sum(axis=1, keepdims=True)), known)


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text by position; a token inside another rule's value is not one of its own."""
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []
    for rule, pattern in (("block", _BLOCK), ("address", _ADDRESS), ("assigned", _ASSIGNED), ("token", _TOKEN)):
        at = 0
        for m in pattern.finditer(text):
            a, b = m.span("value")
            value = m["value"]
            if rule == "assigned":
                if value.startswith("//"):
                    continue
                quote = text[a - 1]
                if not (quote in "\"'`" and text[b : b + 1] == quote):  # within quotes all of it is the value
                    value = value.rstrip("!?.:*#$%&|\\")
                    b = a + len(value)
                if len(value) < 8:
                    continue
            if rule == "token":
                value = value.rstrip(".")
                b = a + len(value)
                if len(value) < 20 or not any(c.isdigit() for c in value):
                    continue
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at < len(taken) and taken[at][0] < b:
                continue
            key = m["key"] if rule == "assigned" else ""
            begin = m.start("key") if key else m.start()
            out.append(Candidate(a, b, value, key, text[max(0, begin - NEAR) : begin], rule))
        taken = sorted((c.start, c.end) for c in out)
    return sorted(out, key=lambda c: c.start)


def _covered(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters under dictionary words, longest first from the left."""
    lower, at, hit = value.lower(), 0, 0
    low, high = WORD_LETTERS
    while at < len(lower):
        for n in range(high, low - 1, -1):
            if lower[at : at + n] in dictionary and len(lower) - at >= n:
                hit += n
                at += n
                break
        else:
            at += 1
    return hit / len(lower)


def features(c: Candidate, path: str, known: Corpus) -> list[float]:
    v, n = c.value, len(c.value)
    counts = np.bincount(np.frombuffer(v.encode("latin-1", "replace"), np.uint8))
    p = counts[counts > 0] / n
    digits, uppers = sum(ch.isdigit() for ch in v) / n, sum(ch.isupper() for ch in v) / n
    others = sum(not ch.isalnum() for ch in v) / n
    kind = [0 if ch.isdigit() else 1 if ch.islower() else 2 if ch.isupper() else 3 for ch in v]
    k = _classes(v)
    moves = float(known.pairs[k[:-1], k[1:]].mean()) if n > 1 else 0.0
    return [
        math.log(len(c.value)), float(-(p * np.log2(p)).sum()), digits, uppers, others,
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n, moves, _covered(v, known.dictionary),
        float(re.fullmatch(r"[0-9a-fA-F]+", v) is not None), float(v.startswith(PREFIXES)), float(c.rule == "assigned"),
        float(bool(CUES.search(c.key))), float(bool(CALM.search(c.key))), float(bool(CUES.search(c.before))), float(bool(CALM.search(c.before))),
        float(bool(TEST_PATH.search(path))), float(bool(CONFIG_PATH.search(path))), float(_UUID.fullmatch(v) is not None), float(bool(DUMMY.search(v))),
        len(p) / n, float(c.rule == "address"), float(c.rule == "block"),
    ]


class Forest:
    """Classification trees on bootstrap samples; each split looks at a random few features."""

    def __init__(self, trees: int = 40, depth: int = 10, seed: int = 9):
        self.trees, self.depth, self.seed = trees, depth, seed
        self.nodes: list[np.ndarray] = []  # rows: feature (-1 in leaves), threshold, left, right, share of label 1

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        tries = max(1, int(math.sqrt(x.shape[1])) + 1)
        for _ in range(self.trees):
            rows: list[list[float]] = []

            def grow(at: np.ndarray, depth: int, rows=rows) -> int:
                me, share = len(rows), float(y[at].mean())
                rows.append([-1, 0, 0, 0, share])
                if depth == self.depth or share in (0.0, 1.0) or len(at) < 4:
                    return me
                best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
                for f in rng.choice(x.shape[1], tries, replace=False):
                    values = x[at, f]
                    for cut in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 12))):
                        left = values <= cut
                        k = left.sum()
                        if 0 < k < len(at):
                            a, b = y[at[left]].mean(), y[at[~left]].mean()
                            impurity = (k * 2 * a * (1 - a) + (len(at) - k) * 2 * b * (1 - b)) / len(at)
                            if impurity < best[0]:
                                best = (impurity, int(f), float(cut))
                if best[1] >= 0:
                    left = x[at, best[1]] <= best[2]
                    rows[me][:2] = best[1], best[2]
                    rows[me][2] = grow(at[left], depth + 1)
                    rows[me][3] = grow(at[~left], depth + 1)
                return me

            grow(rng.integers(0, len(x), len(x)), 0)
            self.nodes.append(np.array(rows))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                feature = tree[at, 0].astype(np.int64)
                inner = feature >= 0
                left = x[np.arange(len(x)), np.maximum(feature, 0)] <= tree[at, 1]
                at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
            total += tree[at, 4]
        return total / max(1, len(self.nodes))


@dataclass
class Finding:
    """A labelled finding: text that holds one candidate, its path, and whether it is a secret."""

    text: str
    path: str
    label: int


def labelled_findings(dictionary: frozenset[str], n: int = 3000, seed: int = 21) -> list[Finding]:
    """Findings with their labels, made by a fixed rule: random keys in places where keys stand, and the
    usual false positives (words, names, paths, hashes, identifiers, numbers, placeholders) in the same
    and other places. Words come from the corpus' dictionary."""
    rng = Random(seed)
    vocabulary = sorted(dictionary) or ["alpha", "beta", "gamma", "delta", "value", "other"]
    alnum = string.ascii_letters + string.digits
    some = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    word = lambda: rng.choice(vocabulary)
    hexa = lambda k: some("0123456789abcdef", k)
    secret = [
        lambda: hexa(rng.choice([32, 40, 48, 64])), lambda: some(alnum, rng.randrange(16, 64)), lambda: some(alnum + "+/", rng.randrange(24, 80)) + "=" * rng.randrange(3),
        lambda: rng.choice(PREFIXES) + some(alnum, rng.randrange(16, 48)), lambda: some(alnum + "!@#%^&*-_", rng.randrange(10, 24)),
        lambda: f"eyJ{some(alnum, 24)}.{some(alnum + '-_', rng.randrange(40, 120))}.{some(alnum + '-_', 43)}", lambda: f"SG.{some(alnum, 22)}.{some(alnum + '-_', 43)}",
        lambda: hexa(40).upper(), lambda: word().title() + some(string.digits + "!#%", rng.randrange(4, 8)) + some(alnum, 4),
    ]
    calm = [
        lambda: "".join(word().title() for _ in range(rng.randrange(3, 7))) + str(rng.randrange(99)), lambda: "_".join(word() for _ in range(rng.randrange(2, 6))) + str(rng.randrange(9)),
        lambda: "/".join(word() for _ in range(rng.randrange(3, 7))) + str(rng.randrange(9)), lambda: word() + word() + word(), lambda: some(string.digits, rng.randrange(8, 24)),
        lambda: f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T00:00:00", lambda: "-".join(hexa(k) for k in (8, 4, 4, 4, 12)),
        lambda: ".".join(word() for _ in range(rng.randrange(3, 7))) + str(rng.randrange(99)), lambda: f"//{word()}.{word()}.com/{word()}/{word()}-{rng.randrange(9999)}.html",
        lambda: rng.choice(["your_api_key_here", "changeme12345", "xxxxxxxxxxxxxxxxxxxx1", "example-token-0000", "${SECRET_TOKEN}", "placeholder_value_1"]), lambda: word().upper() * 3 + "1",
    ]
    hashes = [lambda: hexa(40), lambda: hexa(64), lambda: hexa(32), lambda: "sha512-" + some(alnum + "+/", 80)]
    keys = ["token", "secret", "password", "api_key", "apiKey", "auth_token", "access_key", "client_secret", "private_key", "passwd", "AWS_SECRET_ACCESS_KEY", "TOKEN", "bearer", "db_password"]
    calm_keys = ["commit", "sha256", "checksum", "md5", "revision", "integrity", "id", "uuid", "etag", "version", "name", "title", "url", "path", "class", "note", "page"]
    paths = ["src/app/config.py", "deploy/.env", "settings.yaml", "src0", "src7", "main.tf", "", "lib/client.js", "notes.txt"]
    test_paths = ["tests/fixtures/data.json", "docs/example.md", "demo/sample.env"]
    out = []
    for _ in range(n):
        lead = " ".join(word() for _ in range(rng.randrange(0, 7)))
        quote = rng.choice(['"', "'", ""])
        join = rng.choice([" = ", "=", ": ", ":"])
        roll, path = rng.random(), rng.choice(paths)
        if roll < 0.40:
            value, label = rng.choice(secret)(), 1
            text = f"{lead} {rng.choice(keys)}{join}{quote}{value}{quote} {word()}"
        elif roll < 0.45:
            text, label = f"{lead} {rng.choice(['secret', 'token', 'bearer', 'password is', 'api key'])} {rng.choice(secret[:4] + secret[5:7])()} {word()}", 1
        elif roll < 0.47:
            user, size = rng.choice([word(), word(), ""]), rng.choice([12, 12, 40, 200])
            text, label = f"{lead} postgres://{user}:{some(alnum, size)}@{word()}.com/{word()}", 1
        elif roll < 0.49:
            kind = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
            text, label = f"{lead} -----BEGIN {kind}PRIVATE KEY-----\n{some(alnum, 64)}\n-----END {kind}PRIVATE KEY-----", 1
        elif roll < 0.62:
            text, label = f"{lead} {rng.choice(keys)}{join}{quote}{rng.choice(calm)()}{quote} {word()}", 0
        elif roll < 0.80:
            text, label = f"{lead} {rng.choice(calm_keys)}{join}{quote}{rng.choice(calm + hashes)()}{quote}", 0
        elif roll < 0.92:
            text, label = f"{lead} {word()}{join}{quote}{rng.choice(calm + hashes[:1])()}{quote} {word()}", 0
        else:
            text, label = f"{lead} {rng.choice(['commit', 'sha', 'hash', 'see', 'file', word()])} {rng.choice(calm + hashes)()} {word()}", 0
        if label == 0 and rng.random() < 0.2:
            path = rng.choice(test_paths)
        out.append(Finding(text, path, label))
    return out


@dataclass
class Model:
    known: Corpus
    forest: Forest

    def findings(self, text: str, path: str, least: float) -> list[tuple[Candidate, float]]:
        found = candidates(text)
        if not found:
            return []
        x = np.array([features(c, path, self.known) for c in found])
        return [(c, float(s)) for c, s in zip(found, self.forest.score(x), strict=True) if s >= least]


def learn(docs: DataFrame, findings: list[Finding] | None = None, text: str = "text") -> Model:
    """Corpus statistics over all documents, and a forest on labelled findings."""
    known = corpus(docs, text)
    x, y = [], []
    for f in findings if findings is not None else labelled_findings(known.dictionary):
        for c in candidates(f.text):
            x.append(features(c, f.path, known))
            y.append(f.label)
    forest = Forest()
    return Model(known, forest.fit(np.array(x), np.array(y, float)) if x else forest)


LEAST = 0.5


def scan(docs: DataFrame, model: Model, least: float = LEAST, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per secret: doc_id, start, end (code points, end exclusive), rule, name, score, value_sha256.

    The value itself is not returned. Null and empty texts have none; a null path is empty. Rows with
    equal or null ids give their own findings. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, start long, end long, rule string, name string, score double, value_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in schema.split(", ")}
            for key, value, place in zip(batch["doc_id"], batch["text"], batch["path"], strict=True):
                for c, s in shared.value.findings(value.as_py() or "", place.as_py() or "", least):
                    row = (key.as_py(), c.start, c.end, c.rule, c.key, s, hashlib.sha256(c.value.encode()).hexdigest())
                    for name, v in zip(out, row, strict=True):
                        out[name].append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), where.alias("path"))
    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model, mask: str = "[SECRET]", least: float = LEAST, text: str = "text", path: str = "source", size: str = "n_chars") -> DataFrame:
    """The same rows with every secret in ``text`` replaced by ``mask`` and ``size``, where it is a column
    and the text changed, counted anew. All other columns and texts stay as they are: null and empty texts
    have no secret, repeated rows are masked alike, very long texts whole, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, has = docs.columns.index(text), {c: docs.columns.index(c) for c in (path, size) if c in docs.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            places = batch.column(has[path]).to_pylist() if path in has else [""] * len(texts)
            changed = {}
            for k, (value, place) in enumerate(zip(texts, places, strict=True)):
                found = shared.value.findings(value or "", str(place or ""), least)
                if found:
                    parts, last = [], 0
                    for c, _ in found:
                        parts += [value[last : c.start], mask]
                        last = c.end
                    changed[k] = "".join(parts) + value[last:]
            if changed:
                fresh = [changed.get(k, t) for k, t in enumerate(texts)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(fresh, batch.schema.field(at).type))
                if size in has:
                    f = batch.schema.field(has[size])
                    sizes = [len(changed[k]) if k in changed else v for k, v in enumerate(batch.column(has[size]).to_pylist())]
                    batch = batch.set_column(has[size], f, pa.array(sizes, f.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
