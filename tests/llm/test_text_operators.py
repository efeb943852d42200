from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from probewise.llm import decontam, html_text, langid, pii, quality, secret_scan, simhash, store, winnow

WORDS = st.lists(st.sampled_from("a b c d e f g h".split()), max_size=40)


# ---- SimHash


def plain_fingerprint(text, words=4):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not parts:
        return 0
    grams = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def plain_components(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sets(st.integers(0, 63), max_size=6)), min_size=1, max_size=200), st.sampled_from([0, 1, 3, 4, 7]))
def test_bit_slices_find_every_near_pair(made, radius):
    base = [int(x) for x in np.random.default_rng(1).integers(0, 2**63, 6)]
    values = [base[k] ^ sum(1 << b for b in bits) for k, bits in made]
    begin = np.array([0 if i < len(values) // 2 else len(values) // 2 for i in range(len(values))])
    got = {(int(i), int(j)) for a, b in simhash.near_earlier(np.array(values, np.uint64), begin, radius) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(int(begin[i]), i) if (values[i] ^ values[j]).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize("n", [300, 10**7, 10**11])
def test_links_keep_components_for_any_block_choice(spark, n):
    rng = np.random.default_rng(5)
    values = []
    for _ in range(40):
        v = int(rng.integers(0, 2**63))
        for _ in range(rng.integers(1, 8)):
            values.append(v)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                v ^= 1 << int(b)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), n)
    roots = {r.fp: r.root for r in simhash.component_roots(edges).collect()}
    want = plain_components(values, 4)
    mine = [roots.get(s, s) for s in signed]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_simhash_groups_equal_brute_force(spark, edge_docs, empty_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    values = [plain_fingerprint(r.text) for r in rows]
    comp = plain_components(values, 4)
    least = {c: min((r.doc_id for r, k in zip(rows, comp, strict=True) if k == c and r.doc_id is not None), default=None) for c in comp}
    want = Counter((r.doc_id, f"{v:016x}", least[c]) for r, v, c in zip(rows, values, comp, strict=True))
    got = simhash.near_duplicates(edge_docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_one_of_each_group_stays(spark, edge_docs, empty_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    comp = plain_components([plain_fingerprint(r.text) for r in rows], 4)
    least = {}
    for r, c in zip(rows, comp, strict=True):
        least.setdefault(c, []).append(r.doc_id)
    want = Counter(min((i for i in ids if i is not None), default=None) for ids in least.values())
    stored = store.kept(edge_docs, "edge")
    got = simhash.one_of_each(stored)
    assert got.columns == edge_docs.columns and Counter(r.doc_id for r in got.collect()) == want
    assert simhash.one_of_each(empty_docs).count() == 0


def test_a_large_group_is_split_and_stays_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    values = [1 << i | 1 << j for i in range(12) for j in range(i)]
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), len(values))
    assert len({r.root for r in simhash.component_roots(edges).collect()}) == 1


# ---- winnowing


def plain_winnow(text, gram, window):
    mask = (1 << 64) - 1
    c = [(ord(x) + 1) * int(winnow._MIX) & mask for x in text]
    hashes = []
    for i in range(max(1, len(c) - gram + 1) if c else 0):
        h = 0
        for x in c[i : i + gram]:
            h = (h * int(winnow._BASE) + x) & mask
        h = (h ^ (h >> 29)) * int(winnow._MIX) & mask
        hashes.append((h ^ (h >> 32)) >> 24)
    w = min(window, len(hashes))
    picked = {max(j for j in range(i, i + w) if hashes[j] == min(hashes[i : i + w])) for i in range(len(hashes) - w + 1)} if hashes else set()
    return [(hashes[j], j) for j in sorted(picked)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab ", max_size=90), max_size=5), st.integers(1, 9), st.integers(1, 12))
def test_selection_equals_brute_force(texts, gram, window):
    got = winnow.select([np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts], gram, window)
    assert [list(zip(h.tolist(), p.tolist(), strict=True)) for h, p in got] == [plain_winnow(t, gram, window) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.text("abcdef ", min_size=20, max_size=30), st.text("abcdef ", max_size=60), st.text("abcdef ", max_size=60))
def test_a_shared_passage_shares_a_hash(shared, a, b):
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a + shared, shared + b))
    (h, _), (g, _) = winnow.select([x, y], 6, 10)
    assert set(h.tolist()) & set(g.tolist())


def test_long_texts_in_blocks(monkeypatch):
    text = np.random.default_rng(2).integers(97, 105, 3000).astype("<u4")
    whole = winnow.select([text])
    monkeypatch.setattr(winnow, "_BLOCK", 100)
    parts = winnow.select([text])
    assert all((a == b).all() for a, b in zip(whole[0], parts[0], strict=True))


@pytest.mark.parametrize("buckets", [1, 5])
def test_edited_texts(spark, edge_docs, empty_docs, buckets):
    rows = [(r.doc_id, r.text or "") for r in edge_docs.select("doc_id", "text").collect()]
    got = winnow.fingerprints(edge_docs, buckets=buckets).collect()
    assert len(got) == len(rows)
    distinct = edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    order = sorted(((r.doc_id, r.text or "") for r in distinct.collect()), reverse=True)
    got = {r.doc_id: r for r in winnow.fingerprints(distinct, buckets=buckets).collect()}
    for k, (key, text) in enumerate(order):
        other, cut = order[(k + 1) % len(order)][1], len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        a, b, c = ({h for h, _ in plain_winnow(t[:3000], 24, 32)} for t in (text, edited, other))
        assert got[key].n_chars == len(text) and got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(text) < 3000 and len(other) < 3000:
            assert got[key].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
            assert got[key].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1)
    assert winnow.fingerprints(empty_docs).count() == 0
    assert len(winnow.fingerprints(edge_docs.limit(1)).collect()) == 1


# ---- string tiling


def plain_tiles(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = least, []
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and free_d[a + n] and free_i[b + n]:
                    n += 1
                if n > best:
                    best, found = n, [(a, b)]
                elif n == best:
                    found.append((a, b))
        if not found:
            return out
        for a, b in found:
            if all(free_d[a : a + best]) and all(free_i[b : b + best]):
                out.append((a, b, best))
                free_d[a : a + best] = [False] * best
                free_i[b : b + best] = [False] * best


@settings(max_examples=120, deadline=None)
@given(WORDS, WORDS)
def test_tiles_equal_brute_force(doc, item):
    d, i = (np.array([xxhash.xxh64_intdigest(w) for w in x], np.uint64) for x in (doc, item))
    parts = list(decontam.Items([("1", " ".join(item))], 3).matches(d, np.array([len(d)])))
    found = np.concatenate([*(np.stack(part[2:], axis=1) for part in parts), np.empty((0, 3), np.int64)])
    hits = {(p + t, q + t) for p, q, n in found.tolist() for t in range(n - 2)}
    assert hits == {(p, q) for p in range(len(d) - 2) for q in range(len(i) - 2) if (d[p : p + 3] == i[q : q + 3]).all()}
    assert decontam.tile(found, 3) == plain_tiles(doc, item, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=5), st.lists(WORDS, min_size=1, max_size=3))
def test_matches_of_several_documents_and_items(docs, items):
    ends = np.cumsum([len(d) for d in docs])
    values = np.array([xxhash.xxh64_intdigest(w) for d in docs for w in d], np.uint64)
    block = decontam.Items([(str(k), " ".join(x)) for k, x in enumerate(items)], 2)
    got = Counter()
    for doc, item, at, place, run in block.matches(values, ends):
        got.update(zip(doc.tolist(), item.tolist(), (at - (ends - [len(d) for d in docs])[doc]).tolist(), place.tolist(), run.tolist(), strict=True))
    want = Counter()
    for a, doc in enumerate(docs):
        for b, item in enumerate(items):
            for p in range(len(doc)):
                for q in range(len(item)):
                    if p and q and doc[p - 1] == item[q - 1]:
                        continue
                    n = 0
                    while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n]:
                        n += 1
                    if n >= 2:
                        want[a, b, p, q, n] += 1
    assert got == want


def test_equal_words_cost_an_entry_a_diagonal(spark):
    docs = spark.createDataFrame([(1, "same " * 500_000), (2, "same other " * 50_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "same " * 1000), (6, "other same " * 300)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.longest_tile) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 5): (1.0, 1, 1000), (2, 6): (1.0, 1, 600)}


def test_contamination_catches_reordered_passages(spark, edge_docs, empty_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    a, b = item.split()[:7], item.split()[7:]
    docs = spark.createDataFrame([
        (1, "before it " + item.upper().replace(" ", ", ") + " after"), (2, " ".join(b) + " and then " + " ".join(a)), (3, " ".join(a[:4]) + " only"),
        (4, None), (5, ""), (2, " ".join(b) + " and then " + " ".join(a)),
    ], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "too short"), (9, item)], "item_id long, text string")
    want = Counter({(1, 9): 2, (2, 9): 4})
    for chars in (decontam.BLOCK_CHARS, 40):
        got = decontam.contaminated(docs, bench, block_chars=chars).collect()
        assert Counter((r.doc_id, r.item_id) for r in got) == want and {r.coverage for r in got} == {1.0}
    assert decontam.contaminated(empty_docs, bench).count() == 0 and decontam.contaminated(docs, bench.where("false")).count() == 0
    assert decontam.contaminated(edge_docs, bench).count() == 0


# ---- language


def plain_viterbi(scores, switch):
    n, k = scores.shape
    best = {(c,): float(scores[0, c]) for c in range(k)} if n else {(): 0.0}
    for t in range(1, n):
        best = {p + (c,): v + float(scores[t, c]) - (switch if p[-1] != c else 0) for p, v in best.items() for c in range(k)}
    return max(best.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=5), st.integers(0, 10**6))
def test_viterbi_paths_score_best(sizes, seed):
    scores = np.random.default_rng(seed).normal(0, 2, (sum(sizes), 3)).astype(np.float32)
    ends = np.cumsum(sizes)
    label = langid.viterbi(scores, ends, 1.5)
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        own = sum(float(scores[t, label[t]]) for t in range(a, b)) - 1.5 * sum(label[t] != label[t - 1] for t in range(a + 1, b))
        assert b == a or own == pytest.approx(plain_viterbi(scores[a:b], 1.5), abs=1e-4)


def test_language_held_out_and_mixed(spark, edge_docs, empty_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    got = langid.label(docs, model, spans=False).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    en, de = (docs.where(f"lang = '{x}' AND n_chars > 800").orderBy("doc_id").first().text[:400] for x in ("en", "de"))
    mixed = langid.label(spark.createDataFrame([(1, f"{en} {de}")], "doc_id long, text string"), model).first()
    assert [s.lang for s in mixed.spans][0] == "en" and [s.lang for s in mixed.spans][-1] == "de" and len(mixed.spans) <= 3
    edge = langid.label(edge_docs, model).collect()
    assert len(edge) == edge_docs.count()
    for r, t in ((r, None) for r in edge if r.doc_id in (1, 2)):
        assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.label(empty_docs, model).count() == 0
    assert {r.lang_pred for r in langid.label(edge_docs, langid.learn(empty_docs)).collect()} == {"und"}


# ---- quality


def test_pair_tables_equal_plain_convolution():
    net = quality.Network()
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 2, 7, 300, 700, 5000)]
    import pyarrow as pa

    got = net.score(pa.array(texts, pa.large_binary()), net.pair_tables())
    for text, score in zip(texts, got, strict=True):
        d = quality.padded(text)
        places = (len(d) - 8) // 2 + 1
        act = np.array([sum(net.w["filters"][k][d[2 * p + k]] for k in range(8)) for p in range(places)]) + net.w["bias"]
        pooled = np.array([act[a:b].max(axis=0) for a, b in zip(*quality.chunk_bounds(places), strict=True)])
        want = net.probability(net.summary(pooled, np.array([0]), np.array([len(text)])))[0]
        assert score == pytest.approx(want, abs=1e-5)
        starts, ends = quality.chunk_bounds(places)
        assert starts[0] == 0 and ends[-1] == places and (starts[1:] < ends[:-1]).all()


def test_quality_held_out(spark, edge_docs, empty_docs):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = quality.train(docs, labels)
    got = quality.score(docs, net).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and ((held.score >= 0.5) == held.quality).mean() > 0.93
    edge = quality.score(edge_docs, net).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert len({r.score for r in edge if r.doc_id in (0, 1)}) == 1
    kept = quality.keep_good(edge_docs, net)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.predicted for r in edge)
    assert quality.score(empty_docs, net).count() == 0 and quality.keep_good(empty_docs, net).count() == 0
    assert quality.score(edge_docs, quality.train(empty_docs, labels)).count() == edge_docs.count()


# ---- personal data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 14 <= len(d) <= 19 and total % 10 == 0, 10 <= len(d) <= 15][kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_personal_data_base_spans(spark, edge_docs, empty_docs):
    rng = np.random.default_rng(4)
    alphabet = ["a", "Z", "@", ".", "1", "4", "+", "-", " ", "(", ")", "é", "%", "256", "0", "com", "@x.y", "\n", "🙂", "4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.1"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(400)]
    texts += ["1" * 20000, "a" * 20000, "a." * 9000 + "@b" + ".c" * 9000, "+1" + "(" * 9000, "1 " * 9000, "4111 1111 1111 1111", "00000000010.1.2.0255", "a@b.c+d@e.f", "1.2.3.4.5.6.7.8", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.find(docs).collect():
        base = plain_base(texts[r.doc_id])
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        count = Counter(k for _, k, _ in base)
        assert (r.base_sha256, [r.n_email, r.n_ip, r.n_card, r.n_phone]) == (hashlib.sha256(told.encode()).hexdigest(), [count[k] for k in range(4)]), texts[r.doc_id]
        assert set(told.split(",")) <= set(r.spans.split(","))
    assert pii.find(edge_docs).count() == edge_docs.count() and pii.find(empty_docs).count() == 0


def test_boosted_trees_add_numbers_without_their_mark(spark):
    rows = []
    for k in range(600):
        number = f"({k % 900 + 100}) 555-{k % 9000 + 1000}"
        rows.append((k, f"please call +1 {number} today"))
        rows.append((1000 + k, f"invoice total {k * 7919 % 10**13 + 10**13} was paid"))
    rows.append((9999, "please call (321) 555-4321 today"))
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9999].spans == "phone:12:26" and got[9999].n_added == 1 and got[9999].n_phone == 0
    assert sum(got[1000 + k].n_added for k in range(600)) == 0


def test_unmarked_cases_are_added_however_common(spark):
    """A tenth of unmarked cases in the same places as the marked ones, and look-alikes that are none."""
    rows, want = [], {}
    for k in range(500):
        number = f"({k % 700 + 200}) 555-{k * 7 % 9000 + 1000}"
        rows.append((k, f"please call +1 {number} today"))
        rows.append((1000 + k, f"contact user{k}@host{k % 40}.com for details"))
        rows.append((2000 + k, f"connected from 10.{k % 250}.3.{k % 199} again"))
        rows.append((3000 + k, f"order no {number} was shipped"))
        rows.append((4000 + k, f"see version {k % 90}.2.{k % 7}.{k % 11 + 300} of it"))
        if k % 5 == 0:
            rows.append((5000 + k, f"please call {number} today"))
            want[5000 + k] = f"phone:12:{12 + len(number)}"
            rows.append((6000 + k, f"contact user{k} (at) host{k % 40} dot com for details"))
            want[6000 + k] = f"email:8:{8 + len(f'user{k} (at) host{k % 40} dot com')}"
            address = f"2001:db8::{k:x}" if k % 2 else f"2001:db8:0:{k:x}:1:2:3:{k + 1:x}"
            rows.append((7000 + k, f"connected from {address} again"))
            want[7000 + k] = f"ip:15:{15 + len(address)}"
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].spans for i in want} == want
    assert sum(got[i].n_added for i in got if 3000 <= i < 5000) == 0


def test_added_spans_are_whole_and_decided_by_the_trees(spark):
    """Runs of any length are taken whole, a doubled card is two, and look-alikes that no word gives away go."""
    rows, want = [], {}
    for k in range(400):
        number = f"({k % 700 + 200}) 555-{k * 7 % 9000 + 1000}"
        rows.append((k, f"please call +1 {number} today"))
        rows.append((1000 + k, f"contact user{k}@host{k % 40}.com for details"))
        card = f"4{k * 7919 % 10**14:014d}"
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(card)))
        card += str(-total % 10)
        rows.append((2000 + k, f"it was {card} that was used"))
        rows.append((3000 + k, f"in the years {1950 + k % 60} {1960 + k % 50} {1990 + k % 20} it rained"))
        if k % 20 == 0:
            rows.append((4000 + k, f"it was {card} {card} that was used"))
            want[4000 + k] = f"card:7:{7 + 16},card:24:{24 + 16}"
    user, host = "u" * 100, ".".join(["label"] * 12)
    rows.append((9000, f"contact {user} (at) {host} for details"))
    want[9000] = f"email:8:{8 + len(f'{user} (at) {host}')}"
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].spans for i in want} == want
    assert sum(got[i].n_added for i in got if i < 4000) == 0


def test_best_first_equals_a_walk_by_score(spark):
    rng = np.random.default_rng(6)
    rows = []
    for row in range(60):
        for _ in range(int(rng.integers(1, 14))):
            a = int(rng.integers(0, 40))
            rows.append((row, row, int(rng.integers(0, 4)), a, a + int(rng.integers(1, 15)), float(rng.integers(80, 100)) / 100))
    want = Counter()
    for row in range(60):
        taken = []
        for s in sorted((r for r in rows if r[0] == row), key=lambda r: (-r[5], r[3], r[2], r[4])):
            if all(s[4] <= t[3] or t[4] <= s[3] for t in taken):
                taken.append(s)
        want.update((row, s[2], s[3], s[4]) for s in taken)
    spans = spark.createDataFrame(rows, "row long, doc_id long, kind int, start long, end long, score double").repartition(5)
    assert Counter((r.row, r.kind, r.start, r.end) for r in pii.best_first(spans).collect()) == want


# ---- secrets


def test_secrets(spark, edge_docs, empty_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secret_scan.learn(docs)
    right = total = 0
    for f in secret_scan.labelled_findings(model.known.dictionary, 800, seed=77):
        for c in secret_scan.candidates(f.text):
            right += (model.forest.score(np.array([secret_scan.features(c, f.path, model.known)]))[0] >= 0.5) == f.label
            total += 1
    assert right / total > 0.95
    text = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").text
    want = {(i, m.start(1), m.end(1)) for i, t in text.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    got = secret_scan.scan(docs, model).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == want
    assert all(r.value_sha256 == hashlib.sha256(text[r.doc_id][r.start : r.end].encode()).hexdigest() for r in got)
    clean = secret_scan.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count() and secret_scan.scan(clean, model).count() == 0
    changed = clean.join(docs.select("doc_id", docs.text.alias("was")), "doc_id").where("text <> was").collect()
    assert {r.doc_id for r in changed} == {i for i, _, _ in want} and all(r.n_chars == len(r.text) for r in changed)
    assert secret_scan.redact(edge_docs, model).count() == edge_docs.count()
    assert secret_scan.scan(empty_docs, model).count() == 0
    texts = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    for r in secret_scan.scan(edge_docs, secret_scan.learn(empty_docs)).collect():
        spans = [t[r.start : r.end] for i, t in texts if i == r.doc_id and t]
        assert r.value_sha256 in {hashlib.sha256(v.encode()).hexdigest() for v in spans}


def test_quoted_values_are_whole():
    for quote in "\"'`":
        for value in ("hunter2secret!", "Tr0ub4dor&3$$", "x" * 9 + "???"):
            text = f"password = {quote}{value}{quote} and on"
            assert [text[c.start : c.end] for c in secret_scan.candidates(text)] == [value]
    text = "password = hunter2secret! It went on"
    assert [c.value for c in secret_scan.candidates(text)] == ["hunter2secret"]
    known = secret_scan.Corpus(np.zeros((28, 28)), frozenset({"word"}))
    half = secret_scan.features(secret_scan.Candidate(0, 20000, "word" * 2500 + "7" * 10000, "", "", "token"), "", known)
    assert (half[2], half[7]) == (0.5, 0.5)


def test_secrets_of_any_length_and_form(spark):
    rng = np.random.default_rng(8)
    some = lambda n: "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), n))
    jwt, grid = f"eyJ{some(30)}.{some(80)}.{some(43)}", f"SG.{some(22)}.{some(43)}"
    short, long, plain = some(16), some(300), some(40)
    cases = [
        (f"set SPRING_DATASOURCE_HIKARI_DATA_SOURCE_PROPERTIES_PASSWORD={plain} here", plain), (f"at redis://:{short}@cache:6379/0 now", short),
        (f"at postgres://{'u' * 90}:{long}@db.net/x now", long), (f"Authorization: Bearer {jwt}\nHost: x", jwt), (f"we use {grid}. Then", grid), (f"run --password={plain} now", plain),
    ]
    for text, value in cases:
        assert value in [c.value for c in secret_scan.candidates(text)], text
    for run in ("a." * 50_000, "a-" * 50_000, "x://" * 20_000, "a=" * 50_000, "x://" + "a" * 100_000):
        secret_scan.candidates(run)
    model = secret_scan.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    docs = spark.createDataFrame([(k, t, "src0") for k, (t, _) in enumerate(cases)], "doc_id long, text string, source string")
    for r in secret_scan.redact(docs, model).collect():
        text, value = cases[r.doc_id]
        assert r.text == text.replace(value, "[SECRET]")


# ---- pages


def labels_score(chain, page):
    rows = chain.potentials(page)
    best = None
    for k in range(2 ** len(page)):
        y = [k >> t & 1 for t in range(len(page))]
        s = chain.move[2][y[0]] + sum(rows[t][y[t]] for t in range(len(y))) + sum(chain.move[a][b] for a, b in zip(y, y[1:], strict=False))
        if best is None or s > best[0] + 1e-9:
            best = (s, y)
    return best[1]


@pytest.fixture(scope="module")
def chain(spark):
    return html_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def test_decoding_is_the_best_path(spark, chain):
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(20).collect():
        page = html_text.blocks(r.html)[:9]
        if page:
            assert chain.decode(page) == labels_score(chain, page)


def test_main_text_of_the_pages(spark, chain):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    text = {r.page_id: r.text for r in html_text.extract(rows, chain).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert text[r.page_id] == "\n\n".join(p for p in parts if p)


def test_blocks_of_odd_markup():
    page = "<p>a<b>b</b> &amp; c<br>d<p>e<ul><li>f<li>g</ul><script>x<y</script><!-- <p>no -->h &lt 3 < 4<div>i</p>j<div class='k\">l"
    assert [b.text for b in html_text.blocks(page)] == ["ab & c d", "e", "f", "g", "h < 3 < 4", "ij", "l"]
    assert html_text.blocks("") == [] and html_text.blocks("<style>a") == [] and [b.text for b in html_text.blocks("plain &amp text")] == ["plain & text"]
    assert html_text.blocks("<a \"" * 3000) == []


def test_pages_edges(spark, chain):
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (1, "u", None)], "page_id long, url string, html string")
    got = html_text.extract(rows.selectExpr("*", "'t' AS text"), chain).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(rows.where("false"), chain).count() == 0
    assert all(r.text == "" for r in html_text.extract(rows, html_text.learn(rows.where("false"))).collect())
