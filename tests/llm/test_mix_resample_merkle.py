"""Mixing, importance resampling and the Merkle manifest against plain versions of themselves."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probewise.llm import merkle, mixing, ordering, resample

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


# ---- order


def test_places_and_sums_equal_a_sort(spark):
    rng = np.random.default_rng(3)
    rows = [(None if g == 3 else int(g), int(v), int(a)) for g, v, a in zip(rng.choice(5, 3000, p=[0.7, 0.1, 0.1, 0.05, 0.05]), rng.integers(0, 40, 3000), rng.integers(0, 9, 3000))]
    rows += [(9, 1, 1)] * 500
    df = spark.createDataFrame(rows, "g int, v int, a int")
    extra = spark.createDataFrame([(None, "none"), (0, "zero")], "g int, name string")
    got = ordering.placed(df, [F.col("v"), F.col("a")], ["g"], amount="a", extra=extra).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    assert len(got) == len(rows)
    for g, found in by.items():
        found.sort(key=lambda r: r.at)
        assert [r.at for r in found] == list(range(len(found)))
        assert [(r.v, r.a) for r in found] == sorted((v, a) for k, v, a in rows if k == g)
        total = 0
        for r in found:
            assert (r.before, r.group_rows, r.name) == (total, len(found), {None: "none", 0: "zero"}.get(g))
            total += r.a
        assert found[0].group_amount == total


# ---- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout=2):
    """Root, and each leaf's siblings from the leaf up."""
    level, places, proofs = list(leaves), list(range(len(leaves))), ["" for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        proofs = [p + "".join(x for k, x in enumerate(runs[at // fanout]) if k != at % fanout) for p, at in zip(proofs, places)]
        places = [at // fanout for at in places]
        level = [digest(*run) for run in runs]
    return (level or [None])[0], proofs


def first_null(v):
    return (v is not None, v if v is not None else 0)


def plain_manifest(rows, fanout=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((first_null(r["doc_id"]), plain_leaf([r[c] for c in COLUMNS]), r["doc_id"]))
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: plain_tree([x[1] for x in sorted(groups[k])], fanout) for k in langs}
    root, over = plain_tree([trees[k][0] for k in langs], fanout)
    out = []
    for k, rest in zip(langs, over):
        for (_, leaf, doc_id), proof in zip(sorted(groups[k]), trees[k][1]):
            out.append((doc_id, leaf, trees[k][0], root, digest(proof, rest)))
    return Counter(out)


def mine(rows, fanout=2):
    made = merkle.manifest(rows, COLUMNS, "lang", "doc_id", fanout=fanout)
    made = made.withColumn("proof", merkle.proof_digest("path")).withColumn("fold", merkle.folded("leaf", "path"))
    got = made.collect()
    assert all(r.fold == r.root for r in got)
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_of_edge_rows(edge_docs, fanout):
    rows = [r.asDict() for r in edge_docs.collect()]
    assert mine(edge_docs, fanout) == plain_manifest(rows, fanout)


def test_manifest_over_several_blocks_and_a_run_of_equal_rows(spark):
    rows = [(i if i % 50 else None, "s", "en" if i % 3 else ("" if i % 2 else None), i, f"text {i}") for i in range(1500)]
    rows += [(7, "s", "en", 1, "same")] * 600 + [(1, None, "zz", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert mine(df) == plain_manifest([r.asDict() for r in df.collect()])


def test_manifest_of_one_group_and_of_none(spark, edge_docs, empty_docs):
    one = edge_docs.where("doc_id = 3")
    row = merkle.manifest(one, COLUMNS, "lang", "doc_id").first()
    assert row.leaf == row.subroot == row.root and row.path == []
    assert merkle.manifest(empty_docs, COLUMNS, "lang", "doc_id").count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(one, COLUMNS, "lang", "doc_id", fanout=1)


def test_a_changed_row_does_not_fold_to_the_root(edge_docs):
    changed = merkle.leaf_digest([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    made = merkle.manifest(edge_docs, COLUMNS, "lang", "doc_id", carry={"changed": changed})
    for r in made.withColumn("fold", merkle.folded("changed", "path")).collect():
        assert (r.fold == r.root) == (r.changed == r.leaf)
    assert made.where("changed = leaf").count() == edge_docs.where("n_chars IS NULL").count() == 2


# ---- importance resampling


def plain_features(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    scanned = [(d, *plain_features(t)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in scanned for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x)[1])
    s_all, t_all = s.total() + 10000.0, t.total() + 10000.0
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in range(10000)}
    rows = []
    for d, n, fs in scanned:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append((d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = defaultdict(list)
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        ranks[r].append(k + 1)
    return Counter((*r, ranks[r].pop() if ranks[r] else None) for r in rows)


def resampled(docs, target):
    return Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(docs, target).collect())


def test_resampling_equals_counting(spark, edge_docs):
    rng = np.random.default_rng(1)
    made = [(100 + i, " ".join(rng.choice(["alpha", "Beta", "gamma-ray", "zwölf", "漢字", "7"], rng.integers(1, 60)))) for i in range(300)]
    made += [(100, made[0][1])] * 3 + [(None, made[5][1])]
    docs = edge_docs.select("doc_id", "text", "row", "score").union(spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'r'", "'s'"))
    target = spark.createDataFrame([("alpha beta gamma",), ("zwölf 7!",), (None,), ("",)], "text string")
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert resampled(docs, target) == want


def test_resampling_of_empty_tables(edge_docs, empty_docs):
    assert resample.resample(empty_docs, edge_docs).count() == 0
    want = plain_resample([(r.doc_id, r.text) for r in edge_docs.collect()], [])
    assert resampled(edge_docs, empty_docs) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB9 .-_é漢\n\x00{", max_size=40))
def test_scans_yield_every_run_of_words(text):
    n, found = resample.Scanner(10000, 3)(text.encode())
    words, want = plain_features(text)
    assert n == words and sorted(found.tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in want)


# ---- mixing


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_flow_is_largest_and_cheapest(data):
    sizes = data.draw(st.lists(st.integers(0, 2), min_size=1, max_size=3))
    quotas = data.draw(st.lists(st.integers(0, 4), min_size=1, max_size=2))
    links = sorted(data.draw(st.sets(st.tuples(st.integers(0, len(sizes) - 1), st.integers(0, len(quotas) - 1)), max_size=4)))
    flow = mixing.route(sizes, quotas, links, [0, 1])

    def judged(f):
        used, got = [0] * len(sizes), [0] * len(quotas)
        for (p, s), x in zip(links, f):
            used[p] += x
            got[s] += x
        if any(u > 2 * n for u, n in zip(used, sizes)) or any(g > q for g, q in zip(got, quotas)):
            return None
        return sum(f), -sum(max(0, u - n) for u, n in zip(used, sizes))

    best = max(j for f in product(*[range(2 * sizes[p] + 1) for p, _ in links]) if (j := judged(f)))
    assert judged([round(x) for x in flow]) == best and all(abs(x - round(x)) < 1e-6 for x in flow)


def totals(rows):
    got, aim = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(p["words"] for p in r.parts or [])
        for s in r.sources or []:
            aim[s["name"]] = s["target"]
        for p in r.parts or []:
            got[p["name"]] += p["words"]
    return got, aim


def test_overlapping_sources_meet_their_targets(spark):
    rng = np.random.default_rng(2)
    sets = [["a"], ["a", "b"], ["b", "c"], ["c", None], ["d"], ["b", "b"], ["a", "c", "d"]]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 50))), sets[i % 7]) for i in range(800)]
    rows += [(800, "left over", []), (801, "left over", None), (801, None, ["a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    found = mixing.mix(df, F.col("of")).collect()
    got, aim = totals(found)
    assert len(found) == 803 and set(aim) == {"a", "b", "c", "d", None}
    assert all(abs(got[k] - aim[k]) <= 3 for k in aim)
    assert all(r.taken == 0 for r in found if not r.sources)
    # the sources hang together, and fresh words suffice for 90 % of all: nothing is taken twice
    once, least = totals(mixing.mix(df, F.col("of"), weights=(1,), share_percent=90).collect())
    assert all(abs(once[k] - least[k]) <= 3 for k in least)
    again = mixing.mix(df.repartition(5), F.col("of")).collect()
    key = lambda r: (r.doc_id, r.taken, str(r.parts))
    assert sorted(map(key, found)) == sorted(map(key, again))


def plain_targets(sizes, weights, budget):
    full, unit = set(), 0.0
    while True:
        open_ = [k for k in sizes if k not in full]
        if not open_:
            break
        unit = (budget - sum(2 * sizes[k] for k in full)) / sum(weights[k] for k in open_)
        new = {k for k in open_ if 2 * sizes[k] <= unit * weights[k]}
        if not new:
            break
        full |= new
    return {k: 2 * sizes[k] if k in full else unit * weights[k] for k in sizes}


def test_mixing_of_edge_rows(edge_docs, empty_docs):
    docs = edge_docs.drop("row").withColumn("pattern", F.lit(1)).withColumn("before", F.lit("x"))
    found = mixing.mix(docs, F.array("source")).collect()
    rows = docs.collect()
    size = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows)
    assert Counter((r.doc_id, r["size"]) for r in found) == size
    by = Counter()
    for r in rows:
        by[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted(by, key=lambda k: (k is None, k or ""))
    weights = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    got, aim = totals(found)
    want = plain_targets(by, weights, 1.5 * by.total())
    assert all(abs(aim[k] - want[k]) < 1e-6 and abs(got[k] - want[k]) <= 0.5 for k in names)
    assert mixing.mix(empty_docs, F.array("source")).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["size"], r.taken) for r in mixing.mix(blank, F.array("source")).collect()} == {(0, 0)}


def test_costs_must_not_fall(edge_docs):
    with pytest.raises(ValueError):
        mixing.mix(edge_docs, F.array("source"), costs=[2, 1])
