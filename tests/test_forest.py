"""Forests grown on cells: the rules of Spark ML's, whatever the partitions and wherever nodes go to tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from probewise.operators import models as M
from probewise.operators.forest import ForestFit, grow, split_points
from probewise.operators.trees import Trees, forest_nodes

COLUMNS = ["a", "b", "c"]


def rows(n=3000, seed=5):
    r = np.random.default_rng(seed)
    x = np.stack([r.lognormal(5, 1, n).round(), r.normal(0, 1, n).round(2), r.integers(0, 9, n)], 1).astype(float)
    y = (np.log(x[:, 0]) - 5 + x[:, 1] * np.sign(x[:, 2] - 4) + 0.5 * r.normal(size=n) > 0).astype(int)
    return pd.DataFrame(x, columns=COLUMNS).assign(label=y)


def fit(spark, pdf, parts=4, cells=65536, trees=12):
    df = spark.createDataFrame(pdf.assign(features=pdf[COLUMNS].to_numpy().tolist())[["label", "features"]]).repartition(parts)
    return ForestFit(df, len(pdf), 3, trees, 3, 30, 64, cells)


def test_rows_of_a_leaf_and_gain_follow_the_rules(spark):
    nodes = fit(spark, rows()).nodes(3)
    leaf, inner = nodes[nodes.feature < 0], nodes[nodes.feature >= 0]
    assert (leaf.n0 + leaf.n1 >= 3).all()
    at = nodes.set_index(["tree", "id"])
    for side in ("left", "right"):
        assert (inner[side] > inner.id).all()
    l, r = (at.loc[list(zip(inner.tree, inner[s]))] for s in ("left", "right"))
    assert (l.n0.to_numpy() + r.n0.to_numpy() == inner.n0.to_numpy()).all()
    # leaves of one parent that predict one class are merged
    twins = (l.feature.to_numpy() < 0) & (r.feature.to_numpy() < 0)
    assert ((l.n1 > l.n0).to_numpy() != (r.n1 > r.n0).to_numpy())[twins].all()


def test_no_dependence_on_partitions(spark):
    one, two = (fit(spark, rows(), p).nodes(3) for p in (1, 7))
    pd.testing.assert_frame_equal(one, two)


def test_nodes_split_from_histograms_hold_the_same_rows(spark):
    """A node limit of 200 cells sends most upper nodes through summed histograms."""
    pdf = rows()
    whole, parted = fit(spark, pdf), fit(spark, pdf, cells=200)
    a, b = whole.nodes(3), parted.nodes(3)
    root = lambda n: n[n.id == 0][["n0", "n1"]].to_numpy()
    assert (root(a) == root(b)).all()
    x, y = pdf[COLUMNS].to_numpy(), pdf["label"].to_numpy()
    p, q = (Trees([forest_nodes(n)]).score(x)[:, 0] for n in (a, b))
    assert ((p > 0.5) == y).mean() > 0.85 and ((q > 0.5) == y).mean() > 0.85
    assert np.corrcoef(p, q)[0, 1] > 0.9
    at = b.set_index(["tree", "id"])
    inner = b[b.feature >= 0]
    l, r = (at.loc[list(zip(inner.tree, inner[s]))] for s in ("left", "right"))
    assert (l.n1.to_numpy() + r.n1.to_numpy() == inner.n1.to_numpy()).all()


def test_a_tree_splits_at_the_greatest_gain():
    bins = np.array([[0, 1], [1, 0], [2, 1], [3, 0]], np.uint8)
    w = np.array([[5, 0], [5, 0], [0, 5], [0, 5]])
    t = grow(bins, w, [1], 0, 2, 3, 30)
    assert t.column.tolist() == [0, -1, -1] and t.bin[0] == 1
    assert grow(bins, w, [1], 0, 2, 11, 30).column.tolist() == [-1]


def test_cuts_of_few_and_of_many_values():
    assert split_points(np.array([1.0, 2.0, 4.0]), np.ones(3), 256).tolist() == [1.5, 3.0]
    assert len(split_points(np.arange(1000.0), np.ones(1000), 16)) == 15


def test_as_good_as_spark_ml(spark, monkeypatch):
    pdf = rows(2500)
    train, test = spark.createDataFrame(pdf[:1500]), rows(1500, 6)
    monkeypatch.setattr(M, "FOREST_TREES", 30)
    assert M.SPARK_FOREST_ROWS < 1500
    mine = M.forests([train], COLUMNS, [42])
    theirs = M.fit_nodes([("spark", M.forest(COLUMNS, trees=30), train)])[0]
    x, y = test[COLUMNS].to_numpy(), test["label"].to_numpy()
    p, q = mine.score(x)[:, 0], Trees([theirs]).score(x)[:, 0]
    assert abs(((p > 0.5) == y).mean() - ((q > 0.5) == y).mean()) < 0.03
    assert np.corrcoef(p, q)[0, 1] > 0.95
    ranks = lambda n: [r.feature for r in M.importances(n, COLUMNS, spark).orderBy("rank").collect()]
    assert ranks(theirs) == ranks(M.fit_forests([train], COLUMNS, [42])[0])


def test_importances_are_spark_mls(spark):
    train = spark.createDataFrame(rows(400))
    model = M.forest(COLUMNS, trees=10).fit(train)
    nodes = M.fit_nodes([("importances", M.forest(COLUMNS, trees=10), train)])[0]
    got = {r.feature: r.importance for r in M.importances(nodes, COLUMNS, spark).collect()}
    want = dict(zip(COLUMNS, model.stages[-1].featureImportances.toArray()))
    assert got == pytest.approx(want, abs=1e-9)


def test_above_the_limit_no_histogram_is_summed_per_node(spark, monkeypatch):
    """Spark ML's own forest isn't fitted to more rows than the limit."""
    monkeypatch.setattr(M, "fit_nodes", lambda jobs: pytest.fail("Spark ML's forest was fitted"))
    monkeypatch.setattr(M, "FOREST_TREES", 5)
    assert len(M.fit_forests([spark.createDataFrame(rows(1400, 9))], COLUMNS, [7])) == 1
