"""Forests that stay a table: the same scores, curves and distances as from arrays on the driver, to the last bit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.operators import models as M
from probewise.operators import stored as ST
from probewise.operators.forest import ForestFit
from probewise.operators.stored import StoredScorer, StoredTrees
from probewise.operators.trees import TreeScorer
from probewise.plans import models as PM

COLUMNS = ["a", "b", "c"]


def rows(n, seed):
    r = np.random.default_rng(seed)
    x = np.stack([r.lognormal(5, 1, n).round(), r.normal(0, 1, n).round(2), r.integers(0, 9, n)], 1).astype(float)
    y = (np.log(x[:, 0]) - 5 + x[:, 1] * np.sign(x[:, 2] - 4) + 0.5 * r.normal(size=n) > 0).astype(int)
    return pd.DataFrame(x, columns=COLUMNS).assign(label=y, row_id=np.arange(n))


@pytest.fixture(scope="module")
def both(spark):
    """Two seeds of one table as arrays and as a table."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(M, "FOREST_TREES", 12)
        train = spark.createDataFrame(rows(1500, 3))
        near = M.tree_scorer(train, COLUMNS, [1, 2])
        m.setattr(M, "NODES_ON_DRIVER", 0)
        far = M.tree_scorer(train, COLUMNS, [1, 2])
    assert isinstance(near, TreeScorer) and isinstance(far, StoredScorer)
    return near, far


def probes(spark, n=60):
    """Rows with missing and repeated values and ids, and an ascending grid of one column each."""
    pdf = rows(n, 8).drop(columns="label").astype(object)
    pdf.loc[0, "a"] = pdf.loc[1, "c"] = pdf.loc[2, "row_id"] = None
    pdf.loc[4] = pdf.loc[3]
    df = spark.createDataFrame(pdf.where(pdf.notna(), None), "a double, b double, c double, row_id long")
    at = lambda k, lo, hi: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.lit(lo) + i * (hi - lo) / (k - 1))
    return df.withColumns({"za": at(19, -3.0, 900.0), "zb": at(13, -2.5, 2.5), "std_a": F.lit(180.0), "std_b": F.lit(1.0)})


def same(a: DataFrame, b: DataFrame) -> None:
    assert a.columns == b.columns
    one, two = (sorted(map(repr, d.collect())) for d in (a, b))
    assert one == two and len(one)


def test_scores(spark, both, monkeypatch):
    monkeypatch.setattr(ST, "BLOCK_CODES", 16)
    monkeypatch.setattr(ST, "GROUP_TREES", 5)
    df = probes(spark).withColumn("m", F.coalesce(F.col("row_id") % 2, F.lit(1)).cast("int"))
    same(*[s.score(df, model=F.col("m")) for s in both])
    same(*[s.score(df) for s in both])


def test_curves_of_two_columns(spark, both, monkeypatch):
    monkeypatch.setattr(ST, "ROWS_PER_TASK", 3)
    df = probes(spark).withColumn("feature", F.when(F.col("b") > 0, "a").otherwise("b")).withColumn("z", F.transform("zb", lambda v: v * 100))
    same(*[s.curves(df, "feature", "z", "p", ["a", "b"]) for s in both])


def test_spread_over_seeds(spark, both):
    same(*[s.seed_spread(probes(spark), "za", "a", "w") for s in both])


def test_distances_to_the_boundary(spark, both):
    same(*[s.boundary_distances(probes(spark), "a", "b", "za", "zb", "std_a", "std_b", "d") for s in both])
    # a window of one point has no edge
    df = probes(spark).withColumns({c: F.transform(c, lambda v: F.lit(5.0)) for c in ("za", "zb")})
    same(*[s.boundary_distances(df, "a", "b", "za", "zb", "std_a", "std_b", "d") for s in both])


def test_models_of_several_tables(spark, monkeypatch):
    """Each has cuts of its own; the smallest table's forest is Spark ML's."""
    monkeypatch.setattr(M, "FOREST_TREES", 6)
    trains = [spark.createDataFrame(rows(n, n)) for n in (1200, 300, 1100)]
    near = M.forests(trains, COLUMNS, [42] * 3)
    monkeypatch.setattr(M, "NODES_ON_DRIVER", 0)
    far = M.forests(trains, COLUMNS, [42] * 3)
    assert isinstance(far, StoredTrees) and far.models == 3
    df = probes(spark).withColumn("m", F.coalesce(F.col("row_id") % 3, F.lit(1)).cast("int"))
    same(*[M.scorer_of(spark, t, COLUMNS).score(df, model=F.col("m")) for t in (near, far)])
    df = df.withColumn("feature", F.lit("a"))
    for k in range(3):
        same(*[M.scorer_of(spark, t.only(k), COLUMNS).curves(df, "feature", "za", "p", ["a"]) for t in (near, far)])
    same(*[M.scorer_of(spark, t, COLUMNS).curves(df, "feature", "za", "p", ["a"], "m") for t in (near, far)])
    # cuts that differ have no lattice in common
    same(*[M.scorer_of(spark, t, COLUMNS).curves(df, "feature", "za", "p", ["a"]) for t in (near, far)])


def test_no_tree_comes_to_the_driver(spark, monkeypatch):
    """What the queries with refits, folds and strengths need is read by tasks alone."""
    monkeypatch.setattr(M, "FOREST_TREES", 5)
    monkeypatch.setattr(M, "NODES_ON_DRIVER", 0)
    monkeypatch.setattr(M, "SPARK_FOREST_ROWS", 10)
    for at in (M, ST):
        monkeypatch.setattr(at, "on_driver", lambda *_: pytest.fail("nodes were collected"))
    monkeypatch.setattr(ForestFit, "nodes", lambda *_: pytest.fail("nodes were collected"))
    for name in ("cp_seed_forest", "oof_scores", "oof_accuracy_by_band", "interaction_forest"):
        assert PM.QUERIES[name](spark, SF).count()
    assert PM.boundary_seeds(spark, SF, 12, 11).count()


SF = "/root/testdata/sf0.001"
