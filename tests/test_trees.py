"""Fitted trees as data: the same scores as Spark ML, along sweeps, over planes and as SQL text."""

from __future__ import annotations

import numpy as np
import pytest
from compare import connect, difference
from conftest import SF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from oracles import models as OM
from probewise.operators import columns as C
from probewise.operators import models as M
from probewise.operators.trees import Trees, TreeScorer, read_nodes
from probewise.plans import models as PM

DOCS = PM.DOCS


@pytest.fixture(scope="module")
def docs(spark):
    return PM._docs(spark, SF)


@pytest.fixture(scope="module")
def fitted(docs):
    """A forest of 40 trees and a boosted model, as Spark ML has them."""
    train = PM._train(docs)
    return {"forest": M.forest(DOCS, 3, trees=40).fit(train), "boosted": M.boosted(DOCS).fit(train)}


def rows_of(docs):
    return docs.select("row_id", *DOCS).toPandas()


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_scores_equal_spark_ml(spark, docs, fitted, kind):
    trees = Trees([read_nodes(fitted[kind].stages[-1], spark)])
    spark_p = fitted[kind].transform(docs).select("row_id", vector_to_array("probability")[1].alias("ml"))
    scored = TreeScorer(spark, trees, DOCS).score(docs).join(spark_p, "row_id")
    assert scored.count() == docs.count()
    assert scored.where(F.abs(F.col("p") - F.col("ml")) > 1e-9).count() == 0


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_sql_text_equals_the_arrays_in_both_engines(spark, docs, fitted, kind):
    trees = Trees([read_nodes(fitted[kind].stages[-1], spark)])
    expression = trees.expression(DOCS)
    x = rows_of(docs)
    want = trees.score(x[DOCS].to_numpy())[:, 0]
    mine = expression.score(docs).select("row_id", "p").toPandas().set_index("row_id").p
    con = connect(SF)
    con.register("x", x)
    theirs = con.execute(f"SELECT row_id, {expression.sql()} AS p FROM x").fetchdf().set_index("row_id").p
    assert np.abs(mine[x.row_id].to_numpy() - want).max() < 1e-15
    assert np.abs(theirs[x.row_id].to_numpy() - want).max() < 1e-15


def both(spark, fitted):
    forest = read_nodes(fitted["forest"].stages[-1], spark)
    return forest, Trees([forest[forest.tree < 20], forest[forest.tree >= 20].assign(tree=lambda d: d.tree - 20)])


def test_curves_equal_scoring_every_point(spark, docs, fitted):
    _, trees = both(spark, fitted)
    x = rows_of(docs)[DOCS].to_numpy()[:30]
    # ends, repeated points and points on thresholds
    cuts = trees.cuts[1]
    z = np.sort(np.concatenate([np.linspace(x[:, 1] - 90, x[:, 1] + 90, 40).T, np.tile([*cuts[:5], cuts[0]], (30, 1))], 1), 1)
    got = trees.curves(x, 1, z)
    for i in range(z.shape[1]):
        at = x.copy()
        at[:, 1] = z[:, i]
        assert (trees.score(at) == got[:, :, i]).all()


def test_planes_equal_scoring_every_cell(spark, docs, fitted):
    _, trees = both(spark, fitted)
    x = rows_of(docs)[DOCS].to_numpy()[:6]
    zx, zy = np.linspace(x[:, 1] - 200, x[:, 1] + 300, 17).T, np.linspace(x[:, 0] - 900, x[:, 0] + 900, 13).T
    for part, p in trees.surfaces(x, (1, 0), zx, zy):
        for i in range(17):
            for j in range(13):
                at = x[part].copy()
                at[:, 1], at[:, 0] = zx[part, i], zy[part, j]
                assert (trees.score(at) == p[:, :, i, j]).all()


def test_one_model_of_several(spark, docs, fitted):
    nodes, trees = both(spark, fitted)
    x = rows_of(docs)[DOCS].to_numpy()
    assert (trees.only(1).score(x)[:, 0] == trees.score(x)[:, 1]).all()
    boxes = trees.leaf_boxes(DOCS)
    assert len(boxes) == int((nodes.feature < 0).sum())
    row = x[3]
    inside = np.logical_and.reduce([(boxes[f"{f}_above"] < v) & (v <= boxes[f"{f}_upto"]) for f, v in zip(DOCS, row)])
    assert boxes[inside].groupby("model").value.sum().tolist() == [round(p * 20 * 2**40) for p in trees.score(x)[3]]


def test_a_single_leaf_and_an_empty_frame(spark, docs):
    flat = docs.withColumn("label", F.lit(1))
    nodes = read_nodes(M.forest(DOCS, 1, trees=3).fit(flat).stages[-1], spark)
    trees = Trees([nodes])
    scorer = TreeScorer(spark, trees, DOCS)
    assert {r.p for r in scorer.score(docs).select("p").collect()} == {1.0} or trees.score(np.zeros((1, 3)))[0, 0] in (0.0, 1.0)
    assert scorer.score(docs.where("false")).count() == 0
    assert trees.curves(np.zeros((2, 3)), 0, np.ones((2, 4))).shape == (2, 1, 4)


def leaves(name, spark, docs):
    """The leaves of the fit that the query used: the same rows and parameters give the stored fit."""
    if name in ("cp_seed_forest", "boundary_seeds"):
        scorer = M.tree_scorer(PM._train(docs), DOCS, list(range(M.SEEDS)))
    elif name.startswith("oof"):
        t = PM.materialise(C.kfold(PM._labelled(spark, SF)))
        return M.forests([t.where(F.col("fold") != k) for k in range(M.FOLDS)], DOCS, [42] * M.FOLDS).leaf_boxes(DOCS)
    elif name == "interaction_forest":
        return PM.interaction_tables(spark, SF)[1].leaf_boxes(DOCS)
    else:
        scorer = M.tree_scorer(PM._train(docs), DOCS)
    return scorer.shared.value.leaf_boxes(DOCS)


@pytest.mark.parametrize("name", sorted(OM.SQL_OVER_BOXES))
def test_query_equals_sql_over_its_leaves(spark, docs, name):
    mine = PM.QUERIES[name](spark, SF).toPandas()
    con = connect(SF)
    con.register("boxes", leaves(name, spark, docs))
    assert difference(mine, con.execute(OM.SQL_OVER_BOXES[name]).fetchdf()) is None


def test_boosted_scores_equal_sql_of_the_model(spark, docs):
    mine = PM.gbt_scores(spark, SF).toPandas()
    sql = OM.gbt_scores(M.boosted_scorer(PM._train(docs), DOCS))
    assert difference(mine, connect(SF).execute(sql).fetchdf()) is None


def test_boundaries_equal_sql_over_the_leaves(spark, docs):
    mine = PM.boundary_seeds(spark, SF, 12, 11).toPandas()
    con = connect(SF)
    con.register("boxes", leaves("boundary_seeds", spark, docs))
    assert difference(mine, con.execute(OM.boundary_seeds(12, 11)).fetchdf()) is None
    assert mine.n.max() == 12
