"""What is scored once for many grid points, cells or rows equals scoring every one of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probewise.operators import cloud as CL
from probewise.operators import columns as C
from probewise.operators import envelope as E
from probewise.operators import profiles as P
from probewise.operators import slices as SL
from probewise.operators import surrogate as S
from probewise.plans import slices as plans
from probewise.plans.scorers import DOC_STAIRS, ORDER_STAIRS, ExpressionScorer, doc_stairs_shifted, interaction_scorer


@pytest.fixture(scope="module")
def orders(spark):
    """Values on edges, twins, a row without features; one column that hardly varies."""
    r = np.random.default_rng(8)
    qty = np.r_[r.integers(1, 300, 60) * 1.0, 15.5, 35.2, 110.25, 110.25]
    rows = pd.DataFrame({
        "row_id": np.r_[np.arange(63), 62], "qty": qty, "gross": np.r_[r.uniform(1e3, 6e5, 62), 60000.25, 60000.25],
        "avg_disc": np.r_[r.choice([0.0, 0.0305, 0.05, 0.0525, 0.07], 62), 0.0305, 0.0305],
        "tight": 5.0 + 1e-9 * np.r_[np.arange(63), 62], "is_test": False,
    })
    t = spark.createDataFrame(rows)
    none = t.limit(1).select(F.lit(99).cast("long").alias("row_id"), *[
        F.lit(None).cast("double").alias(c) for c in ("qty", "gross", "avg_disc")], F.lit(5.0).alias("tight"), F.lit(False).alias("is_test"))
    t = t.unionByName(none).localCheckpoint()
    return t, C.column_stats(t, ["qty", "gross", "avg_disc", "tight"]).localCheckpoint()


@pytest.fixture(scope="module")
def windows(spark):
    r = np.random.default_rng(5)
    words = np.r_[r.integers(1, 900, 10) * 1.0, 24.5]
    chars = np.r_[np.round(words[:10] * r.uniform(4, 11, 10)), 190.5]
    t = spark.createDataFrame(pd.DataFrame({
        "row_id": np.r_[np.arange(10), 3], "n_words": words, "n_chars": chars, "chars_per_word": chars / words, "is_test": False}))
    return SL.windowed(t, C.column_stats(t, ["n_words", "n_chars"]), "n_words", "n_chars").localCheckpoint()


def sorted_rows(df):
    pdf = df.toPandas()
    pdf = pdf[sorted(pdf.columns)]
    return pdf.sort_values(list(pdf.columns), ignore_index=True)


def test_steps_beside_edges_equal_the_whole_grid(orders):
    """few points of a curve are scored, and its summary is that of all of them."""
    t, stats = orders
    names = ORDER_STAIRS.features
    sweeps = P.sweep_rows(t, stats, names, span=2.5)
    blind = ExpressionScorer(ORDER_STAIRS.template, names)
    got = sorted_rows(P.profile_summary(sweeps, ORDER_STAIRS, names))
    pd.testing.assert_frame_equal(got, sorted_rows(P.profile_summary(sweeps, blind, names)), check_exact=True)
    cut = sweeps.withColumn("_edges", P.edges_of(ORDER_STAIRS, names)).withColumn("_starts", P.piece_starts("_edges", 200))
    assert cut.select(F.max(F.size(P.with_ends("_starts")))).first()[0] <= 27


def test_a_grid_too_narrow_for_arithmetic_is_scored_whole(orders):
    t, stats = orders
    text = "CASE WHEN {tight} > 5.00000001e0 THEN 0.5e0 ELSE 0.1e0 END"
    sweeps = P.sweep_rows(t, stats, ["tight"], span=2.5)
    got, want = (
        sorted_rows(P.profile_summary(sweeps, ExpressionScorer(text, ["tight"], e), ["tight"], 40))
        for e in ({"tight": [5.00000001]}, None))
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_points_outside_the_band_are_counted_by_arithmetic(spark, orders):
    """with partners above, below and at zero, and none, and with bounds hit by a grid value."""
    t, stats = orders
    sweeps = P.sweep_rows(t, stats, ["qty", "tight"], span=2.5)
    partners = F.explode(F.array(*[F.lit(v) for v in (1.0, 2.0, 0.5, -3.0, 0.0, None)]))
    bands = F.explode(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in (
        (5.0, 60.0), (-50.0, -4.0), (1.0, 1e9), (-1e300, 1e300), (5.0, 5.0))]))
    sweeps = sweeps.withColumn("partner", partners).withColumn("b", bands).select("*", "b.low", "b.high").withColumn("key", F.monotonically_increasing_id()).localCheckpoint()
    got = {r.key: r.n_out for r in E.count_outside(sweeps, 120, "partner", "low", "high").collect()}
    out = E.outside(F.col("z"), F.col("partner"), F.col("low"), F.col("high")).cast("long")
    want = {r.key: r.n for r in P.grid_points(sweeps, 120).groupBy("key").agg(F.sum(out).alias("n")).collect()}
    assert got == want and None in got.values() and max(v or 0 for v in got.values()) == 120


def test_rows_alike_to_the_scorer_share_their_curve(orders):
    """bundles and ranges of classes of rows, weighted, equal those of the rows."""
    t, stats = orders
    ends = {"lo": F.col("st.qty_min"), "hi": F.col("st.qty_max")}
    for scorer in (ORDER_STAIRS, interaction_scorer("0.5e0")):
        whole = P.slope_points(C.attach(t, stats).withColumns(ends).withColumn("k", F.lit(1)), scorer, ["qty"], 40)
        cells = P.alike(t, scorer, ["qty"])
        few = P.slope_points(C.attach(cells, stats).withColumns(ends).withColumn("k", F.lit(1)), scorer, ["qty"], 40)
        got, want = sorted_rows(P.bundle_summary(few, ["k"], "weight")), sorted_rows(P.bundle_summary(whole, ["k"]))
        pd.testing.assert_frame_equal(got, want, rtol=0, atol=1e-12)
        # the twin rows of one id are one curve
        assert cells.agg(F.sum("weight"), F.sum("curves")).first()[:] == (65, 64)
    assert P.alike(t, interaction_scorer("0.5e0"), ["qty"]).count() <= 4


def test_rectangles_of_a_surface_equal_its_cells(windows, monkeypatch):
    """the surface by its pieces, on and off the edges, and twin rows."""
    monkeypatch.setattr(plans, "_windows", lambda spark, sf_dir: (windows, None))
    got = {r.row_id: r for r in plans.slice_2d(None, None).collect()}
    grid = SL.cells(windows, plans.NX, plans.NY).withColumn("p", DOC_STAIRS.column({"n_words": "zx", "n_chars": "zy"}))
    want = grid.groupBy("row_id").agg(F.count(F.lit(1)).alias("cells"), F.avg("p").alias("mean"), F.min("p").alias("lo"),
                                      F.max("p").alias("hi"), F.sum((F.col("p") >= 0.5).cast("long")).alias("positive"))
    for r in want.collect():
        g = got.pop(r.row_id)
        assert (g.cells, g.positive) == (r.cells, r.positive) and g.mean_p == pytest.approx(r.mean, abs=1e-6)
        assert (g.min_p, g.max_p) == (pytest.approx(r.lo, abs=1e-6), pytest.approx(r.hi, abs=1e-6))
    assert not got
    few = plans._rectangles(None, None, {"x": ("n_words", plans.NX), "y": ("n_chars", plans.NY)})
    assert few.count() < 11 * 150


@pytest.mark.parametrize("n", [60, 25])
def test_nearest_contour_cell_is_among_few(windows, n):
    """The distance to the contour is that over all cells, to the last bit."""
    seeded = windows.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(3), F.lit(11))))
    for scorer in (DOC_STAIRS, doc_stairs_shifted("seed")):
        few = plans._contour_cells(seeded, scorer, n, n)
        whole = SL.with_neighbours(SL.cells(seeded, n, n), scorer, "n_words", "n_chars", n, n)
        got, want = (sorted_rows(g.groupBy("row_id", "seed").agg(F.min(SL.edge_distance("n_words", "n_chars")).alias("d")))
                     for g in (few, whole))
        pd.testing.assert_frame_equal(got, want, check_exact=True)
        assert got["d"].notna().any() and few.count() < whole.count()


def test_variants_side_by_side_are_those_apart(spark):
    """one row holds both fits; what was gathered by a grouping before comes out of the task."""
    r = np.random.default_rng(4)
    z = r.normal(size=(300, 3))
    cloud = CL.SharedCloud(["a", "b", "c"], [1, 2], [z, z[::-1]], [z[:, 0] * 0.1, z[:, 1] * 0.2])
    x = r.normal(size=(40, 3))
    rows = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(40), "z_a": x[:, 0], "z_b": x[:, 1], "z_c": x[:, 2], "p": 0.5}))
    apart = {(e.row_id, e.seed, e.variant): e for e in S.explain(rows, cloud, 2, ("kernel", "uniform"), False).collect()}
    beside = S.explain_beside(rows, cloud, 2, ("kernel", "uniform"), False).collect()
    assert len(beside) == 80 and len(apart) == 160
    for e in beside:
        for v in ("kernel", "uniform"):
            one = apart[e.row_id, e.seed, v]
            assert list(e[f"{v}_kept"]) == list(one.kept) and e[f"{v}_coef"] == pytest.approx(one.coef, abs=1e-12)
            assert e[f"{v}_g"] == pytest.approx(one.g, abs=1e-12) and e[f"{v}_r2"] == pytest.approx(one.r2, abs=1e-12)
