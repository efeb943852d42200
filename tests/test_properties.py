"""Brute force, identities and the micro tables that caught real mistakes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from probewise.functions.noise import normal
from probewise.functions.ranks import average_ranks, exact_quantiles, prefix_counts, spearman
from probewise.functions.student import two_sided
from probewise.operators import cloud as CL
from probewise.operators import columns as C
from probewise.operators import distance as D
from probewise.operators import envelope as E
from probewise.operators import profiles as P
from probewise.operators import slices as SL
from probewise.operators import surrogate as S
from probewise.plans import surrogate as plans
from probewise.plans.basics import auc_and_accuracy
from probewise.plans.scorers import DOC_STAIRS, ExpressionScorer, MLScorer, PandasScorer
from probewise.sources import tables as T

rng = np.random.default_rng(3)


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@pytest.fixture(scope="module")
def docs(spark):
    t = T.doc_features(spark, SF).cache()
    return t, C.column_stats(t, T.DOC_FEATURES)


# --- order statistics -------------------------------------------------------------------------


@pytest.mark.parametrize("values", [rng.normal(size=2001), rng.integers(0, 5, 500) * 1.0, np.zeros(40)])
def test_quantiles_are_exact(spark, values):
    qs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = exact_quantiles(frame(spark, v=values), "v", qs).first()["q"]
    assert np.allclose(got, np.quantile(values, qs), rtol=0, atol=1e-12)


def test_quantiles_by_key(spark):
    df = frame(spark, k=np.repeat(["a", "b"], [300, 7]), v=rng.normal(size=307))
    got = {r.k: r.q[0] for r in exact_quantiles(df, "v", [0.5], ["k"]).collect()}
    want = df.toPandas().groupby("k")["v"].median()
    assert got == pytest.approx(want.to_dict())


def test_spearman_of_hot_values_joins_no_value(spark):
    """One value on half the rows, over more partitions than other values; several groups at once."""
    from plain import spearman_of

    r = np.random.default_rng(6)
    x = np.where(r.random(4000) < 0.5, 7.0, np.round(r.normal(size=4000), 1))
    y = np.where(r.random(4000) < 0.5, -1.0, x + r.normal(size=4000))
    g = r.integers(0, 3, 4000)
    df = frame(spark, g=g, x=x, y=y)
    got = {r.g: r for r in spearman(df, "x", "y", ["g"]).collect()}
    for k in range(3):
        assert got[k].rho == pytest.approx(spearman_of(x[g == k], y[g == k]), abs=1e-12) and got[k].n == (g == k).sum()
    plan = spearman(df, "x", "y", ["g"])._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_part" in line for line in joins)
    flat = spearman(frame(spark, x=[1.0, 1.0, 1.0], y=[1.0, 2.0, 3.0]), "x", "y").first()
    assert flat.rho is None and flat.t is None


def test_far_rows_keep_an_effective_sample_size(spark):
    """A row 60 std out: every weight underflows, yet the sample size and variance are numbers."""
    from probewise.operators.cloud import SharedCloud

    z = np.random.default_rng(2).normal(size=(500, 2))
    cloud = SharedCloud(["a", "b"], (1,), z[None], (z[:, 0] > 0).astype(float)[None])
    rows = frame(spark, row_id=[0, 1], z_a=[0.0, 60.0], z_b=[0.0, 60.0], p=[0.5, 0.9])
    for own in (True, False):
        for r in S.kernel_summary(rows, cloud, include_self=own).collect():
            assert 1.0 <= r.ess <= 501 and 0.0 <= r.wvar <= 0.26
    r2 = {r.row_id: r.r2 for r in S.explain(rows, cloud, 1).collect()}
    assert r2[0] is not None and r2[1] is None


def test_average_ranks_and_spearman_with_ties(spark):
    x, y = rng.integers(0, 9, 400) * 1.0, rng.integers(0, 4, 400) * 1.0
    rx, ry = pd.Series(x).rank(), pd.Series(y).rank()
    got = average_ranks(frame(spark, v=x), "v").toPandas().set_index("v")["rank"]
    assert all(got[v] == r for v, r in zip(x, rx))
    rho = spearman(frame(spark, x=x, y=y), "x", "y").first()["rho"]
    assert rho == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-12)


def test_hot_value_is_one_row_before_the_shuffle(spark):
    df = frame(spark, v=np.r_[np.zeros(5000), np.arange(1, 20.0)])
    assert prefix_counts(df, "v").count() == 20


def test_auc(spark):
    p, y = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    got = auc_and_accuracy(frame(spark, p=p, label=y.astype("int32"))).first()
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert got["auc"] == pytest.approx(wins, abs=1e-6)
    assert got["accuracy"] == pytest.approx(((p >= 0.5) == y).mean(), abs=1e-6)


def test_student_p_value():
    assert two_sided(0.0, 10) == pytest.approx(1.0)
    assert two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)


def test_noise_ignores_partitioning(spark):
    one = spark.range(0, 500, 1, 1).select("id", normal(7, F.col("id"), F.lit("f")).alias("z"))
    many = spark.range(0, 500, 1, 16).select("id", normal(7, F.col("id"), F.lit("f")).alias("z"))
    assert one.exceptAll(many).count() == 0
    z = one.toPandas()["z"]
    assert abs(z.mean()) < 0.15 and abs(z.std(ddof=0) - 1) < 0.1


def test_split_is_exact_and_stratified(spark):
    df = frame(spark, row_id=np.arange(1000), label=(np.arange(1000) < 130).astype("int32"),
               is_test=np.zeros(1000, bool))
    got = C.stratified_split(df).groupBy("label").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()
    assert {r.label: r.n for r in got} == {0: 218, 1: 33}
    folds = C.kfold(df).groupBy("label", "fold").count().toPandas()
    assert (folds.groupby("label")["count"].agg(np.ptp) <= 1).all()


# --- distances --------------------------------------------------------------------------------


@pytest.mark.parametrize("cell_rows", [8, 10_000])
@pytest.mark.parametrize("exclude", [True, False])
def test_nearest_is_brute_force(spark, monkeypatch, cell_rows, exclude):
    monkeypatch.setattr(D, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(D, "PROBES_PER_TASK", 50)
    ref = np.r_[rng.normal(size=(300, 3)), np.tile([[0.5, 0.5, 0.5]], (60, 1)), [[40.0, -3.0, 9.0]]]
    ids = np.arange(len(ref))
    probe = np.r_[ref, rng.normal(size=(200, 3)) * 4]
    own = np.r_[ids, rng.integers(0, len(ref), 200)]
    cols = lambda a: {f"x{i}": a[:, i] for i in range(3)}
    refs = frame(spark, row_id=ids, **cols(ref))
    probes = frame(spark, row_id=own, n=np.arange(len(probe)), **cols(probe))
    got = D.nearest(probes, D.Space(refs, ["x0", "x1", "x2"]), ["n"], exclude).toPandas().sort_values("n")
    d = np.linalg.norm(probe[:, None] - ref[None], axis=2)
    if exclude:
        d[own[:, None] == ids[None]] = np.inf
    assert len(got) == len(probe)
    assert np.allclose(got["d"], d.min(axis=1), atol=1e-12)
    named = got["id"].to_numpy()
    assert np.allclose(d[np.arange(len(probe)), named], d.min(axis=1), atol=1e-12)
    assert exclude or list(named) == list(d.round(12).argmin(axis=1))


def test_self_in_reference_never_exceeds_the_move(spark):
    """With the row left in, the distance is at most its own displacement: no evidence."""
    ref = frame(spark, row_id=[0, 1], x0=[0.0, 50.0], x1=[0.0, 50.0])
    probes = frame(spark, row_id=[0] * 5, k=list(range(5)), x0=[0.0, 1, 2, 3, 4], x1=[0.0] * 5)
    naive = D.nearest(probes, D.Space(ref, ["x0", "x1"]), ["k"], False).toPandas().sort_values("k")["d"]
    assert list(naive) == [0, 1, 2, 3, 4]
    loo = D.nearest(probes, D.Space(ref, ["x0", "x1"]), ["k"], True).toPandas()["d"]
    assert (loo > 60).all()


def test_whitening_is_mahalanobis(spark):
    a = rng.normal(size=(200, 2)) @ np.array([[1.0, 0.9], [0.0, 0.3]])
    df = frame(spark, row_id=np.arange(200), x0=a[:, 0], x1=a[:, 1])
    m = D.whitening(df, ["x0", "x1"])
    assert np.allclose(m.T @ m, np.linalg.pinv(np.cov(a.T)), atol=1e-9)


@pytest.mark.parametrize("n, cell_rows, ties", [(100, 8, False), (2, 8, False), (3, 8, False), (300, 32, True), (501, 512, True)])
def test_pairwise_median(spark, monkeypatch, n, cell_rows, ties):
    """Even and odd numbers of pairs, copies of half the rows, and distances shared by many pairs."""
    monkeypatch.setattr(D, "CELL_ROWS", cell_rows)
    a = rng.normal(size=(n, 2))
    if ties:
        a = np.round(a)
        a[: n // 2] = a[0]
    df = frame(spark, row_id=np.arange(n), x0=a[:, 0], x1=a[:, 1])
    d = np.linalg.norm(a[:, None] - a[None], axis=2)[np.triu_indices(n, 1)]
    got, pairs = D.pairwise_median(df, ["x0", "x1"])
    assert pairs == len(d) and got == pytest.approx(np.median(d), abs=1e-12)


# --- profiles ---------------------------------------------------------------------------------


def _toy(spark, xs):
    t = frame(spark, row_id=np.arange(len(xs)), a=np.asarray(xs, float), b=np.linspace(1, 2, len(xs)),
              is_test=np.zeros(len(xs), bool))
    return t, C.column_stats(t, ["a", "b"])


def test_exact_steps_equal_a_fine_grid(spark):
    """Edges on a sweep's ends, a sweep without an edge and one without length."""
    stairs = ExpressionScorer(
        "0.2e0 + CASE WHEN {a} > 1e0 THEN 0.3e0 ELSE 0e0 END - CASE WHEN {a} > 2e0 THEN 0.1e0 ELSE 0e0 END"
        " + CASE WHEN {a} > 4e0 THEN 0.3e0 ELSE 0e0 END", ["a"], {"a": [1.0, 2.0, 4.0]})
    sweeps = frame(spark, row_id=[0, 1, 2, 3], lo=[0.0, 1.0, 2.5, 3.0], hi=[5.0, 2.0, 3.5, 3.0])
    got = {r.row_id: (round(r.swing, 9), r.largest, r.step_left) for r in P.exact_summary(sweeps, stairs, "a").collect()}
    assert got == {0: (0.5, 0.3, 1.0), 1: (0.3, 0.3, 1.0), 2: (0.0, 0.0, None), 3: (0.0, 0.0, None)}


def test_flat_curve_has_no_direction(spark):
    t, stats = _toy(spark, [0, 1, 2, 3])
    flat = ExpressionScorer("CASE WHEN {a} > 99e0 THEN 1e0 ELSE 0.3e0 END", ["a"])
    b = P.bundle_summary(P.slope_points(P.sweep_rows(t, stats, ["a"]), flat, ["a"], 20)).toPandas()
    assert (b["moving"] == 0).all() and (b["against_share"] == 0).all()


def test_first_of_equal_steps_wins(spark):
    t, stats = _toy(spark, [0, 10])
    two = ExpressionScorer("CASE WHEN {a} > 2.5e0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN {a} > 6.5e0 THEN 0.2e0 ELSE 0e0 END", ["a"])
    s = P.profile_summary(P.sweep_rows(t, stats, ["a"]), two, ["a"], 11).first()
    assert (s["step_left"], s["step_right"], s["n_big"]) == (2.0, 3.0, 2)


def test_opposing_fans_are_seen(spark):
    t, stats = _toy(spark, np.linspace(-3, 3, 40))
    fans = ExpressionScorer("1e0 / (1e0 + exp(-{a} * sign({b} - 1.5e0)))", ["a", "b"])
    points = P.slope_points(P.sweep_rows(t, stats, ["a"]), fans, ["a"], 30)
    b = P.bundle_summary(points).toPandas()
    ranges = points.groupBy("row_id").agg((F.max("p") - F.min("p")).alias("r")).toPandas()["r"]
    assert b["pdp"].max() - b["pdp"].min() < 0.05 * ranges.median()
    assert (b["against"] == b["n"]).all() or b["against_share"].max() >= 0.45


def test_pdp_swing_is_bounded_by_the_mean_swing(docs):
    t, stats = docs
    points = P.slope_points(P.sweep_rows(t, stats, ["n_words"]), DOC_STAIRS, ["n_words"], 40)
    b = P.bundle_summary(points).toPandas()
    r = points.groupBy("row_id").agg((F.max("p") - F.min("p")).alias("r")).agg(F.avg("r")).first()[0]
    assert b["pdp"].max() - b["pdp"].min() <= r + 1e-12


def test_slopes_by_window_equal_slopes_by_neighbour(docs):
    t, stats = docs
    near = P.slope_points(P.sweep_rows(t, stats, ["n_chars"]), DOC_STAIRS, ["n_chars"], 30)
    stored = P.curve_slopes(near.select("row_id", "feature", "grid_idx", "z", "p", F.col("slope").alias("s0")))
    assert stored.where(F.abs(F.col("slope") - F.col("s0")) > 1e-12).count() == 0


def test_every_kind_of_scorer_sweeps_alike(spark, docs):
    t, stats = docs
    names = ["n_words", "chars_per_word"]
    expr = ExpressionScorer("1e0 / (1e0 + exp(-(0.002e0 * {n_words} - 0.5e0 * {chars_per_word})))", names)
    pandas = PandasScorer(lambda x: 1 / (1 + np.exp(-(0.002 * x[:, 0] - 0.5 * x[:, 1]))), names)
    a, b = (P.cp_profiles(t, stats, s, names, 15).select("row_id", "feature", "grid_idx", F.round("p", 9).alias("p"))
            for s in (expr, pandas))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_two_point_slope_is_the_gradient(docs):
    t, stats = docs
    two = P.two_point(t, stats, DOC_STAIRS, DOC_STAIRS.features, [0.3]).select("row_id", "feature", "slope")
    g = S.gradient_columns(t, stats, DOC_STAIRS, 0.3)
    long = g.select("row_id", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"grad_{f}").alias("g")) for f in DOC_STAIRS.features])))
    bad = two.join(long, ["row_id", "feature"]).where(F.abs(F.col("slope") - F.col("g")) > 1e-12)
    assert bad.count() == 0


# --- envelope and columns ---------------------------------------------------------------------


def test_zero_partner_drops_the_row_not_the_feature(spark):
    df = frame(spark, row_id=[0, 1, 2], a=[2.0, 4.0, 9.0], b=[1.0, 2.0, 0.0])
    band = E.ratio_bounds(df, [("a", "b")]).first()
    assert (band["a_lo"], band["a_hi"]) == (2.0, 2.0)
    out = df.agg(F.avg(E.outside(F.lit(5.0), F.col("b"), F.lit(2.0), F.lit(4.0)).cast("double"))).first()[0]
    assert out == 0.5
    kept = df.select(E.outside_keep_zero(F.lit(5.0), F.col("b"), F.lit(2.0), F.lit(4.0)).alias("o")).collect()
    assert [r.o for r in kept] == [True, False, False]


def test_constant_column_is_guarded(spark):
    t = frame(spark, row_id=[0, 1], c=[3.0, 3.0], is_test=[False, False])
    z = C.zscored(t, C.column_stats(t, ["c"]), ["c"], guard=True)
    assert [r.z_c for r in z.collect()] == [0.0, 0.0]


def test_one_sided_window_has_no_boundary(docs):
    t, stats = docs
    high = ExpressionScorer("0.9e0 + 0e0 * {n_words} * {n_chars}", ["n_words", "n_chars"])
    w = SL.windowed(t, stats, "n_words", "n_chars")
    grid = SL.with_neighbours(SL.cells(w, 10, 10), high, "n_words", "n_chars", 10, 10)
    d = grid.groupBy("row_id").agg(F.min(SL.edge_distance("n_words", "n_chars")).alias("d"))
    assert d.where(F.col("d").isNotNull()).count() == 0


# --- surrogate --------------------------------------------------------------------------------


def _ridge(z, y, w, alpha):
    mz, my = np.average(z, axis=0, weights=w), np.average(y, weights=w)
    a = (z - mz).T @ (w[:, None] * (z - mz)) + alpha * np.eye(z.shape[1])
    coef = np.linalg.solve(a, (z - mz).T @ (w * (y - my)))
    return coef, my - mz @ coef


@pytest.mark.parametrize("include_self", [True, False])
def test_explanations_match_a_row_by_row_fit(spark, include_self):
    p, k, m = 6, 3, 400
    names = [f"f{i}" for i in range(p)]
    z, x = rng.normal(size=(m, p)), rng.normal(size=(12, p))
    f = lambda v: 1 / (1 + np.exp(-(v[:, 0] - 2 * v[:, 1] * v[:, 2])))
    cloud = CL.SharedCloud(names, [42], [z], [f(z)])
    rows = frame(spark, row_id=np.arange(12), p=f(x), **{f"z_{n}": x[:, i] for i, n in enumerate(names)})
    got = S.explain(rows, cloud, k, ("kernel", "uniform"), include_self).toPandas()
    nu = 0.75 * np.sqrt(p)
    for r in got.itertuples():
        zz, yy = (np.r_[x[[r.row_id]], z[1:]], np.r_[f(x)[[r.row_id]], f(z[1:])]) if include_self else (z, f(z))
        d = np.linalg.norm(zz - x[r.row_id], axis=1)
        w = np.sqrt(np.exp(-(d**2) / nu**2)) if r.variant == "kernel" else np.ones(len(zz))
        aux, _ = _ridge(zz, yy, w, 0.01)
        top = np.sort(np.argsort(-np.abs(aux * x[r.row_id]))[:k])
        coef, b0 = _ridge(zz[:, top], yy, w, 1.0)
        assert list(r.kept) == list(top)
        assert np.allclose(np.asarray(r.coef)[top], coef, atol=1e-9) and r.intercept == pytest.approx(b0, abs=1e-9)
        assert r.g == pytest.approx(r.intercept + np.asarray(r.coef) @ x[r.row_id], abs=1e-12)
        fit = b0 + zz[:, top] @ coef
        r2 = 1 - (w * (yy - fit) ** 2).sum() / (w * (yy - np.average(yy, weights=w)) ** 2).sum()
        assert r.r2 == pytest.approx(r2, abs=1e-9)


def test_selection_uses_standardised_values(spark):
    """Ranking by raw units is the trap: the kept set must not change with the units."""
    z = rng.normal(size=(500, 3))
    y = 0.5 + 0.1 * z[:, 0] + 0.09 * z[:, 1]
    cloud = CL.SharedCloud(["a", "b", "c"], [42], [z], [y])
    rows = frame(spark, row_id=[0], p=[0.5], z_a=[1.0], z_b=[1.0], z_c=[1.0])
    assert list(S.explain(rows, cloud, 2).first()["kept"]) == [0, 1]


def test_moments_agree_with_linear_regression(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    z, x = rng.normal(size=(300, 2)), np.array([[0.3, -0.4]])
    y = np.tanh(z[:, 0]) - 0.2 * z[:, 1]
    w = np.exp(-((z - x) ** 2).sum(1) / (2 * (0.75**2) * 2))
    rows = frame(spark, row_id=[0], p=[0.0], z_a=x[:, 0], z_b=x[:, 1])
    got = S.explain(rows, CL.SharedCloud(["a", "b"], [1], [z], [y]), 2, include_self=False).first()
    sd = np.sqrt(np.average((y - np.average(y, weights=w)) ** 2, weights=w))
    draws = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        frame(spark, a=z[:, 0], b=z[:, 1], label=y, w=w))
    ml = LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, weightCol="w",
                          regParam=float(sd / w.sum())).fit(draws)
    assert np.allclose(got["coef"], ml.coefficients.toArray(), atol=1e-9)
    assert got["intercept"] == pytest.approx(ml.intercept, abs=1e-9)


def test_cloud_must_be_bounded(spark):
    with pytest.raises(ValueError):
        CL.share_cloud(spark.range(1), ["a"], 10_000_000, (1,))


def test_ml_scorer_keeps_the_row(spark, docs):
    from probewise.operators.models import logistic

    t, stats = docs
    known = t.where("label IS NOT NULL")
    scorer = MLScorer(logistic(T.DOC_FEATURES, known.count()).fit(known), T.DOC_FEATURES)
    points = P.cp_profiles(t, stats, scorer, ["n_words", "n_chars"], 5)
    own = points.select("row_id", "n_words", "n_chars").distinct()
    assert own.count() == t.count() and points.where(~F.col("p").between(0, 1)).count() == 0


def test_ridge_logistic_is_at_its_optimum(spark, docs):
    from probewise.operators.models import logistic

    known = docs[0].where("label IS NOT NULL")
    n = known.count()
    model = logistic(T.DOC_FEATURES, n).fit(known).stages[-1]
    pdf = known.select(*T.DOC_FEATURES, "label").toPandas()
    x = pdf[T.DOC_FEATURES].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = model.coefficients.toArray() * np.sqrt((n - 1) / n)
    p = 1 / (1 + np.exp(-(z @ w * 1.0 + model.intercept)))
    # summed loss plus half the squared weights, columns scaled by the population std
    gradient = z.T @ (p - pdf["label"].to_numpy()) + w
    assert np.abs(gradient).max() < 1e-3 and abs((p - pdf["label"]).sum()) < 1e-3


@pytest.mark.parametrize("n", [10_000, 100_000])
def test_a_step_late_in_a_long_grid_is_found(spark, n):
    from pyspark.sql import Row

    class Step:
        features = ["a"]

        def score_at(self, points, at, features, out="p"):
            return points.withColumn(out, F.when(F.col(at) > n - 500.5, 1.0).otherwise(0.0))

    sweeps = spark.createDataFrame([Row(row_id=1, feature="a", a=0.0, lo=0.0, hi=float(n - 1), n=n)])
    for size in (n, "n"):
        keys = ("row_id", "feature") if size == n else ("row_id", "feature", "n")
        got = P.profile_summary(sweeps, Step(), ["a"], size, keys).first()
        assert (got["step_idx"], got["step_left"], got["largest"]) == (n - 501, float(n - 501), 1.0)


def test_ties_on_the_widest_column_still_part(spark):
    from probewise.operators.distance import SpacePartition

    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 3))
    x[:12_000, 0] = 50.0
    tree = SpacePartition(6, x[::4])
    assert np.bincount(tree.cell(x)).max() < 1500


def test_split_cells_and_bounded_probes_stay_exact(spark, monkeypatch):
    from probewise.operators import distance as D

    monkeypatch.setattr(D, "CELL_ROWS", 16)
    monkeypatch.setattr(D, "POINTS_PER_TASK", 5)
    monkeypatch.setattr(D, "PROBES_PER_TASK", 7)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 4)), 2)
    x[:150, 0] = 9.0
    x[10:14] = x[10]
    ids = np.arange(300) - 2  # ids may be negative
    df = frame(spark, row_id=ids, **{f"d{i}": x[:, i] for i in range(4)})
    dims = [f"d{i}" for i in range(4)]
    full = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    for own in (True, False):
        want = full + np.where(np.eye(300, dtype=bool), np.inf, 0) if own else full
        got = D.nearest(df, D.Space(df, dims), ["row_id"], own).toPandas().set_index("row_id")
        assert np.allclose(got["d"].loc[ids], want.min(axis=1))
        assert np.allclose(want[np.arange(300), got["id"].loc[ids].to_numpy() + 2], want.min(axis=1))
    assert D.pairwise_median(df.limit(1), dims) == (None, 0)


def test_documents_without_a_label_stay(spark):
    t = T.doc_features(spark, SF)
    assert t.count() == T.read(spark, SF, "documents").count() and t.where("label IS NULL").count() > 0


def test_unlabelled_documents_are_split_and_probed(spark):
    from probewise.plans import models

    every, t = T.doc_features(spark, SF), models._docs(spark, SF)
    assert t.count() == every.count() > every.where("label IS NOT NULL").count()
    assert t.where("is_test AND label IS NULL").count() > 0 and models._train(t).where("label IS NULL").count() == 0
    probed = models.explain_forest(spark, SF)
    assert probed.count() == t.where("is_test").count()


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize("whiten", [True, False])
def test_sweeps_meet_the_nearest_rows_of_brute_force(spark, monkeypatch, exclude, whiten):
    """Copies, ties, a far row, a sweep of no length and cells, chunks and parts of a few rows."""
    monkeypatch.setattr(D, "CELL_ROWS", 12)
    monkeypatch.setattr(D, "POINTS_PER_TASK", 9)
    monkeypatch.setattr(D, "PROBES_PER_TASK", 7)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(220, 3)), 1)
    x[:60] = x[0]
    x[100] = [60.0, -40.0, 5.0]
    ids, n, mean, std = np.arange(220) - 3, 37, 5.0, 2.5
    lo, hi = (x[:, 0] - 2.0) * std + mean, (x[:, 0] + 3.0) * std + mean
    hi[7] = lo[7] = x[7, 0] * std + mean
    dims = ["a", "b", "c"]
    refs = frame(spark, row_id=ids, **{c: x[:, k] for k, c in enumerate(dims)})
    rows = frame(spark, row_id=ids, lo=lo, hi=hi, **{c: x[:, k] for k, c in enumerate(dims)})
    matrix = D.whitening(refs, dims) if whiten else None
    sweep = D.Sweep(dims, "a", mean, std, n, matrix)
    measured = D.whitened(refs, dims, matrix) if whiten else refs
    got = D.nearest_along(rows, D.Space(measured, dims), sweep, exclude).toPandas().set_index("row_id")
    assert len(got) == 220
    m = np.eye(3) if matrix is None else matrix
    for k, i in enumerate(ids):
        z = np.tile(x[k], (n, 1))
        z[:, 0] = (np.append(lo[k] + np.arange(n - 1) * ((hi[k] - lo[k]) / (n - 1)), hi[k]) - mean) / std
        d = np.sqrt((((z[:, None, :] - x[None, :, :]) @ m.T) ** 2).sum(axis=2))
        if exclude:
            d[:, k] = np.inf
        assert np.allclose(got.d[i], d.min(axis=1), atol=1e-9)
        named = np.array(got.ids[i]) + 3
        assert np.allclose(d[np.arange(n), named], d.min(axis=1), atol=1e-9) and (not exclude or k not in named)


def test_a_row_alone_has_no_neighbour_along_its_sweep(spark):
    one = frame(spark, row_id=[5], a=[0.0], b=[1.0], lo=[-1.0], hi=[1.0])
    row = D.nearest_along(one, D.Space(one, ["a", "b"]), D.Sweep(["a", "b"], "a", 0.0, 1.0, 4), True).first()
    assert row.d == [float("inf")] * 4 and row.ids == [-1] * 4


def test_shuffled_records_of_a_sweep_do_not_depend_on_its_points(spark):
    """As many visits for 20 points a row as for 2,000."""
    import inspect

    source = inspect.getsource(D.nearest_along)
    assert "explode" not in source
    rows = frame(spark, row_id=list(range(300)), a=list(rng.normal(size=300)), b=list(rng.normal(size=300)), lo=[-2.0] * 300, hi=[2.0] * 300)
    space = D.Space(rows, ["a", "b"])
    few, many = (D.nearest_along(rows, space, D.Sweep(["a", "b"], "a", 0.0, 1.0, n), True).toPandas().set_index("row_id") for n in (20, 19 * 40 + 1))
    for i in range(300):
        assert np.allclose(few.d[i], np.array(many.d[i])[::40], atol=1e-9)


def test_second_axis_and_top3_equal_plain_ranking(spark):
    hs = [0.1, 0.3, 1.0]
    rows, cloud, t, names = plans.wide(spark, SF, hs)
    grads = [f"{plans.grad_name(h)}_{f}" for h in hs for f in plans.OF]
    told = S.explain(rows, cloud, len(names), keep=["label", *grads]).toPandas()
    corr = t.where("NOT is_test").select(*names).toPandas().corr().abs()
    order = lambda values, of: [f for v, _, f in sorted((-abs(v), i, f) for i, (v, f) in enumerate(zip(values, of))) if v]
    want, hits = {}, {h: [] for h in hs}
    for r in told.to_dict("records"):
        ranked = order(r["coef"], names)
        loose = [f for f in ranked[1:] if corr.loc[ranked[0], f] < 0.6]
        near = (r["p"] >= 0.5) == r["label"] and abs(r["p"] - 0.5) < 0.15
        top2 = corr.loc[ranked[0], ranked[1]]
        want[r["row_id"]] = (ranked[0], loose[0] if loose else None, ranked.index(loose[0]) + 1 if loose else None, near and top2 < 0.6, near and bool(loose))
        for h in hs:
            moved = order([r[f"{plans.grad_name(h)}_{f}"] for f in plans.OF], plans.OF)[:3]
            if moved:
                hits[h].append(len(set(moved) & set(ranked[:3])) / len(moved))
    got = {r.row_id: (r.first, r.second, r.second_rank, r.strict, r.candidate) for r in plans.second_axis(spark, SF).collect()}
    assert got == want
    for r in plans.top3_agreement(spark, SF).collect():
        assert r.n == len(hits[r.h]) and r.top3 == pytest.approx(np.mean(hits[r.h]), abs=1e-6)
        assert r.all_found == pytest.approx(np.mean(np.array(hits[r.h]) == 1), abs=1e-6)


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize("whiten", [True, False])
def test_blocks_of_sweeps_get_all_points_they_need(spark, monkeypatch, exclude, whiten):
    """Many small blocks, cells and stretches against brute force, and few points sent."""
    for name, size in (("CELL_ROWS", 6), ("BLOCK_SWEEPS", 16), ("FEW_SWEEPS", 4), ("FEW_PROBES", 3), ("FEW_POINTS", 2), ("HULL_BINS", 5)):
        monkeypatch.setattr(D, name, size)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(260, 3)) * [1.0, 1.0, 0.3], 1)
    x[:30], x[31] = x[0], [9.0, -20.0, 5.0]
    dims, ids, n = ["a", "b", "c"], np.arange(260), 23
    refs = frame(spark, row_id=ids, **{c: x[:, k] for k, c in enumerate(dims)})
    rows = frame(spark, row_id=ids, lo=x[:, 0] - 1.5, hi=x[:, 0] + 2.0, **{c: x[:, k] for k, c in enumerate(dims)})
    matrix = D.whitening(refs, dims) if whiten else np.eye(3)
    space = D.Space(D.whitened(refs, dims, matrix) if whiten else refs, dims)
    assert space.depth > 4
    got = D.nearest_along(rows, space, D.Sweep(dims, "a", 0.0, 1.0, n, matrix), exclude).toPandas().set_index("row_id")
    for k in ids:
        z = np.tile(x[k], (n, 1))
        z[:, 0] = np.linspace(x[k, 0] - 1.5, x[k, 0] + 2.0, n)
        d = np.sqrt((((z[:, None, :] - x[None, :, :]) @ matrix.T) ** 2).sum(axis=2))
        if exclude:
            d[:, k] = np.inf
        assert np.allclose(got.d[k], d.min(axis=1), atol=1e-9)
        assert np.allclose(d[np.arange(n), np.array(got.ids[k])], d.min(axis=1), atol=1e-9)


def test_points_above_the_hull_are_nowhere_nearest():
    rng = np.random.default_rng(8)
    s, across = rng.normal(size=400) * 3, rng.normal(size=400)
    lines = np.array([-0.02, 0.0, 0.03])
    gap = (lines[:, None] - across) ** 2
    kept = D._under_hull(s, np.where((across >= -0.02) & (across <= 0.03), 0.0, gap.min(axis=0)), gap.max(axis=0), np.ones(400, bool), -1.0, 1.5)
    places = np.linspace(-1.0, 1.5, 300)
    winners = np.unique(((places[:, None, None] - s) ** 2 + gap).argmin(axis=2))
    assert kept[winners].all() and kept.sum() < 200


@pytest.mark.parametrize("exclude", [True, False])
def test_far_cells_of_nearest_come_by_blocks(spark, monkeypatch, exclude):
    """probes aren't copied to cells; blocks meet their cells in parts."""
    for name, size in (("CELL_ROWS", 4), ("BLOCK_PROBES", 16), ("PART_POINTS", 20)):
        monkeypatch.setattr(D, name, size)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 5)), 2)
    x[:40] = x[0]
    dims = [f"x{k}" for k in range(5)]
    refs = frame(spark, row_id=np.arange(300), **{c: x[:, k] for k, c in enumerate(dims)})
    got = D.nearest(refs, D.Space(refs, dims), ["row_id"], exclude).toPandas().sort_values("row_id")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    if exclude:
        np.fill_diagonal(d, np.inf)
    assert np.allclose(got["d"], d.min(axis=1), atol=1e-12)
    assert np.allclose(d[np.arange(300), got["id"].to_numpy()], d.min(axis=1), atol=1e-12)
