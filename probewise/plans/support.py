"""Support queries: dependence envelopes and distances to real rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.functions.materialise import materialise
from probewise.functions.numeric import r6, share, tally
from probewise.functions.ranks import exact_median, exact_quantiles, spearman
from probewise.operators import columns as C
from probewise.operators import distance as D
from probewise.operators import envelope as E
from probewise.operators import profiles as P
from probewise.plans.scorers import DOC_STAIRS, ORDER_STAIRS
from probewise.sources import tables as T

PAIRS = [("qty", "list_value"), ("net", "gross"), ("gross", "qty")]
CUTS = [0.5, 0.75, 0.95]


def envelope(spark, sf_dir):
    t = T.order_features(spark, sf_dir)
    one = E.ratio_bounds(t, PAIRS)
    rows = [F.struct(F.lit(f"{a}/{b}").alias("pair"), F.col(f"{a}_lo").alias("lo"),
                     F.col(f"{a}_hi").alias("hi")) for a, b in PAIRS]
    return one.select(F.inline(F.array(*rows))).select(
        "pair", r6("lo").alias("lo"), r6("hi").alias("hi"), r6(F.col("hi") / F.col("lo")).alias("band"))


def _share_per_row(spark, sf_dir, band_of):
    t = T.order_features(spark, sf_dir, ["qty", "list_value"])
    stats = C.column_stats(t, ["qty"])
    rows = C.attach(t, band_of(t), "band")
    sweeps = E.count_outside(P.sweep_rows(rows, stats, ["qty"], span=2.5), 200, "list_value", "band.qty_lo", "band.qty_hi")
    # with a zero partner every point counts as possible
    sweeps = sweeps.withColumn("n_out", F.coalesce("n_out", F.lit(0)))
    return sweeps.groupBy("row_id").agg(
        F.sum("n_out").alias("n_impossible"), (F.sum("n_out") / (F.count(F.lit(1)) * 200)).alias("impossible"))


def impossible_share(spark, sf_dir):
    s = _share_per_row(spark, sf_dir, lambda t: E.ratio_bounds(t, [("qty", "list_value")]))
    return s.select("row_id", "n_impossible", r6("impossible").alias("impossible"))


def impossible_tolerance(spark, sf_dir):
    s = _share_per_row(spark, sf_dir, lambda t: E.ratio_tolerance(t, "qty", "list_value"))
    return s.select("row_id", "n_impossible", r6("impossible").alias("impossible"))


def step_inside_band(spark, sf_dir):
    """Is the largest step of each profile somewhere the row could be?"""
    t = T.doc_features(spark, sf_dir)
    stats = C.column_stats(t, ["n_chars", "n_words"])
    band = E.ratio_bounds(t, [("n_chars", "n_words")])
    sweeps = P.sweep_rows(t, stats, ["n_chars"], span=2.5)
    s = P.profile_summary(sweeps, DOC_STAIRS, ["n_chars"], 200, ("row_id", "n_words"))
    ratio = F.col("step_left") / F.col("n_words")
    inside = (ratio >= F.col("band.n_chars_lo")) & (ratio <= F.col("band.n_chars_hi"))
    return C.attach(s, band, "band").select(
        "row_id", r6("step_left", 3).alias("step_left"), inside.alias("inside"))


def strongest_partner(spark, sf_dir):
    t = T.order_features(spark, sf_dir)
    best = C.strongest_partners(t.where(C.train_rows()), T.ORDER_FEATURES)
    return best.select("feature", "partner", r6("r").alias("r"))


def _all_features(spark, sf_dir, names, span) -> DataFrame:
    """Per feature: partner, |r|, share of impossible points over all rows, width of the band."""
    t = T.order_features(spark, sf_dir)
    stats = C.column_stats(t, T.ORDER_FEATURES)
    partners = C.strongest_partners(t.where(C.train_rows()), T.ORDER_FEATURES)
    pairs = [(a, b) for a, b in E.partner_pairs(partners) if a in names]
    rows = C.attach(t, E.ratio_bounds(t, pairs), "band")
    # partner and band are picked once per sweep, below the explosion of the grid
    sweeps = P.sweep_rows(rows, stats, names, span=span).withColumns({
        "partner_value": E.partner_value(pairs), "_lo": E.by_feature(pairs, "band", "lo"),
        "_hi": E.by_feature(pairs, "band", "hi")})
    n = 200 if span else 120
    sweeps = E.count_outside(sweeps, n, "partner_value", "_lo", "_hi")
    # rows with a zero partner give NULL and drop out of the average; the feature stays
    shares = sweeps.groupBy("feature").agg(
        (F.sum("n_out") / (F.count("n_out") * n)).alias("impossible"), F.max("_lo").alias("lo"), F.max("_hi").alias("hi"))
    wide = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(F.lit(float("inf")))
    return shares.join(partners, "feature").withColumns({"abs_r": F.abs("r"), "band": wide})


def envelope_all_features(spark, sf_dir):
    e = _all_features(spark, sf_dir, T.ORDER_FEATURES, 2.5)
    return e.select("feature", "partner", *[r6(c, 5).alias(c) for c in ("abs_r", "impossible", "band")])


def envelope_rank_corr(spark, sf_dir):
    e = materialise(_all_features(spark, sf_dir, T.ORDER_FEATURES, 2.5))
    x = F.array(
        F.struct(F.lit("abs_r").alias("against"), F.round("abs_r", 9).alias("x")),
        F.struct(F.lit("band").alias("against"), F.round("band", 6).alias("x")))
    long = e.select(F.round("impossible", 9).alias("y"), F.inline(x))
    rho = spearman(long, "x", "y", ["against"])
    strong = F.when(F.col("abs_r") > 0.9, F.col("impossible"))
    medians = e.agg(F.percentile("impossible", F.lit(0.5)).alias("m"),
                    F.percentile(strong, F.lit(0.5)).alias("ms"))
    return C.attach(rho, medians, "m").select(
        "against", r6("rho").alias("rho"), "n", r6("m.m").alias("median_all"),
        r6("m.ms").alias("median_strong"))


def ice_envelope(spark, sf_dir):
    """Impossible share per grid point, pooled, and of rows that are mostly impossible."""
    t = T.order_features(spark, sf_dir, ["qty", "list_value"])
    stats = C.column_stats(t, ["qty"])
    rows = C.attach(t, E.ratio_bounds(t, [("qty", "list_value")]), "band")
    points = P.grid_points(P.sweep_rows(rows, stats, ["qty"]), 120)
    points = points.withColumn("out", E.outside(
        F.col("z"), F.col("list_value"), F.col("band.qty_lo"), F.col("band.qty_hi")))
    by_point = points.groupBy("grid_idx").agg(tally(F.col("out")).alias("k"), F.count("out").alias("n"))
    pooled = by_point.agg(F.lit("pooled").alias("level"), F.lit(-1).alias("grid_idx"),
                          (F.sum("k") / F.sum("n")).alias("s"))
    grid = by_point.select(F.lit("grid").alias("level"), "grid_idx", (F.col("k") / F.col("n")).alias("s"))
    majority = points.groupBy("row_id").agg(share(F.col("out")).alias("s")).agg(
        F.lit("rows_over_half").alias("level"), F.lit(-1).alias("grid_idx"),
        share(F.col("s") > 0.5).alias("s"))
    return grid.unionByName(pooled).unionByName(majority).select(
        "level", "grid_idx", r6("s").alias("impossible"))


def ice_envelope_local(spark, sf_dir):
    s = _share_per_row(spark, sf_dir, lambda t: E.ratio_bounds(t, [("qty", "list_value")]))
    pooled = s.agg(F.avg("impossible").alias("pooled"), F.count(F.lit(1)).alias("n"))
    return C.attach(pooled, exact_median(s, "impossible"), "m").select(
        r6("pooled").alias("pooled"), r6("m.median").alias("median"), "n")


def ice_envelope_features(spark, sf_dir):
    e = _all_features(spark, sf_dir, ORDER_STAIRS.features, None)
    return e.select("feature", "partner", r6("abs_r").alias("abs_r"), r6("impossible").alias("impossible"))


def envelope_clusters(spark, sf_dir):
    e = _all_features(spark, sf_dir, T.ORDER_FEATURES, None)
    low = F.col("impossible") < 0.5
    return e.agg(tally(low).alias("below_half"), tally(~low).alias("above_half"),
                 r6(F.percentile("impossible", F.lit(0.5))).alias("median"))


def _standardised(t, names):
    dims = [f"z_{f}" for f in names]
    return C.zscored(t, C.column_stats(t, names), names).select("row_id", *dims), dims


def _order_distances(spark, sf_dir):
    z, dims = _standardised(T.order_features(spark, sf_dir), T.ORDER_FEATURES)
    z = materialise(z)
    return D.nearest(z, D.Space(z, dims), ["row_id"], exclude_self=True)


def nn_real(spark, sf_dir):
    """Every order's nearest other order over all seven columns."""
    return _order_distances(spark, sf_dir).select("row_id", r6("d").alias("d"), F.col("id").alias("nearest"))


def _quantiles(d):
    q = exact_quantiles(d, "d", CUTS)
    return q.select(*[r6(F.col("q")[i]).alias(f"p{round(c * 100)}") for i, c in enumerate(CUTS)])


def nn_cutoffs(spark, sf_dir):
    return _quantiles(_order_distances(spark, sf_dir))


def nn_vectors(spark, sf_dir):
    """The same over the 64 columns of the vector table."""
    t, names = T.vec_columns(T.vec_features(spark, sf_dir), 64)
    z, dims = _standardised(t, names)
    z = materialise(z)
    d = D.nearest(z, D.Space(z, dims), ["row_id"], exclude_self=True)
    return d.select("row_id", r6("d").alias("d"), F.col("id").alias("nearest"))


NAMES, SWEPT, POINTS = T.DOC_FEATURES, "n_chars", 200


def _doc_sweep(spark, sf_dir, exclude_self, mahalanobis=False):
    """Every document's sweep of n_chars over all columns: (row_id, d, ids, z, x, x_std, ..), and the rows."""
    t = T.doc_features(spark, sf_dir)
    stats = C.column_stats(t, NAMES)
    real, dims = _standardised(t, NAMES)
    real = materialise(real)
    st = stats.first()
    matrix = D.whitening(real, dims) if mahalanobis else None
    sweep = D.Sweep(dims, f"z_{SWEPT}", st[f"{SWEPT}_mean"], st[f"{SWEPT}_std"], POINTS, matrix)
    bounds = materialise(P.sweep_rows(t, stats, [SWEPT], span=2.5).select("row_id", "lo", "hi", "x", "x_std", "n_words"))
    measured = materialise(D.whitened(real, dims, matrix)) if mahalanobis else real
    space = D.Space(measured, dims)
    found = D.nearest_along(bounds.join(real, "row_id"), space, sweep, exclude_self).join(bounds, "row_id")
    z = F.expr(f"transform(sequence(0, {POINTS - 1}), i -> {P.point_sql('i', POINTS)})")
    d = D.nearest(measured, space, ["row_id"], exclude_self=True)
    found = C.attach(found.withColumn("z", z), exact_quantiles(d, "d", CUTS).select("q"), "c")
    return found, E.ratio_bounds(t, [(SWEPT, "n_words")])


def _share_of(values, test) -> Column:
    """Share of an array's values that pass the test."""
    return F.size(F.filter(values, test)) / F.size(values)


def _rejects(i: int) -> Column:
    return _share_of("d", lambda d: d > F.col("c.q")[i])


def nn_probe_naive(spark, sf_dir):
    """The check as usually written: the probed row is in its own reference set."""
    d, _ = _doc_sweep(spark, sf_dir, exclude_self=False)
    return d.select("row_id", r6(F.array_max("d")).alias("max_d"), r6(_rejects(2)).alias("rejects"))


def nn_self_match(spark, sf_dir):
    """Share of probes whose nearest real row, by id, is the row they were made from."""
    d, _ = _doc_sweep(spark, sf_dir, exclude_self=False)
    span = F.array_max(F.transform("z", lambda z: F.abs(z - F.col("x")) / F.col("x_std")))
    return d.select("row_id", r6(_share_of("ids", lambda i: i == F.col("row_id"))).alias("self_share"),
                    r6(F.array_max("d")).alias("max_d"), r6(span).alias("span"))


def nn_probe_loo(spark, sf_dir):
    d, _ = _doc_sweep(spark, sf_dir, exclude_self=True)
    return d.select(
        "row_id", r6(F.array_min("d")).alias("min_d"), r6(F.array_max("d")).alias("max_d"),
        *[r6(_rejects(i)).alias(f"rejects_p{round(c * 100)}") for i, c in enumerate(CUTS)])


def nn_probe_curve(spark, sf_dir):
    d, _ = _doc_sweep(spark, sf_dir, exclude_self=True)
    points = d.select("row_id", "c", F.posexplode("d").alias("grid_idx", "at"))
    return points.select("row_id", "grid_idx", r6(F.col("at") / F.col("c.q")[2]).alias("relative"))


def nn_mahalanobis(spark, sf_dir):
    d, _ = _doc_sweep(spark, sf_dir, exclude_self=True, mahalanobis=True)
    return d.select("row_id", r6(F.array_max("d")).alias("max_d"), r6(_rejects(2)).alias("rejects"))


def verdict_agreement(spark, sf_dir):
    """Mahalanobis against the envelope, point by point, pooled over every document."""
    d, band = _doc_sweep(spark, sf_dir, exclude_self=True, mahalanobis=True)
    points = C.attach(d, band, "band").select(
        "n_words", "c", "band", F.inline(F.arrays_zip("d", "z")))
    far = F.col("d") > F.col("c.q")[2]
    out = E.outside(F.col("z"), F.col("n_words"), F.col(f"band.{SWEPT}_lo"), F.col(f"band.{SWEPT}_hi"))
    return points.select(far.alias("far"), out.alias("out")).agg(
        F.count(F.lit(1)).alias("n"), r6(share(F.col("far"))).alias("distance_rejects"),
        r6(share(F.col("out"))).alias("envelope_rejects"), r6(share(F.col("far") == F.col("out"))).alias("agree"),
        tally(F.col("far") & ~F.col("out")).alias("only_distance"),
        tally(~F.col("far") & F.col("out")).alias("only_envelope"))


def pairwise_median(spark, sf_dir):
    t = T.doc_features(spark, sf_dir)
    z = C.zscored(t, C.column_stats(t, T.DOC_FEATURES), T.DOC_FEATURES)
    dims = [f"z_{f}" for f in T.DOC_FEATURES]
    median, pairs = D.pairwise_median(z.select("row_id", *dims), dims)
    expected = (2 * len(dims)) ** 0.5
    return t.agg(r6(F.lit(median).cast("double")).alias("median"), r6(F.lit(expected)).alias("sqrt_2p"),
                 F.lit(pairs).cast("long").alias("pairs"))


QUERIES = {
    f.__name__: f
    for f in (
        envelope, impossible_share, impossible_tolerance, step_inside_band, strongest_partner,
        envelope_all_features, envelope_rank_corr, ice_envelope, ice_envelope_local,
        ice_envelope_features, envelope_clusters, nn_real, nn_cutoffs, nn_vectors, nn_probe_naive,
        nn_self_match, nn_probe_loo, nn_probe_curve, nn_mahalanobis, verdict_agreement,
        pairwise_median,
    )
}

