"""Ceteris-paribus queries: grids, profiles, steps, slopes and their sensitivity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from probewise.functions.numeric import r6, share
from probewise.functions.ranks import exact_quantiles
from probewise.operators import columns as C
from probewise.operators import envelope as E
from probewise.operators import profiles as P
from probewise.plans.scorers import (
    DOC_STAIRS,
    ORDER_STAIRS,
    BatchScorer,
    PandasScorer,
    doc_stairs_shifted,
)
from probewise.sources import tables as T

SPANS = [1.0, 2.5, 5.0]
SIZES = [50, 200, 800]
SEEDS = 12


def _orders(spark, sf_dir, features=None):
    t = T.order_features(spark, sf_dir, features or ORDER_STAIRS.features)
    return t, C.column_stats(t, features or ORDER_STAIRS.features)


def _docs(spark, sf_dir):
    t = T.doc_features(spark, sf_dir)
    return t, C.column_stats(t, T.DOC_FEATURES)


def cp_grid(spark, sf_dir):
    t, stats = _orders(spark, sf_dir)
    s = P.sweep_rows(t, stats, ORDER_STAIRS.features, span=2.5)
    reach = lambda c: (F.col(c) - F.col("x")) / F.col("x_std")
    return s.select(
        "row_id", "feature", r6("lo", 3).alias("z_first"), r6("hi", 3).alias("z_last"),
        r6(reach("lo")).alias("reach_down"), r6(reach("hi")).alias("reach_up"),
    )


def full_grid(spark, sf_dir):
    t, stats = _orders(spark, sf_dir, T.ORDER_FEATURES)
    bounds = C.stats_long(stats, T.ORDER_FEATURES).select(
        "feature", F.col("min").alias("lo"), F.col("max").alias("hi")
    )
    return P.grid_points(bounds, 120).select("feature", "grid_idx", r6("z", 4).alias("z"))


def trimmed_bounds(t, stats, feature):
    """(grid_name, lo, hi): between the 5th and 95th percentile, and median +- 1 std."""
    q = exact_quantiles(t, feature, [0.05, 0.5, 0.95])
    one = C.attach(q, stats)
    std = F.col(f"st.{feature}_std")
    return one.select(
        F.inline(
            F.array(
                F.struct(F.lit("p5_p95").alias("grid_name"), F.col("q")[0].alias("lo"),
                         F.col("q")[2].alias("hi")),
                F.struct(F.lit("median_1sd").alias("grid_name"),
                         (F.col("q")[1] - std).alias("lo"), (F.col("q")[1] + std).alias("hi")),
            )
        )
    )


def trimmed_grid(spark, sf_dir):
    t, stats = _orders(spark, sf_dir, ["qty"])
    points = P.grid_points(trimmed_bounds(t, stats, "qty"), 120)
    return points.select("grid_name", "grid_idx", r6("z").alias("z"))


def cp_profile(spark, sf_dir):
    t, stats = _docs(spark, sf_dir)
    points = P.cp_profiles(t, stats, DOC_STAIRS, T.DOC_FEATURES, n=200, span=2.5)
    return points.select("row_id", "feature", "grid_idx", r6("z").alias("z"), r6("p").alias("p"))


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-(0.002 * (x[:, 0] - 390.0) - 0.5 * (x[:, 1] - 6.4))))


def _outside_profile(spark, sf_dir, scorer):
    t, stats = _docs(spark, sf_dir)
    points = P.cp_profiles(t, stats, scorer, ["n_words", "chars_per_word"], n=200, span=2.5)
    return points.select("row_id", "feature", "grid_idx", r6("p").alias("p"))


def cp_profile_pandas(spark, sf_dir):
    """The same profile through a vectorised Python scorer (any outside model)."""
    return _outside_profile(spark, sf_dir, PandasScorer(_logistic, ["n_words", "chars_per_word"]))


def cp_profile_batch(spark, sf_dir):
    """The same through a model that each worker loads once."""
    return _outside_profile(spark, sf_dir, BatchScorer(lambda: _logistic, ["n_words", "chars_per_word"]))


def cp_summary(spark, sf_dir):
    t, stats = _orders(spark, sf_dir)
    names = ORDER_STAIRS.features
    s = P.profile_summary(P.sweep_rows(t, stats, names, span=2.5), ORDER_STAIRS, names)
    return s.select("row_id", "feature", r6("p_min").alias("p_min"), r6("p_max").alias("p_max"),
                    r6("swing").alias("swing"), "crosses")


def cp_steps(spark, sf_dir):
    t, stats = _orders(spark, sf_dir)
    names = ORDER_STAIRS.features
    s = P.profile_summary(P.sweep_rows(t, stats, names, span=2.5), ORDER_STAIRS, names)
    return s.select("row_id", "feature", "n_big", r6("largest").alias("largest"),
                    r6("step_left", 3).alias("step_left"), r6("step_right", 3).alias("step_right"))


def cp_grid_sensitivity(spark, sf_dir):
    """Span x resolution: swing, largest step and impossible share. ``n`` 0 is the exact answer, from
    the scorer's own edges instead of a grid."""
    t, stats = _docs(spark, sf_dir)
    band = E.ratio_bounds(t, [("n_chars", "n_words")])
    settings = F.array(
        *[F.struct(F.lit(s).alias("span"), F.lit(n).alias("n")) for s in SPANS for n in SIZES]
    )
    rows = C.attach(t, band, "band").select("*", F.inline(settings))
    sweeps = P.sweep_rows(rows, stats, ["n_chars"], span=F.col("span"))
    out = E.outside(F.col("z"), F.col("n_words"), F.col("band.n_chars_lo"), F.col("band.n_chars_hi"))
    s = P.profile_summary(sweeps, DOC_STAIRS, ["n_chars"], "n", ("row_id", "span", "n"),
                          [share(out).alias("impossible")])
    spans = F.explode(F.array(*[F.lit(v) for v in SPANS])).alias("span")
    exact = P.sweep_rows(C.attach(t, band, "band").select("*", spans), stats, ["n_chars"], span=F.col("span"))
    bounds = (F.col("n_words") * F.col("band.n_chars_lo"), F.col("n_words") * F.col("band.n_chars_hi"))
    exact = P.exact_summary(exact, DOC_STAIRS, "n_chars").withColumn("impossible", E.share_outside(*bounds))
    s = s.select("row_id", "span", "n", "swing", "largest", "step_left", "impossible").unionByName(
        exact.select("row_id", "span", F.lit(0).alias("n"), "swing", "largest", "step_left", "impossible"))
    return s.select("row_id", "span", "n", r6("swing").alias("swing"), r6("largest").alias("largest"),
                    r6("step_left", 3).alias("step_left"), r6("impossible").alias("impossible"))


def cp_seed_sensitivity(spark, sf_dir):
    """Twelve shifted scorers over one grid: spread of the swing and of every point."""
    t, stats = _docs(spark, sf_dir)
    scorer = doc_stairs_shifted("seed")
    seeds = F.explode(F.array(*[F.lit(s) for s in range(SEEDS)])).alias("seed")
    sweeps = P.sweep_rows(t, stats, ["n_words"], span=2.5)
    points = P.grid_points(sweeps, 200).select("*", seeds)
    points = scorer.score_at(points, "z", ["n_words"])
    per_point = points.groupBy("row_id", "grid_idx").agg(F.stddev_pop("p").alias("sd"))
    spread = per_point.groupBy("row_id").agg(
        F.percentile("sd", F.lit(0.5)).alias("sd_median"), F.max("sd").alias("sd_max")
    )
    per_seed = points.groupBy("row_id", "seed").agg((F.max("p") - F.min("p")).alias("swing"))
    swings = per_seed.groupBy("row_id").agg(
        F.percentile("swing", F.lit(0.5)).alias("swing_median"),
        F.min("swing").alias("swing_min"), F.max("swing").alias("swing_max"),
    )
    return swings.join(spread, "row_id").select(
        "row_id", *[r6(c).alias(c) for c in
                    ("swing_median", "swing_min", "swing_max", "sd_median", "sd_max")]
    )


def cp_slope(spark, sf_dir):
    t, stats = _orders(spark, sf_dir)
    names = ORDER_STAIRS.features
    s = P.two_point(t, stats, ORDER_STAIRS, names, [0.1, 0.3, 0.5, 1.0])
    return s.select("row_id", "feature", "h", r6("delta").alias("delta"), r6("slope").alias("slope"))


def cp_restricted(spark, sf_dir):
    """Swing and crossing inside the possible interval, and the share that survives."""
    t, stats = _docs(spark, sf_dir)
    band = E.ratio_bounds(t, [("n_chars", "n_words")])
    rows = C.attach(t, band, "band")
    points = P.cp_profiles(rows, stats, DOC_STAIRS, ["n_chars"], n=200, span=2.5)
    bad = E.outside_keep_zero(
        F.col("z"), F.col("n_words"), F.col("band.n_chars_lo"), F.col("band.n_chars_hi")
    )
    ok = F.when(~bad, F.col("p"))
    s = points.groupBy("row_id").agg(
        (F.max("p") - F.min("p")).alias("full"),
        (F.max(ok) - F.min(ok)).alias("restricted"),
        ((F.max("p") >= 0.5) & (F.min("p") < 0.5)).alias("crosses_full"),
        F.coalesce((F.max(ok) >= 0.5) & (F.min(ok) < 0.5), F.lit(False)).alias("crosses_restricted"),
    )
    return s.select(
        "row_id", r6("full").alias("swing_full"), r6("restricted").alias("swing_restricted"),
        r6(F.col("restricted") / F.nullif(F.col("full"), F.lit(0.0))).alias("surviving"),
        "crosses_full", "crosses_restricted",
    )


def cp_feature_summary(spark, sf_dir):
    """Every row and feature against its own strongest partner: impossible share and swing."""
    t = T.order_features(spark, sf_dir)
    names = ORDER_STAIRS.features
    stats = C.column_stats(t, names)
    chosen = C.strongest_partners(t.where(C.train_rows()), T.ORDER_FEATURES)
    pairs = [(a, b) for a, b in E.partner_pairs(chosen) if a in names]
    rows = C.attach(t, E.ratio_bounds(t, pairs), "band")
    sweeps = P.sweep_rows(rows, stats, names, span=2.5).withColumns({
        "partner_value": E.partner_value(pairs), "_rlo": E.by_feature(pairs, "band", "lo"),
        "_rhi": E.by_feature(pairs, "band", "hi")})
    # with a zero partner every point counts as possible
    sweeps = E.count_outside(sweeps, 200, "partner_value", "_rlo", "_rhi")
    impossible = F.avg(F.coalesce("n_out", F.lit(0)) / 200).alias("impossible")
    s = P.profile_summary(sweeps, ORDER_STAIRS, names, 200, fixed=[impossible])
    return s.select("row_id", "feature", r6("impossible").alias("impossible"),
                    r6("swing").alias("swing"))


QUERIES = {
    f.__name__: f
    for f in (
        cp_grid, full_grid, trimmed_grid, cp_profile, cp_profile_pandas, cp_profile_batch, cp_summary, cp_steps,
        cp_grid_sensitivity, cp_seed_sensitivity, cp_slope, cp_restricted, cp_feature_summary,
    )
}
