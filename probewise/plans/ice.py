"""ICE bundles, partial dependence, disagreement and derivative queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probewise.functions.materialise import materialise
from probewise.functions.numeric import r6, share, tally, weighted_mean
from probewise.functions.ranks import exact_median, exact_quantiles, t_statistic
from probewise.functions.student import p_value
from probewise.operators import columns as C
from probewise.operators import profiles as P
from probewise.plans.profiles import trimmed_bounds
from probewise.plans.scorers import DOC_STAIRS, ORDER_STAIRS, interaction_scorer
from probewise.sources import tables as T

N = 120
NAMES = ORDER_STAIRS.features
STRENGTHS = [0.0, 0.25, 0.5, 0.75, 1.0]


def _orders(spark, sf_dir):
    t = T.order_features(spark, sf_dir, NAMES)
    return t, C.column_stats(t, NAMES)


def order_bundle(spark, sf_dir, features=("qty",)) -> DataFrame:
    """Bundle of every order on the full grid, reduced to one row per grid point."""
    t, stats = _orders(spark, sf_dir)
    sweeps = P.sweep_rows(t, stats, list(features))
    return P.bundle_summary(P.slope_points(sweeps, ORDER_STAIRS, list(features), N))


def order_ranges(spark, sf_dir, features=("qty",)) -> DataFrame:
    """Per row and feature the range of its curve and its own score, written once: the curves
    cost far more than their ranges, and every user of the ranges reads them more than once."""
    t, stats = _orders(spark, sf_dir)
    points = P.cp_profiles(t, stats, ORDER_STAIRS, list(features), N, None)
    points = points.withColumn("own", ORDER_STAIRS.column())
    return materialise(points.groupBy("row_id", "feature").agg(
        (F.max("p") - F.min("p")).alias("range"), F.max("own").alias("own")
    ))


def edge_change(spark, sf_dir, features=("qty",)) -> DataFrame:
    """The two ends of every curve: only those two points are scored."""
    t, stats = _orders(spark, sf_dir)
    s = P.sweep_rows(t, stats, list(features))
    s = ORDER_STAIRS.score_at(s, "lo", list(features), "p_first")
    s = ORDER_STAIRS.score_at(s, "hi", list(features), "p_last")
    return s.withColumn("net", F.col("p_last") - F.col("p_first"))


def ice_curves(spark, sf_dir):
    t = T.doc_features(spark, sf_dir)
    points = P.cp_profiles(t, C.column_stats(t, T.DOC_FEATURES), DOC_STAIRS, ["n_words"], N, None)
    return points.select("row_id", "grid_idx", r6("z").alias("z"), r6("p").alias("p"))


def ice_centred(spark, sf_dir):
    t = T.doc_features(spark, sf_dir)
    points = P.cp_profiles(t, C.column_stats(t, T.DOC_FEATURES), DOC_STAIRS, ["n_words"], N, None)
    points = DOC_STAIRS.score_at(points, "lo", ["n_words"], "p_first")
    return points.select("row_id", "grid_idx", r6(F.col("p") - F.col("p_first")).alias("change"))


def ice_centred_mean(spark, sf_dir):
    t, stats = _orders(spark, sf_dir)
    points = P.cp_profiles(t, stats, ORDER_STAIRS, ["qty"], N, None)
    points = ORDER_STAIRS.score_at(points, "lo", ["qty"], "p_first")
    return points.groupBy("grid_idx").agg(r6(F.avg(F.col("p") - F.col("p_first"))).alias("change"))


def pdp(spark, sf_dir):
    t, stats = _orders(spark, sf_dir)
    points = P.cp_profiles(t, stats, ORDER_STAIRS, NAMES, N, None)
    mean = points.groupBy("feature", "grid_idx").agg(F.min("z").alias("z"), F.avg("p").alias("pdp"))
    return mean.select("feature", "grid_idx", r6("z", 3).alias("z"), r6("pdp").alias("pdp"))


def ice_range(spark, sf_dir):
    ranges = order_ranges(spark, sf_dir)
    median = exact_median(ranges, "range")
    one = ranges.agg(
        F.count(F.lit(1)).alias("n"), F.avg("range").alias("mean"), F.min("range").alias("lo"),
        F.max("range").alias("hi"), share(F.col("range") < P.FLAT).alias("flat"),
    )
    one = C.attach(one, median, "m")
    return one.select(
        "n", r6("m.median").alias("median"), r6("mean").alias("mean"), r6("lo").alias("min"),
        r6("hi").alias("max"), r6("flat").alias("flat"), r6(F.col("hi") / F.col("lo")).alias("ratio"),
    )


def range_histogram(spark, sf_dir):
    """Thirty equal bins between the smallest and largest range, the last one closed."""
    ranges = order_ranges(spark, sf_dir)
    ends = ranges.agg(F.min("range").alias("lo"), F.max("range").alias("hi"))
    width = (F.col("e.hi") - F.col("e.lo")) / 30
    at = F.floor((F.col("range") - F.col("e.lo")) / width)
    binned = C.attach(ranges, ends, "e").select(F.least(at, F.lit(29)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = ranges.sparkSession.range(30).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def ice_edge_modes(spark, sf_dir):
    first = F.col("p_first")
    return edge_change(spark, sf_dir, NAMES).groupBy("feature").agg(
        tally(first > 0.8).alias("above"), tally(first < 0.2).alias("below"),
        tally((first >= 0.2) & (first <= 0.8)).alias("between"),
    )


def ice_net_change(spark, sf_dir):
    edges = edge_change(spark, sf_dir, NAMES)
    q = exact_quantiles(edges, "net", [0.05, 0.5, 0.95], ["feature"])
    rising = edges.groupBy("feature").agg(tally(F.col("net") > 0).alias("rising"))
    return q.join(rising, "feature").select(
        "feature", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("p5", "median", "p95"))],
        "rising", "n_rows",
    )


def ice_net_cv(spark, sf_dir):
    spread = F.stddev_pop("net") / F.greatest(F.abs(F.avg("net")), F.lit(1e-12))
    return edge_change(spark, sf_dir, NAMES).groupBy("feature").agg(r6(spread).alias("cv"))


def ice_derivative(spark, sf_dir):
    b = order_bundle(spark, sf_dir)
    return b.select("grid_idx", r6("mean_slope").alias("mean_slope"), r6("sd_slope").alias("sd_slope"),
                    "up", "down")


def ice_derivative_rows(spark, sf_dir):
    """Slopes of stored curves by window, the path for scorers that are not expressions."""
    t = T.doc_features(spark, sf_dir)
    points = P.cp_profiles(t, C.column_stats(t, T.DOC_FEATURES), DOC_STAIRS, ["n_words"], N, None)
    s = P.curve_slopes(points.select("row_id", "feature", "grid_idx", "z", "p"))
    return s.select("row_id", "grid_idx", r6("slope").alias("slope"))


def ice_disagreement(spark, sf_dir):
    b = order_bundle(spark, sf_dir, NAMES)
    return b.select("feature", "grid_idx", r6("z", 3).alias("z"), r6("pdp").alias("pdp"), "moving",
                    "against", r6("against_share").alias("against_share"))


def ice_steepest(spark, sf_dir):
    s = P.steepest(order_bundle(spark, sf_dir, NAMES))
    return s.select("feature", "steep_idx", r6("steep_z", 3).alias("steep_z"),
                    r6("against_at_steepest").alias("against_at_steepest"), "moving_at_steepest",
                    "n_rows")


def pdp_active_range(spark, sf_dir):
    b = order_bundle(spark, sf_dir, NAMES).where(F.abs("mean_slope") > P.ACTIVE)
    return b.groupBy("feature").agg(r6(F.min("z"), 3).alias("z_from"), r6(F.max("z"), 3).alias("z_to"),
                                    F.count(F.lit(1)).alias("n_points"))


def spikes_of(bundle: DataFrame) -> DataFrame:
    w = Window.partitionBy("feature").orderBy("grid_idx")
    s = F.col("against_share")
    marked = bundle.withColumns({"_l": F.lag(s).over(w), "_r": F.lead(s).over(w),
                                 "_top": F.max(F.abs("mean_slope")).over(Window.partitionBy("feature"))})
    return marked.where((s >= F.col("_l")) & (s >= F.col("_r")) & (s > 0.05)).withColumn(
        "relative_slope", F.abs("mean_slope") / F.col("_top")
    )


def ice_spikes(spark, sf_dir):
    s = spikes_of(order_bundle(spark, sf_dir, NAMES))
    return s.select("feature", "grid_idx", r6("against_share").alias("against_share"), "moving",
                    r6("relative_slope", 5).alias("relative_slope"))


def ice_feature_table(spark, sf_dir):
    ranges = order_ranges(spark, sf_dir, NAMES)
    flat = ranges.groupBy("feature").agg(share(F.col("range") < P.FLAT).alias("flat"))
    median = exact_median(ranges, "range", ["feature"])
    b = order_bundle(spark, sf_dir, NAMES)
    worst = b.groupBy("feature").agg(F.max("against_share").alias("max_against"))
    table = flat.join(median, "feature").join(P.steepest(b), "feature").join(worst, "feature")
    return table.select("feature", *[r6(c).alias(c) for c in (
        "flat", "median", "against_at_steepest", "max_against")])


def dice_gate(spark, sf_dir):
    """Slope heterogeneity where the average moves, with both denominators side by side."""
    b = order_bundle(spark, sf_dir, NAMES)
    size = F.abs("mean_slope")
    # the 75th percentile is over the grid points of one feature: a bounded group
    gate = F.percentile(size, F.lit(0.75)).over(Window.partitionBy("feature"))
    still = (F.col("n") - F.col("moving")) / F.col("n")
    marked = b.withColumn("_gate", gate).withColumn("inside", size > F.col("_gate") * (1 + 1e-9))
    inside = lambda c: F.when(F.col("inside"), c)
    return marked.groupBy("feature").agg(
        F.sum(F.col("inside").cast("long")).alias("n_gate"),
        r6(F.percentile(inside(F.col("sd_slope") / F.greatest(size, F.lit(1e-12))), F.lit(0.5)), 5)
        .alias("sd_ratio"),
        r6(F.avg(inside(F.col("against") / F.col("n")))).alias("flips_all"),
        r6(F.avg(inside(F.col("against_share")))).alias("flips_movers"),
        r6(F.avg(inside(still))).alias("still_gate"),
        r6(F.sum(F.col("n") - F.col("moving")) / F.sum("n")).alias("still_grid"),
    )


def ice_grid_robustness(spark, sf_dir):
    """Five grids of one feature, tagged and swept in one job."""
    t, stats = _orders(spark, sf_dir)
    full = stats.select(
        F.inline(F.array(*[F.struct(F.lit(f"full_{n}").alias("grid_name"), F.col("qty_min").alias("lo"),
                                    F.col("qty_max").alias("hi"), F.lit(n).alias("n"))
                           for n in (40, 120, 400)])))
    trimmed = trimmed_bounds(t, stats, "qty").withColumn("n", F.lit(120))
    grids = full.unionByName(trimmed).agg(F.collect_list(F.struct("*")).alias("grids"))
    # the grids are the same for all rows, so rows that the scorer cannot tell apart share their curve
    cells = materialise(P.alike(t, ORDER_STAIRS, ["qty"]))
    rows = C.attach(cells, grids, "g").select(*cells.columns, F.inline("g.grids"))
    points = P.slope_points(rows, ORDER_STAIRS, ["qty"], "n")
    b = P.bundle_summary(points, ["grid_name"], "weight")
    ranges = materialise(points.groupBy("cell", "grid_name").agg(
        (F.max("p") - F.min("p")).alias("range"), F.max("curves").alias("curves")))
    is_flat = (F.col("range") < P.FLAT).cast("double")
    flat = ranges.groupBy("grid_name").agg(weighted_mean(is_flat, F.col("curves")).alias("flat"))
    median = exact_median(ranges, "range", ["grid_name"], weight="curves")
    table = flat.join(median, "grid_name").join(P.steepest(b, ["grid_name"]), "grid_name")
    return table.select("grid_name", *[r6(c).alias(c) for c in ("flat", "median", "against_at_steepest")])


def swing_ratio(spark, sf_dir):
    ranges = order_ranges(spark, sf_dir, NAMES)
    b = order_bundle(spark, sf_dir, NAMES).groupBy("feature").agg(
        (F.max("pdp") - F.min("pdp")).alias("pdp_swing"))
    mean = ranges.groupBy("feature").agg(F.avg("range").alias("mean"))
    median = exact_median(ranges, "range", ["feature"])
    table = b.join(mean, "feature").join(median, "feature")
    return table.select("feature", r6("pdp_swing").alias("pdp_swing"),
                        r6(F.col("pdp_swing") / F.col("median")).alias("to_median"),
                        r6(F.col("pdp_swing") / F.col("mean")).alias("to_mean"))


def interaction_curves(spark, sf_dir, strengths: list[float]) -> DataFrame:
    """The bundle of a scorer whose effect is flipped to a set degree, per strength."""
    t = T.order_features(spark, sf_dir, ["qty", "gross"])
    stats = C.column_stats(t, ["qty", "gross"])
    scorer = interaction_scorer("strength")
    # the grid is the same for all rows, so rows that the scorer cannot tell apart share their curve
    cells = materialise(P.alike(t, scorer, ["qty"]))
    rows = C.attach(cells, stats).withColumns({"lo": F.col("st.qty_min"), "hi": F.col("st.qty_max")}).withColumn(
        "strength", F.explode(F.array(*[F.lit(a) for a in strengths])))
    points = P.slope_points(rows, scorer, ["qty"], N)
    b = P.bundle_summary(points, ["strength"], "weight")
    ranges = points.groupBy("cell", "strength").agg(
        (F.max("p") - F.min("p")).alias("range"), F.max("curves").alias("curves"))
    median = exact_median(ranges, "range", ["strength"], weight="curves")
    swing = b.groupBy("strength").agg((F.max("pdp") - F.min("pdp")).alias("pdp_swing"),
                                      F.max("against_share").alias("max_against"))
    table = swing.join(median, "strength").join(P.steepest(b, ["strength"]), "strength")
    return table.withColumn("ratio", F.col("pdp_swing") / F.col("median"))


def interaction_control(spark, sf_dir):
    c = interaction_curves(spark, sf_dir, [1.0])
    return c.select(*[r6(n).alias(n) for n in ("against_at_steepest", "max_against", "pdp_swing", "median")])


def interaction_power(spark, sf_dir):
    c = interaction_curves(spark, sf_dir, STRENGTHS)
    return c.select("strength", *[r6(n).alias(n) for n in
                                  ("against_at_steepest", "pdp_swing", "median", "ratio")])


def confidence_vs_range(spark, sf_dir):
    """Does a confident row move less: correlation, its t statistic and p-value, and group medians."""
    ranges = order_ranges(spark, sf_dir).withColumn("conf", F.abs(F.col("own") - 0.5))
    one = ranges.agg(F.corr("conf", "range").alias("r"), F.count(F.lit(1)).alias("n"))
    banded = ranges.withColumn("band", C.confidence_band(F.col("own"))).where(F.col("band").isNotNull())
    medians = exact_median(banded, "range", ["band"])
    return C.attach(medians, one, "c").select(
        "band", "n_rows", r6("median").alias("median_range"), r6("c.r").alias("r"),
        r6(t_statistic(F.col("c.r"), F.col("c.n")), 4).alias("t"),
        r6(p_value(t_statistic(F.col("c.r"), F.col("c.n")), F.col("c.n") - 2), 9).alias("p"))


QUERIES = {
    f.__name__: f
    for f in (
        ice_curves, ice_centred, ice_centred_mean, pdp, ice_range, range_histogram, ice_edge_modes,
        ice_net_change, ice_net_cv, ice_derivative, ice_derivative_rows, ice_disagreement,
        ice_steepest, pdp_active_range, ice_spikes, ice_feature_table, dice_gate,
        ice_grid_robustness, swing_ratio, interaction_control, interaction_power,
        confidence_vs_range,
    )
}
