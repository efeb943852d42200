"""What-if curves: grids, ceteris-paribus profiles, ICE bundles and their averages.

A sweep row carries the bounds of one (row, feature) sweep; a grid index is exploded from it
and every value of the curve is a column expression of (lo, hi, index). Neighbouring points
are scored from the same row, so steps and slopes need neither a window nor a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probewise.functions.numeric import spread, weighted_mean
from probewise.operators.columns import attach

MOVES = 1e-9
ACTIVE = 1e-12
FLAT = 0.05


#: Grids of at most so many points keep step and position in one long; others take a decimal.
LONG_GRID = 1_000_000


def _top(n: int | str) -> int | str:
    return n - 1 if isinstance(n, int) else f"({n} - 1)"


def point_sql(i: str, n: str | int, lo: str = "lo", hi: str = "hi") -> str:
    """Grid value with both ends exact."""
    last = _top(n)
    return f"(CASE WHEN {i} = {last} THEN {hi} ELSE {lo} + {i} * (({hi} - {lo}) / {last}) END)"


def _entry(f: str, lo: Column, hi: Column) -> Column:
    return F.struct(
        F.lit(f).alias("feature"),
        F.col(f).alias("x"),
        F.col(f"st.{f}_mean").alias("x_mean"),
        F.col(f"st.{f}_std").alias("x_std"),
        lo.alias("lo"),
        hi.alias("hi"),
    )


def span_bounds(f: str, span: float | Column) -> tuple[Column, Column]:
    span = F.lit(float(span)) if not isinstance(span, Column) else span
    reach = span * F.col(f"st.{f}_std")
    return (
        F.greatest(F.col(f"st.{f}_min"), F.col(f) - reach),
        F.least(F.col(f"st.{f}_max"), F.col(f) + reach),
    )


def full_bounds(f: str) -> tuple[Column, Column]:
    return F.col(f"st.{f}_min"), F.col(f"st.{f}_max")


def sweep_rows(
    rows: DataFrame, stats: DataFrame, features: list[str], span: float | Column | None = None
) -> DataFrame:
    """One row per (row, feature): own value, bounds. ``span`` None is the full range."""
    entries = []
    for f in features:
        lo, hi = full_bounds(f) if span is None else span_bounds(f, span)
        entries.append(_entry(f, lo, hi))
    narrow = spread(rows, "row_id")
    return attach(narrow, stats).select(*rows.columns, F.inline(F.array(*entries)))


def grid_points(sweeps: DataFrame, n: int | str, at: Column | None = None) -> DataFrame:
    """Explode the grid index (``n`` points, or a column of that name) and add z. ``at`` lists the indices
    wanted where not all are."""
    top = F.lit(n - 1) if isinstance(n, int) else F.col(n) - 1
    # lists of indices are never empty; the outer form spares working them out once more to see that
    each = F.explode(F.sequence(F.lit(0), top)) if at is None else F.explode_outer(at)
    indexed = sweeps.withColumn("grid_idx", each)
    return indexed.withColumn("z", F.expr(point_sql("grid_idx", n)))


def wide_sql(lo: str = "lo", hi: str = "hi") -> str:
    """Is a grid wide enough that an index found by arithmetic is at most one off?"""
    return f"coalesce({hi} - {lo} > 1e-6 * greatest(abs({lo}), abs({hi})), false)"


def piece_starts(edges: str, n: int | str, lo: str = "lo", hi: str = "hi") -> Column:
    """Grid indices, ascending, at which a curve may take a new value that only steps at the values in the
    array column ``edges`` (z > edge); 0 is the first.

    An index follows from the place of its edge and is set right by the grid values beside it. A grid too
    narrow for that gives all its indices.
    """
    last = _top(n)
    z = lambda i: point_sql(f"({i})", n, lo, hi)
    guess = f"least(greatest(cast(floor((e - {lo}) / (({hi} - {lo}) / {last})) as int) + 1, 1), {last})"
    found = (
        f"transform(transform(filter({edges}, e -> e >= {lo} AND e < {hi}), e -> struct(e AS e, {guess} AS i)),"
        f" s -> s.i + CASE WHEN {z('s.i')} <= s.e THEN 1 WHEN {z('s.i - 1')} > s.e THEN -1 ELSE 0 END)"
    )
    return F.expr(
        f"CASE WHEN {last} > 0 AND {wide_sql(lo, hi)} THEN array_sort(array_distinct(concat(array(0), {found})))"
        f" ELSE sequence(0, {last}) END"
    )


def with_ends(starts: str) -> Column:
    """The first and the last index of every piece but the last one, whose last index is left out."""
    return F.expr(f"array_distinct(concat({starts}, filter(transform({starts}, s -> s - 1), s -> s >= 0)))")


def steps_only(scorer, features: list[str]) -> bool:
    """Are all steps of the scorer along these features known?"""
    edges = getattr(scorer, "edges", {})
    return bool(edges) and all(f in edges or f not in scorer.features for f in features)


def edges_of(scorer, features: list[str]) -> Column:
    """The edges of the swept feature (column ``feature``)."""
    none = F.array().cast("array<double>")
    if len(features) == 1:
        return F.array(*scorer.edge_columns(features[0])) if features[0] in scorer.features else none
    picked = [F.when(F.col("feature") == f, F.array(*scorer.edge_columns(f))) for f in features if f in scorer.features]
    return F.coalesce(*picked, none)


def alike(rows: DataFrame, scorer, swept: list[str]) -> DataFrame:
    """Rows that the scorer cannot tell apart once ``swept`` is overwritten, as one row each: ``cell``, the
    scorer's other features, ``weight`` (rows) and ``curves`` (row ids)."""
    others = [f for f in scorer.features if f not in swept]
    cell = F.struct(*[scorer.seen_column(f).alias(f) for f in others]).alias("cell")
    # rows are dealt by row_id already, so the first grouping adds no shuffle
    each = rows.groupBy("row_id", cell).agg(*[F.min(f).alias(f) for f in others], F.count(F.lit(1)).alias("weight"))
    return each.groupBy("cell").agg(
        *[F.min(f).alias(f) for f in others], F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("curves"))


def cp_profiles(
    rows: DataFrame,
    stats: DataFrame,
    scorer,
    features: list[str],
    n: int = 200,
    span: float | None = 2.5,
) -> DataFrame:
    """(row_id, feature, grid_idx, z, p) and the columns of the row."""
    points = grid_points(sweep_rows(rows, stats, features, span), n)
    return scorer.score_at(points, "z", features)


def with_next(points: DataFrame, n: int | str) -> DataFrame:
    """Add the next grid value; the last point is its own neighbour (a step of zero)."""
    return points.withColumn("z_next", F.expr(point_sql(f"least(grid_idx + 1, {_top(n)})", n)))


def profile_summary(
    sweeps: DataFrame, scorer, features: list[str], n: int | str = 200,
    keys=("row_id", "feature"), extra=(), big: float = 0.01, fixed=(),
) -> DataFrame:
    """One row per curve: swing, crossing of 0.5, number of steps above ``big``, the largest
    step with the edges it runs between, any ``extra`` aggregates of the points, and any ``fixed`` ones of
    columns that all points of a curve share.

    Rows are partitioned by ``row_id`` before the explosion, so the grouping adds no shuffle. Of a scorer that
    only steps, the points beside its edges are scored: between them nothing changes.
    """
    at = None
    if steps_only(scorer, features) and not extra:
        sweeps = sweeps.withColumn("_edges", edges_of(scorer, features))
        sweeps = sweeps.withColumn("_starts", piece_starts("_edges", n)).drop("_edges")
        at = with_ends("_starts")
    points = with_next(grid_points(sweeps, n, at), n)
    points = scorer.score_at(points, "z", features, "p")
    points = scorer.score_at(points, "z_next", features, "p_next")
    step = F.abs(F.col("p_next") - F.col("p"))
    # step (to 1e-12, below which differences are rounding) and position in one number: a plain max
    # keeps the first of equal steps and stays in the hash aggregate, where a max over structs would
    # sort the exploded rows. Steps of probabilities are at most 1, so a long holds a million points;
    # where the number of points is not known to be below that, a decimal holds any.
    kind = "long" if isinstance(n, int) and n <= LONG_GRID else "decimal(38,0)"
    points_of = (F.lit(n) if isinstance(n, int) else F.lit(2**31)).cast(kind if kind == "long" else "decimal(11,0)")
    size = F.floor(step * 1e12 + 0.5).cast("long" if kind == "long" else "decimal(20,0)")
    code = (size * points_of + (points_of - 1 - F.col("grid_idx"))).cast(kind)
    curves = points.groupBy(*keys).agg(
        F.min("p").alias("p_min"),
        F.max("p").alias("p_max"),
        F.sum((step > big).cast("long")).alias("n_big"),
        F.max(step).alias("largest"),
        F.max(code).alias("_code"),
        F.max(points_of).alias("_points"),
        F.max("lo").alias("_lo"),
        F.max("hi").alias("_hi"),
        *extra,
        *fixed,
    )
    step_idx = F.col("_points") - 1 - F.col("_code") % F.col("_points")
    curves = curves.withColumn("step_idx", step_idx.cast("long"))
    return curves.withColumns(
        {
            "swing": F.col("p_max") - F.col("p_min"),
            "crosses": (F.col("p_max") >= 0.5) & (F.col("p_min") < 0.5),
            "step_left": F.expr(point_sql("step_idx", n, "_lo", "_hi")),
            "step_right": F.expr(point_sql(f"least(step_idx + 1, {_top(n)})", n, "_lo", "_hi")),
        }
    ).drop("_code", "_points", "_lo", "_hi")


def exact_summary(sweeps: DataFrame, scorer, feature: str) -> DataFrame:
    """The sweeps with ``swing``, ``largest`` and ``step_left`` of curves that only step at the scorer's own
    edges of the feature (``z > edge``), so that the answer has no resolution.

    The pieces between the edges inside a sweep are scored once each, in an array of the row. Of equal
    steps the first counts; a curve without an edge has no step: largest 0, step_left null.
    """
    edges = F.array(*scorer.edge_columns(feature))
    inside = F.filter(edges, lambda e: (e >= F.col("lo")) & (e < F.col("hi")))
    found = sweeps.withColumn("_edges", inside)
    # a piece ends at its edge, which still belongs to it; the last one ends with the sweep
    found = found.withColumn("_ends", F.concat("_edges", F.array("hi")))
    found = found.withColumn("_levels", F.expr(f"transform(_ends, _z -> {scorer.sql({feature: '_z'})})"))
    after = F.slice("_levels", F.lit(2), F.greatest(F.size("_levels") - 1, F.lit(0)))
    before = F.slice("_levels", F.lit(1), F.greatest(F.size("_levels") - 1, F.lit(0)))
    found = found.withColumn("_steps", F.zip_with(before, after, lambda a, b: F.round(F.abs(b - a), 12)))
    largest = F.array_max("_steps")
    return found.withColumns({
        "swing": F.array_max("_levels") - F.array_min("_levels"), "largest": F.coalesce(largest, F.lit(0.0)),
        "step_left": F.get("_edges", (F.array_position("_steps", largest) - 1).cast("int")),
    }).drop("_edges", "_ends", "_levels", "_steps")


def curve_slopes(points: DataFrame, keys=("row_id", "feature")) -> DataFrame:
    """Slopes of stored curves (any scorer): central inside, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy("grid_idx")
    side = lambda c, fn: F.coalesce(fn(c).over(w), F.col(c))
    rise = side("p", F.lead) - side("p", F.lag)
    return points.withColumn("slope", rise / (side("z", F.lead) - side("z", F.lag)))


def slope_points(sweeps: DataFrame, scorer, features: list[str], n: int | str) -> DataFrame:
    """Points with p and slope, both neighbours scored from the same row."""
    points = grid_points(sweeps, n)
    left, right = "greatest(grid_idx - 1, 0)", f"least(grid_idx + 1, {_top(n)})"
    points = points.withColumns(
        {"z_left": F.expr(point_sql(left, n)), "z_right": F.expr(point_sql(right, n))}
    )
    for at, out in (("z", "p"), ("z_left", "p_left"), ("z_right", "p_right")):
        points = scorer.score_at(points, at, features, out)
    slope = (F.col("p_right") - F.col("p_left")) / (F.col("z_right") - F.col("z_left"))
    return points.withColumn("slope", slope)


def bundle_summary(points: DataFrame, keys=("feature",), weight: str | None = None) -> DataFrame:
    """One pass over a bundle with slopes to one row per grid point.

    Up and down movers are counted apart, so who moves against the average is known once
    the average slope is, without a second pass. ``weight`` names the number of rows that a point stands for;
    such points are few, and their spread is taken around the average.
    """
    slope = F.col("slope")
    if weight is None:
        of, mean, spread_of = F.lit(1).cast("long"), F.avg, F.stddev_pop(slope)
    else:
        of, mean = F.col(weight), lambda c: weighted_mean(F.col(c) if isinstance(c, str) else c, F.col(weight))
        points = points.withColumn("_mean", F.sum(slope * of).over(Window.partitionBy(*keys, "grid_idx"))
                                   / F.sum(F.when(slope.isNotNull(), of)).over(Window.partitionBy(*keys, "grid_idx")))
        spread_of = F.sqrt(mean((slope - F.col("_mean")) * (slope - F.col("_mean"))))
    per_point = points.groupBy(*keys, "grid_idx").agg(
        F.min("z").alias("z"),
        F.sum(of).alias("n"),
        mean("p").alias("pdp"),
        mean(slope).alias("mean_slope"),
        spread_of.alias("sd_slope"),
        F.sum((slope > MOVES).cast("long") * of).alias("up"),
        F.sum((slope < -MOVES).cast("long") * of).alias("down"),
    )
    moving = F.col("up") + F.col("down")
    against = (
        F.when(F.col("mean_slope") > ACTIVE, F.col("down"))
        .when(F.col("mean_slope") < -ACTIVE, F.col("up"))
        .otherwise(moving)
    )
    return per_point.withColumns({"moving": moving, "against": against}).withColumn(
        "against_share", F.col("against") / F.greatest(F.col("moving"), F.lit(1))
    )


def steepest(bundle: DataFrame, keys=("feature",)) -> DataFrame:
    """The first grid point whose average slope is within rounding of the largest."""
    top = Window.partitionBy(*keys)
    size = F.abs("mean_slope")
    near = bundle.withColumn("_top", F.max(size).over(top)).where(
        size >= F.col("_top") * (1 - 1e-9)
    )
    return near.groupBy(*keys).agg(
        F.min(F.struct("grid_idx", "z", "mean_slope", "against_share", "moving", "n")).alias("w")
    ).select(
        *keys,
        F.col("w.grid_idx").alias("steep_idx"),
        F.col("w.z").alias("steep_z"),
        F.col("w.mean_slope").alias("steep_slope"),
        F.col("w.against_share").alias("against_at_steepest"),
        F.col("w.moving").alias("moving_at_steepest"),
        F.col("w.n").alias("n_rows"),
    )


def two_point(
    rows: DataFrame, stats: DataFrame, scorer, features: list[str], hs: list[float]
) -> DataFrame:
    """(row_id, feature, h, delta, slope): the model's change across +-h std."""
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(float(h)).alias("h"),
            (F.col(f) + F.lit(float(h)) * F.col(f"st.{f}_std")).alias("x_up"),
            (F.col(f) - F.lit(float(h)) * F.col(f"st.{f}_std")).alias("x_down"),
        )
        for f in features
        for h in hs
    ]
    probes = attach(rows, stats).select(*rows.columns, F.inline(F.array(*entries)))
    probes = scorer.score_at(probes, "x_up", features, "p_up")
    probes = scorer.score_at(probes, "x_down", features, "p_down")
    delta = F.col("p_up") - F.col("p_down")
    return probes.withColumns({"delta": delta, "slope": delta / (2 * F.col("h"))})
