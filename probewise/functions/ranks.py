"""Exact order statistics without bringing a group to one task.

Rows are first collapsed to distinct values with their counts (so a value held by a third
of the rows is one row), then range-partitioned; positions inside a partition plus the
totals of the partitions before it give every rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probewise.functions.materialise import materialise


def _place(df: DataFrame, value: str, keys: list[str], measures: dict[str, Column]):
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(c).alias(name) for name, c in measures.items()])
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # partition numbers are only stable once written: range bounds come from a sample
    placed = materialise(
        counted.repartitionByRange(parts, *keys, value).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    per_part = Window.partitionBy(*keys)
    before = per_part.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_part").agg(
        *[F.sum(name).alias(name) for name in measures]
    )
    offsets = sizes.select(
        *keys,
        "_part",
        *[F.col(n).alias(f"_size_{n}") for n in measures],
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in measures],
        *[F.sum(n).over(per_part).alias(f"{n}_total") for n in measures],
    )
    return placed, offsets


def _number(placed: DataFrame, offsets: DataFrame, value, keys, measures) -> DataFrame:
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    below = [
        (F.col(f"_before_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_below")
        for n in measures
    ]
    totals = [f"{n}_total" for n in measures]
    return placed.join(offsets, [*keys, "_part"]).select(
        *keys, value, *measures, *totals, *below
    )


def prefix_counts(
    df: DataFrame,
    value: str,
    keys: list[str] | tuple = (),
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Distinct (keys, value) with each measure, its total per key and its sum below."""
    keys = list(keys)
    measures = measures or {"n": F.lit(1).cast("long")}
    placed, offsets = _place(df, value, keys, measures)
    return _number(placed, offsets, value, keys, measures)


def average_ranks(df: DataFrame, value: str, keys=(), out: str = "rank") -> DataFrame:
    """Distinct (keys, value) with the 1-based average rank of its ties and ``n_total``."""
    placed = prefix_counts(df, value, keys)
    rank = F.col("n_below") + (F.col("n") + 1) / 2.0
    return placed.select(*keys, value, rank.alias(out), "n_total")


def exact_quantiles(
    df: DataFrame, value: str, qs: list[float], keys=(), out: str = "q", weight: str | None = None
) -> DataFrame:
    """One row per key: array ``out`` of linearly interpolated quantiles, and ``n_rows``. ``weight`` names
    the number of rows that a row stands for."""
    keys = list(keys)
    measures = {"n": F.lit(1).cast("long") if weight is None else F.col(weight)}
    placed, offsets = _place(df, value, keys, measures)
    position = [F.lit(float(q)) * (F.col("n_total") - 1) for q in qs]
    wanted = [f(h) for h in position for f in (F.floor, F.ceil)]
    # only the few partitions that hold a wanted rank are read again
    holds = [
        (F.col("_before_n") <= k) & (k < F.col("_before_n") + F.col("_size_n")) for k in wanted
    ]
    keep = holds[0]
    for h in holds[1:]:
        keep = keep | h
    numbered = _number(placed, offsets.where(keep), value, keys, measures)

    def at(rank: Column) -> Column:
        hit = (F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    picks = []
    for i, h in enumerate(position):
        picks += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}")]
    picked = numbered.groupBy(*keys).agg(F.max("n_total").alias("n_rows"), *picks)
    values = []
    for i, q in enumerate(qs):
        h = F.lit(float(q)) * (F.col("n_rows") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        values.append(lo + (hi - lo) * (h - F.floor(h)))
    return picked.select(*keys, "n_rows", F.array(*values).alias(out))


def exact_median(df: DataFrame, value: str, keys=(), out: str = "median", weight: str | None = None) -> DataFrame:
    return exact_quantiles(df, value, [0.5], keys, weight=weight).select(
        *keys, "n_rows", F.col("q")[0].alias(out)
    )


def melt(df: DataFrame, names: list[str], keep=(), key="feature", value="value") -> DataFrame:
    """Columns to (key, value) rows, so that many columns share one ordering job."""
    pairs = [F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names]
    return df.select(*keep, F.inline(F.array(*pairs)))


def _ranked(df: DataFrame, value: str, other: str, keys: list[str], weight: str, out: str) -> DataFrame:
    """``df`` with ``out``, the rank of ``value`` (ties on their average) centred on its mean, each row
    standing for ``weight`` rows. Nothing is joined on the value.

    Rows are dealt by range of (keys, value, other), so one value may cover many partitions. A partition
    knows the places of its rows from the totals of those before it; only its least and its greatest value
    can go on in others, and their parts there come from a table of two rows a partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *keys, value, other).withColumn("_part", F.spark_partition_id()))
    each = dealt.groupBy(*keys, "_part").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum(weight).alias("_mass"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({
        "_before": F.coalesce(F.sum("_mass").over(ahead), F.lit(0)), "_all": F.sum("_mass").over(Window.partitionBy(*keys)),
    }).drop("_mass")
    each = materialise(each)

    # the weight of a partition's two end values in it, and of the same value in earlier and later ones
    met = dealt.join(each, [*keys, "_part"]).where((F.col(value) == F.col("_low")) | (F.col(value) == F.col("_high")))
    ends = met.groupBy(*keys, "_part", F.col(value).alias("_end")).agg(F.sum(weight).alias("_here"))
    run = Window.partitionBy(*keys, "_end").orderBy("_part")
    ends = ends.select(
        *keys, "_part", "_end",
        F.coalesce(F.sum("_here").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
        F.coalesce(F.sum("_here").over(run.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("_later"),
    )
    tails = ends.groupBy(*keys, "_part").agg(F.collect_list(F.struct("_end", "_earlier", "_later")).alias("_ends"))
    each = each.select(*keys, "_part", "_before", "_all").join(tails, [*keys, "_part"])

    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    at = F.filter("_ends", lambda e: e["_end"] == F.col(value))
    # a range frame takes all rows of the value, so the difference of the two is the value's weight here
    placed = dealt.join(each, [*keys, "_part"]).withColumns({
        "_upto": F.sum(weight).over(inside), "_same": F.sum(weight).over(Window.partitionBy(*keys, "_part", value)),
        "_earlier": F.coalesce(F.get(at, F.lit(0))["_earlier"], F.lit(0)),
        "_later": F.coalesce(F.get(at, F.lit(0))["_later"], F.lit(0)),
    })
    below = F.col("_before") - F.col("_earlier") + F.col("_upto") - F.col("_same")
    n = F.col("_earlier") + F.col("_same") + F.col("_later")
    return placed.select(*df.columns, (below + (n - F.col("_all")) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Rank correlation with ties on average ranks: (keys, rho, n, t). Rows that lack x or y are left out; rho is null
    where x or y has one value only."""
    keys = list(keys)
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, x, y)
        .agg(F.count(F.lit(1)).alias("m"))
    )
    # ranks are centred on their exact mean (n + 1) / 2, so plain sums are stable
    ranked = _ranked(_ranked(pairs, x, y, keys, "m", "_rx"), y, x, keys, "m", "_ry")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("m") * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("m") * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(F.col("m") * F.col("_ry") * F.col("_ry")).alias("_yy"),
        F.sum("m").alias("n"),
    )
    zero = F.lit(0.0)
    rho = F.col("_xy") / F.nullif(F.sqrt(F.col("_xx")), zero) / F.nullif(F.sqrt(F.col("_yy")), zero)
    return sums.select(*keys, rho.alias("rho"), "n").withColumn(
        "t", t_statistic(F.col("rho"), F.col("n"))
    )


def t_statistic(r: Column, n: Column) -> Column:
    """Null for a correlation of exactly 1 or -1."""
    return r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
