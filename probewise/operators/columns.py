"""Column statistics, z-scores, correlations, bands and splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probewise.functions.noise import normal
from probewise.functions.ranks import exact_quantiles, melt

BUCKET_DIGITS = 5


def train_rows() -> Column:
    return ~F.col("is_test")


def column_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and population std of TRAIN rows, min and max of ALL rows."""
    cols = []
    for f in features:
        train = F.when(train_rows(), F.col(f))
        cols += [
            F.avg(train).alias(f"{f}_mean"),
            F.stddev_pop(train).alias(f"{f}_std"),
            F.min(f).alias(f"{f}_min"),
            F.max(f).alias(f"{f}_max"),
        ]
    return df.agg(*cols)


def attach(df: DataFrame, one_row: DataFrame, name: str = "st") -> DataFrame:
    """A one-row result as a struct column, by a scalar subquery rather than a join."""
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def stats_long(stats: DataFrame, features: list[str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            *[F.col(f"{f}_{k}").alias(k) for k in ("mean", "std", "min", "max")],
        )
        for f in features
    ]
    return stats.select(F.inline(F.array(*rows)))


def zscored(
    df: DataFrame, stats: DataFrame, features: list[str], prefix: str = "z_", guard: bool = False
) -> DataFrame:
    def z(f: str) -> Column:
        std = F.col(f"st.{f}_std")
        if guard:
            std = F.when(std == 0, 1.0).otherwise(std)
        return (F.col(f) - F.col(f"st.{f}_mean")) / std

    return attach(df, stats).withColumns({f"{prefix}{f}": z(f) for f in features}).drop("st")


def pair_moments(df: DataFrame, features: list[str], kind: str = "corr") -> DataFrame:
    """Correlation or covariance (ddof 1) of every column pair a < b, in one pass."""
    fn = {"corr": F.corr, "cov": F.covar_samp}[kind]
    pairs = list(combinations(features, 2))
    if kind == "cov":
        pairs += [(f, f) for f in features]
    one = df.agg(*[fn(a, b).alias(f"v{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.inline(F.array(*rows)))


def strongest_partners(train: DataFrame, features: list[str]) -> DataFrame:
    """Per feature the column with the largest absolute correlation, itself excluded."""
    pairs = pair_moments(train, features)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    order = F.array(*[F.lit(f) for f in features])
    best = F.max(
        F.struct(
            F.abs("r").alias("abs_r"),
            (-F.array_position(order, F.col("b"))).alias("first"),
            F.col("b").alias("partner"),
            F.col("r"),
        )
    )
    return both.groupBy(F.col("a").alias("feature")).agg(best.alias("w")).select(
        "feature", "w.partner", "w.r"
    )


def reference_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """(reference, feature, value): TRAIN mean, median and the mean of each class."""
    long = melt(df.where(train_rows()), features, keep=["label"])
    named = F.concat(F.lit("class_"), F.col("label").cast("string")).alias("reference")
    by_class = long.where(F.col("label").isNotNull()).groupBy(named, "feature").agg(F.avg("value").alias("value"))
    mean = long.groupBy(F.lit("mean").alias("reference"), "feature").agg(
        F.avg("value").alias("value")
    )
    median = exact_quantiles(long, "value", [0.5], ["feature"]).select(
        F.lit("median").alias("reference"), "feature", F.col("q")[0].alias("value")
    )
    return by_class.unionByName(mean).unionByName(median)


def confidence_band(p: Column, borderline: float = 0.15, confident: float = 0.30) -> Column:
    """Open bands with a gap: exactly as far as the two strict comparisons reach."""
    conf = F.abs(p - 0.5)
    return F.when(conf < borderline, "borderline").when(conf > confident, "confident")


def half_open_band(p: Column) -> Column:
    conf = F.abs(p - 0.5)
    return (
        F.when(conf < 0.15, "borderline").when(conf < 0.30, "intermediate").otherwise("confident")
    )


def class_order(df: DataFrame, seed: int, label: str = "label") -> DataFrame:
    """Exact position of every row in the shuffled order of its class.

    The shuffle key is a hash, so its leading digits cut any class into even buckets, as many as a
    table of 1e11 rows needs to sort in small pieces; only the totals of buckets in use are ever
    brought together. Rows without a label are a class of their own.
    """
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("row_id").cast("string")))
    # a join on a null label would drop its rows
    named = F.coalesce(F.col(label).cast("string"), F.lit("none"))
    hashed = df.withColumns({"_key": text, "_class": named}).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    before = (
        Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        hashed.groupBy("_class", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_class",
            "_bucket",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy("_class")).alias("n_class"),
        )
    )
    inside = Window.partitionBy("_class", "_bucket").orderBy("_key", "row_id")
    return (
        hashed.withColumn("_pos", F.row_number().over(inside))
        .join(totals, ["_class", "_bucket"])
        .withColumn("class_pos", F.col("_before") + F.col("_pos"))
        .drop("_key", "_class", "_bucket", "_before", "_pos")
    )


def stratified_split(df: DataFrame, share: float = 0.25, seed: int = 42) -> DataFrame:
    placed = class_order(df.drop("is_test"), seed)
    is_test = F.col("class_pos") <= F.ceil(F.lit(share) * F.col("n_class"))
    return placed.withColumn("is_test", is_test).drop("class_pos", "n_class")


def kfold(df: DataFrame, folds: int = 10, seed: int = 42) -> DataFrame:
    placed = class_order(df, seed)
    fold = ((F.col("class_pos") - 1) % folds).cast("int")
    return placed.withColumn("fold", fold).drop("class_pos", "n_class")


def interaction_label(df: DataFrame, stats: DataFrame, a: str, b: str, strength: Column):
    """1 when z_a * ((1 - s) + s * sign(z_b)) plus keyed noise is positive."""
    z = zscored(df, stats, [a, b])
    flip = (1 - strength) + strength * F.signum(f"z_{b}")
    noise = normal(0, F.col("row_id"))
    score = F.col(f"z_{a}") * flip + 0.3 * noise
    return z.withColumn("label", (score > 0).cast("int")).drop(f"z_{a}", f"z_{b}")
