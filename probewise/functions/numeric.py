from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero denominator; aggregates then skip it."""
    return a / F.nullif(b, F.lit(0.0))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of values that stand for ``weight`` rows each, nulls left out."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def tally(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out narrow rows before each is exploded into many: the work is set by the
    exploded volume, which adaptive coalescing of the small input cannot see."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)
