"""Reproducible noise: a function of its key only, never of the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | Column, *keys: Column) -> Column:
    """A number in (0, 1) from the first eight hex digits of md5(seed|key|..)."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", head.cast("string"), *[k.cast("string") for k in keys])
    digits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(4294967296.0)


def normal(seed: int | Column, *keys: Column) -> Column:
    """Standard normal noise by the Box-Muller transform of two keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, *keys, F.lit("r"))))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(seed, *keys, F.lit("a")))
