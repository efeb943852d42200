"""The perturbation cloud: independent draws around the column means, shared by all rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.functions.noise import normal
from probewise.operators.columns import attach

DRAWS = 5000
#: Doubles a task may hold for the cloud's products of columns: 256 MB.
MAX_MOMENT_VALUES = 32_000_000


def cloud(
    spark: SparkSession, stats: DataFrame, features: list[str], draws: int = DRAWS, seeds=(42,)
) -> DataFrame:
    """(seed, draw_id, z_f.., f..): z is keyed noise, f = mean + std * z in raw units."""
    ids = spark.range(draws).withColumnRenamed("id", "draw_id")
    ids = ids.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    z = {f"z_{f}": normal(F.col("seed"), F.col("draw_id"), F.lit(f)) for f in features}
    raw = {f: F.col(f"st.{f}_mean") + F.col(f"st.{f}_std") * F.col(f"z_{f}") for f in features}
    return attach(ids.withColumns(z), stats).withColumns(raw).drop("st")


@dataclass
class SharedCloud:
    """A scored cloud on its way to the tasks: draws x features, bounded by its parameters."""

    features: list[str]
    seeds: list[int]
    z: list[np.ndarray]
    f: list[np.ndarray]


def share_cloud(
    scored: DataFrame, features: list[str], draws: int, seeds, max_values: int = MAX_MOMENT_VALUES
) -> SharedCloud:
    """Bring a scored cloud together. Its size is set by draws, seeds and features alone, never by
    the tables. What counts is what a task makes of it: every draw becomes the products of its
    columns; ``max_values`` follows from the memory of a worker."""
    if draws * len(seeds) * (len(features) + 1) ** 2 > max_values:
        raise ValueError("cloud too large to share: lower draws or explain in batches of seeds")
    names = [f"z_{f}" for f in features]
    pdf = scored.select("seed", "draw_id", *names, "p").toPandas()
    pdf = pdf.sort_values(["seed", "draw_id"])
    parts = [pdf[pdf["seed"] == s] for s in seeds]
    return SharedCloud(
        list(features), list(seeds), [p[names].to_numpy() for p in parts],
        [p["p"].to_numpy() for p in parts],
    )
