"""Feature tables derived from the given parquet tables.

Every table has ``row_id``, DOUBLE features, an INT ``label`` and a ``is_test`` flag that
depends on ``row_id`` alone, so the split costs no shuffle and is the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.functions.noise import uniform

ORDER_FEATURES = ["qty", "list_value", "gross", "net", "n_lines", "max_qty", "avg_disc"]
DOC_FEATURES = ["n_chars", "n_words", "chars_per_word"]
TEST_SHARE = 0.25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_test_flag(row_id: str = "row_id", seed: int = 42) -> Column:
    return uniform(seed, F.col(row_id)) < F.lit(TEST_SHARE)


def order_features(
    spark: SparkSession, sf_dir: str, features: list[str] | None = None
) -> DataFrame:
    """One row per order key. ``part`` is joined only when ``list_value`` is asked for."""
    features = features or ORDER_FEATURES
    lines = read(spark, sf_dir, "lineitem")
    if "list_value" in features:
        part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    exprs = {
        "qty": lambda: F.sum("l_quantity"),
        "list_value": lambda: F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 4),
        "gross": lambda: F.round(F.sum("l_extendedprice"), 4),
        "net": lambda: F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4),
        "n_lines": lambda: F.count(F.lit(1)).cast("double"),
        "max_qty": lambda: F.max("l_quantity"),
        "avg_disc": lambda: F.round(F.avg("l_discount"), 8),
    }
    per_order = lines.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        *[exprs[f]().alias(f) for f in features]
    )
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    return per_order.join(orders, "row_id").withColumn("is_test", hashed_test_flag())


def order_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys with a three-valued target, the input of the two-class filter."""
    status = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("target"),
    )


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; ``label`` is NULL for those without one, and fits and accuracies leave them out."""
    docs = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
    )
    labels = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("label")
    )
    return (
        docs.join(labels, "row_id", "left")
        .withColumn("chars_per_word", F.round(F.col("n_chars") / F.col("n_words"), 6))
        .withColumn("is_test", hashed_test_flag())
    )


def vec_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") < 5).cast("int").alias("label"),
        hashed_test_flag("vec_id").alias("is_test"),
    )


def vec_columns(vectors: DataFrame, dims: int) -> tuple[DataFrame, list[str]]:
    """The vector table with one column per dimension."""
    names = [f"d{i}" for i in range(dims)]
    cols = [F.col("x")[i].alias(n) for i, n in enumerate(names)]
    return vectors.select("row_id", *cols, "label", "is_test"), names
