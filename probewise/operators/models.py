"""Fitted scorers: Spark ML pipelines with the settings the probes are used with."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.operators.forest import ForestFit, on_driver
from probewise.operators.stored import StoredScorer, StoredTrees, packed_nodes
from probewise.operators.trees import SCALE, Trees, TreeScorer, forest_nodes, read_nodes
from probewise.plans.scorers import ExpressionScorer, MLScorer

# fixed values: size and leaf limit of the forest, size and depth of the boosted model
FOREST_TREES, FOREST_MIN_LEAF, FOREST_DEPTH, SEEDS, FOLDS = 300, 3, 30, 12, 10
# split candidates per column: Spark's splitter bins columns, exact splits try every value
FOREST_BINS = 256
#: Training rows up to which Spark ML's own forest is fitted. It sums a histogram for every node over all
#: tasks, so its time grows with the nodes; above, ``ForestFit`` grows the same kind of forest from cells.
SPARK_FOREST_ROWS = 1000
GBT_TREES, GBT_DEPTH = 100, 3


def forest(features: list[str], seed: int = 42, trees: int = FOREST_TREES) -> Pipeline:
    """Deep trees with a leaf limit; Spark's own default stops at depth 5 and 20 trees."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    trees = RandomForestClassifier(
        numTrees=trees, minInstancesPerNode=FOREST_MIN_LEAF, maxDepth=FOREST_DEPTH, maxBins=FOREST_BINS, seed=seed
    )
    return Pipeline(stages=[assembler, trees])


def boosted(features: list[str], seed: int = 42) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assembler, GBTClassifier(maxIter=GBT_TREES, maxDepth=GBT_DEPTH, seed=seed)])


def logistic(features: list[str], n: int) -> Pipeline:
    """Ridge-penalised logistic regression, C = 1 on columns scaled by their population std.

    That is the sum of the ``n`` training rows' losses plus half the squared weights. Spark averages
    the losses, hence 1/n, and its scaler divides by the sample std, hence (n - 1)/n more.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="raw")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features")
    penalty = (n - 1) / n**2 if n else 0.0
    fit = LogisticRegression(maxIter=2000, tol=1e-12, regParam=penalty, elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[assembler, scaler, fit])


def fit_all(jobs: list[tuple[Pipeline, DataFrame]]) -> list:
    """Fit several pipelines at once: each is a run of small jobs the cluster can overlap."""
    with ThreadPool(min(len(jobs), 8)) as pool:
        return pool.starmap(lambda est, train: est.fit(train), jobs)


#: Node tables of this application's fits, under the rows and parameters they came from.
_NODES: dict[tuple, pd.DataFrame] = {}
_NODES_KEPT, _ROWS_KEPT = 64, 4_000_000


def _rows_of(train: DataFrame) -> tuple:
    """Count and summed hash of the training rows: equal for equal rows in any order."""
    row = F.xxhash64(*sorted(train.columns)).cast("decimal(38,0)")
    return tuple(train.agg(F.count(F.lit(1)), F.sum(row)).first())


def _fitted_nodes(est: Pipeline, train: DataFrame) -> pd.DataFrame:
    """Nodes of the tree ensemble that ends the pipeline. The Python model is not made: its constructor
    asks the driver's JVM for every tree, which takes longer than the fit."""
    *before, trees = est.getStages()
    for stage in before:
        train = stage.transform(train)
    return read_nodes(trees._fit_java(train), train.sparkSession)


#: Packed trees of this application's larger fits: cuts, a table (seed, tree, n, nodes) and the nodes of each seed.
_STORED: dict[tuple, tuple[list[np.ndarray], DataFrame, int]] = {}
#: Nodes of all models of a scorer up to which they are sent to the tasks as arrays; beyond, they stay a table.
NODES_ON_DRIVER = 1_000_000


def _grown(features: list[str], seeds: list[int], train: DataFrame, n: int) -> dict[int, tuple[list[np.ndarray], DataFrame, int]]:
    """Forests with these seeds, all on the same cells; rows that Spark ML's assembler refuses are refused."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(train)
    rows = rows.select("label", vector_to_array("features").alias("features"))
    fit = ForestFit(rows, n, len(features), FOREST_TREES, FOREST_MIN_LEAF, FOREST_DEPTH, FOREST_BINS)
    packed = fit.packed(seeds)
    # a row a seed
    nodes = {r.seed: r.nodes for r in packed.groupBy("seed").agg(F.sum("n").alias("nodes")).collect()}
    return {s: (fit.cuts, packed, nodes[s]) for s in seeds}


def fit_nodes(jobs: list[tuple[str, Pipeline, DataFrame]]) -> list[pd.DataFrame]:
    """The node tables of several tree ensembles (parameters as text, estimator, training rows); one that
    was fitted before in this application, on equal rows with equal parameters, is not fitted again."""
    spark = jobs[0][2].sparkSession
    seen: dict[int, tuple] = {}
    for _, _, train in jobs:
        if id(train) not in seen:
            seen[id(train)] = _rows_of(train)
    keys = [(spark.sparkContext.applicationId, *seen[id(train)], name) for name, _, train in jobs]
    new = {k: (est, train) for k, (_, est, train) in zip(keys, jobs, strict=True) if k not in _NODES}
    if new:
        with ThreadPool(min(len(new), 8)) as pool:
            _NODES.update(zip(new, pool.starmap(_fitted_nodes, new.values()), strict=True))
    found = [_NODES[k] for k in keys]
    _forget()
    return found


def _forget() -> None:
    """Drop the oldest fits beyond ``_NODES_KEPT`` tables or ``_ROWS_KEPT`` nodes in all."""
    while len(_NODES) > _NODES_KEPT or len(_NODES) > 1 and sum(map(len, _NODES.values())) > _ROWS_KEPT:
        _NODES.pop(next(iter(_NODES)))


def _forest_name(features: list[str], seed: int) -> str:
    return f"forest {features} {FOREST_TREES} {seed}"


def _stored(trains: list[DataFrame], features: list[str], seeds: list[int], rows: dict[int, tuple]) -> dict[int, tuple[list[np.ndarray], DataFrame, int]]:
    """By place: the stored fit of each pair of training rows and seed that is too large for Spark ML's forest."""
    app = trains[0].sparkSession.sparkContext.applicationId
    key = lambda k: (app, *rows[id(trains[k])], _forest_name(features, seeds[k]))
    wanted = [k for k, t in enumerate(trains) if rows[id(t)][0] > SPARK_FOREST_ROWS]
    new: dict[int, list[int]] = {}
    for k in wanted:
        if key(k) not in _STORED:
            new.setdefault(id(trains[k]), []).append(k)
    # every table's fit has work for all tasks, but short steps between; a few overlap
    with ThreadPool(min(len(new), 4) or 1) as pool:
        made = pool.map(lambda ks: _grown(features, list(dict.fromkeys(seeds[k] for k in ks)), trains[ks[0]], rows[id(trains[ks[0]])][0]), new.values())
    for ks, fits in zip(new.values(), made, strict=True):
        _STORED.update({key(k): fits[seeds[k]] for k in ks})
    found = {k: _STORED[key(k)] for k in wanted}
    while len(_STORED) > _NODES_KEPT:
        _STORED.pop(next(iter(_STORED)))
    return found


def fit_forests(trains: list[DataFrame], features: list[str], seeds: list[int]) -> list[pd.DataFrame]:
    """The node table of one forest for each pair of training rows and seed, on the driver."""
    rows = {id(t): _rows_of(t) for t in {id(t): t for t in trains}.values()}
    return _on_driver(trains, features, seeds, _stored(trains, features, seeds, rows))


def _on_driver(trains: list[DataFrame], features: list[str], seeds: list[int], stored: dict[int, tuple]) -> list[pd.DataFrame]:
    found = {k: forest_nodes(on_driver(t.where(F.col("seed") == seeds[k]).orderBy("tree"), cuts)) for k, (cuts, t, _) in stored.items()}
    small = [k for k in range(len(trains)) if k not in found]
    if small:
        jobs = [(_forest_name(features, seeds[k]), forest(features, seeds[k]), trains[k]) for k in small]
        found.update(zip(small, fit_nodes(jobs), strict=True))
    return [found[k] for k in range(len(trains))]


def forests(trains: list[DataFrame], features: list[str], seeds: list[int]) -> Trees | StoredTrees:
    """One forest for each pair of training rows and seed, as one set of models: arrays on the driver, or a table
    where they have more than ``NODES_ON_DRIVER`` nodes."""
    rows = {id(t): _rows_of(t) for t in {id(t): t for t in trains}.values()}
    stored = _stored(trains, features, seeds, rows)
    if sum(n for _, _, n in stored.values()) <= NODES_ON_DRIVER:
        return Trees(_on_driver(trains, features, seeds, stored))
    tables: dict[int, tuple[DataFrame, list[int]]] = {}
    for k, (_, t, _) in stored.items():
        tables.setdefault(id(t), (t, []))[1].append(k)
    parts = []
    for t, ks in tables.values():
        place = [F.struct(F.lit(int(seeds[k])).cast("long").alias("seed"), F.lit(k).alias("model")) for k in ks]
        places = t.select("seed", "tree", "nodes", F.filter(F.array(*place), lambda p: p["seed"] == F.col("seed")).alias("at"))
        parts.append(places.select(F.explode("at.model").alias("model"), "tree", "nodes"))
    cuts, counts = {k: c for k, (c, _, _) in stored.items()}, [FOREST_TREES] * len(trains)
    small = [k for k in range(len(trains)) if k not in stored]
    if small:
        jobs = [(_forest_name(features, seeds[k]), forest(features, seeds[k]), trains[k]) for k in small]
        for k, nodes in zip(small, fit_nodes(jobs), strict=True):
            cuts[k], trees = packed_nodes(nodes, len(features))
            counts[k] = len(trees)
            parts.append(trains[0].sparkSession.createDataFrame([(k, i, b) for i, b in enumerate(trees)], "model int, tree int, nodes binary"))
    return StoredTrees(reduce(DataFrame.unionByName, parts), [cuts[k] for k in range(len(trains))], counts)


def scorer_of(spark, trees: Trees | StoredTrees, features: list[str]) -> TreeScorer | StoredScorer:
    return StoredScorer(trees, features) if isinstance(trees, StoredTrees) else TreeScorer(spark, trees, features)


def tree_scorer(train: DataFrame, features: list[str], seeds: list[int] | None = None) -> TreeScorer | StoredScorer:
    """The forest of seed 42, or those of ``seeds``, fitted to ``train``."""
    seeds = seeds or [42]
    return scorer_of(train.sparkSession, forests([train] * len(seeds), features, seeds), features)


def boosted_scorer(train: DataFrame, features: list[str]) -> ExpressionScorer:
    """The boosted model as a SQL expression: its trees are small enough for generated code."""
    return Trees(fit_nodes([(f"boosted {features} {GBT_TREES}", boosted(features), train)])).expression(features)


def importances(nodes: pd.DataFrame, features: list[str], spark) -> DataFrame:
    """One row per feature: the gini gain of its nodes times their weight, a share of each tree's and then of
    all; ranks break ties by feature position."""
    mass = nodes["weight"].to_numpy()
    p = nodes["value"].to_numpy() / SCALE
    impure = mass * 2.0 * p * (1.0 - p)
    first = np.searchsorted(nodes["tree"], nodes["tree"])
    on = np.flatnonzero(nodes["feature"] >= 0)
    left, right = (first[on] + nodes[c].to_numpy()[on] for c in ("left", "right"))
    gained = np.zeros((nodes["tree"].max() + 1, len(features)))
    # a leaf's vote is that of its rows, and so is an inner node's
    np.add.at(gained, (nodes["tree"].to_numpy()[on], nodes["feature"].to_numpy()[on]), impure[on] - impure[left] - impure[right])
    whole = gained.sum(1, keepdims=True)
    values = np.divide(gained, whole, out=np.zeros_like(gained), where=whole > 0).sum(0)
    values = values / (values.sum() or 1.0)
    order = sorted(range(len(features)), key=lambda i: (-values[i], i))
    rows = [(features[i], float(values[i]), r + 1) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


def out_of_fold(df: DataFrame, features: list[str], folds: int = FOLDS) -> DataFrame:
    """Every row scored by the forest that did not see its fold (column ``fold``), in one pass."""
    trees = forests([df.where(F.col("fold") != k) for k in range(folds)], features, [42] * folds)
    return scorer_of(df.sparkSession, trees, features).score(df, model=F.col("fold"))
