"""Fitted forests and boosted trees as data: flat node arrays, boxes along sweeps, and SQL text.

A fitted model is saved and its nodes are read back as a table, so nothing walks it node by node over
the driver's gateway. Leaf values are whole numbers of 2^-40; their sums do not depend on the order of
trees, so every form below gives the same score to the last bit.

Along a sweep the other columns of a row stand still. Each tree then cuts the grid into boxes of one
leaf; a box adds its value where it begins and takes it away where it ends, and a running sum over the
grid is the score of every point. The work is that of the boxes, not of points times trees.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.functions.materialise import shared_folder
from probewise.plans.scorers import ExpressionScorer, RowScorer

SCALE = float(1 << 40)
#: Boxes that are followed at once (more wait their turn), and bytes of a block's grid of sums.
BOXES, GRID_BYTES = 1 << 18, 64 << 20


def read_nodes(model, spark) -> pd.DataFrame:
    """One row per node of a fitted ensemble, Spark ML's or its Java side alone: tree, id, feature (-1 at leaves), threshold, left, right,
    value (in 2^-40), weight (of the training rows) and the boosted flag. A forest's leaf votes with its share of class 1."""
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    java = model._java_obj if isinstance(model, JavaWrapper) else model
    java.save(path)
    stored = spark.read.parquet(f"{path}/data")
    boosted = java.getClass().getSimpleName().startswith("GBT")
    node, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    weight = F.get(stats, F.lit(0)) if boosted else F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    vote = node["prediction"] if boosted else F.get(stats, F.lit(1)) / weight
    found = stored.select(
        F.col("treeID").alias("tree"), node["id"].alias("id"),
        F.when(node["leftChild"] < 0, -1).otherwise(node["split"]["featureIndex"]).alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), vote.alias("vote"), weight.alias("weight"),
    ).toPandas()
    of_tree = np.array(java.treeWeights() if boosted else [1.0] * java.getNumTrees())
    found["value"] = np.round(found["vote"] * of_tree[found["tree"]] * SCALE).astype("int64")
    found["boosted"] = boosted
    return found.drop(columns="vote").sort_values(["tree", "id"], ignore_index=True)


def forest_nodes(grown: pd.DataFrame) -> pd.DataFrame:
    """The same table from a forest grown on cells, whose nodes hold ``n0`` and ``n1`` drawn rows."""
    weight = (grown["n0"] + grown["n1"]).to_numpy(float)
    vote = np.divide(grown["n1"].to_numpy(float), weight, out=np.zeros(len(grown)), where=weight > 0)
    return grown.drop(columns=["n0", "n1"]).assign(value=np.round(vote * SCALE).astype(np.int64), weight=weight, boosted=False)


class Trees:
    """Tree ensembles over the same columns, one or several models with a number each."""

    def __init__(self, nodes: Sequence[pd.DataFrame]):
        self.boosted = bool(nodes[0]["boosted"].iloc[0])
        trees, model, base = [], [], 0
        for k, n in enumerate(nodes):
            trees.append(n.assign(tree=n["tree"] + base))
            count = int(n["tree"].max()) + 1
            model += [k] * count
            base += count
        every = pd.concat(trees, ignore_index=True).sort_values(["tree", "id"], ignore_index=True)
        first = every.groupby("tree")["id"].transform("size").to_numpy()
        self.roots = np.flatnonzero(np.diff(every["tree"], prepend=-1))
        offset = self.roots[every["tree"]]
        if not (every["id"].to_numpy() == np.arange(len(every)) - offset).all() or not len(first):
            raise ValueError("nodes of a tree are numbered from 0 without gaps")
        self.feature = every["feature"].to_numpy(np.int32)
        self.threshold = every["threshold"].to_numpy(float)
        self.left = (every["left"].to_numpy() + offset).astype(np.int32)
        self.right = (every["right"].to_numpy() + offset).astype(np.int32)
        self.value = every["value"].to_numpy(np.int64)
        self.model = np.array(model)
        self.models = len(nodes)
        self.counts = np.bincount(self.model)
        # thresholds of a column in order, and each node's place among its column's
        self.cuts, self.place = {}, np.zeros(len(every), np.int32)
        for f in np.unique(self.feature[self.feature >= 0]):
            on = self.feature == f
            self.cuts[int(f)], self.place[on] = np.unique(self.threshold[on], return_inverse=True)

    def only(self, model: int) -> Trees:
        """One of the models by itself."""
        nodes = pd.DataFrame({"feature": self.feature, "threshold": self.threshold, "value": self.value, "boosted": self.boosted})
        size = np.diff(np.append(self.roots, len(nodes)))
        own = np.repeat(self.model == model, size)
        first = np.repeat(self.roots, size)
        nodes = nodes.assign(id=np.arange(len(nodes)) - first, left=self.left - first, right=self.right - first)
        nodes["tree"] = np.repeat(np.cumsum(self.model == model) - 1, size)
        return Trees([nodes[own]])

    def chances(self, sums: np.ndarray) -> np.ndarray:
        """P(class 1) from summed leaf values; models lie along axis 1."""
        if self.boosted:
            return 1.0 / (1.0 + np.exp(-2.0 * (sums / SCALE)))
        shape = [1, -1] + [1] * (sums.ndim - 2)
        return sums / (self.counts * SCALE).reshape(shape)

    def boxes(self, x: np.ndarray, swept: Sequence[int] = (), cuts: Sequence[np.ndarray] = (), sizes: Sequence[int] = ()) -> Iterator[tuple]:
        """(row, model, [(begin, end) per swept column], value) of the leaves that rows reach.

        ``cuts[k][row, place]`` is how many points of the row's grid in column ``swept[k]`` go left at
        the threshold of that place; ``sizes[k]`` is the number of points."""
        rows, t = len(x), len(self.roots)
        row, node, model = np.repeat(np.arange(rows), t), np.tile(self.roots, rows), np.tile(self.model, rows)
        box = [(np.zeros(len(row), np.int64), np.full(len(row), n)) for n in sizes]
        later = []
        while len(node) or later:
            if not len(node):
                row, node, model, box = later.pop()
            while len(node) > BOXES:
                half = len(node) // 2
                later.append((row[half:], node[half:], model[half:], [(a[half:], b[half:]) for a, b in box]))
                row, node, model, box = row[:half], node[:half], model[:half], [(a[:half], b[:half]) for a, b in box]
            f = self.feature[node]
            leaf = f < 0
            if leaf.any():
                yield row[leaf], model[leaf], [(a[leaf], b[leaf]) for a, b in box], self.value[node[leaf]]
                row, node, model, f = (v[~leaf] for v in (row, node, model, f))
                box = [(a[~leaf], b[~leaf]) for a, b in box]
            left = x[row, f] <= self.threshold[node]
            right = ~left
            ends, begins = [], []
            for (a, b), column, cut in zip(box, swept, cuts, strict=True):
                on = np.flatnonzero(f == column)
                at = cut[row[on], self.place[node[on]]]
                left[on], right[on] = a[on] < at, at < b[on]
                end, begin = b.copy(), a.copy()
                end[on], begin[on] = np.minimum(b[on], at), np.maximum(a[on], at)
                ends.append(end)
                begins.append(begin)
            box = [
                (np.concatenate([a[left], begin[right]]), np.concatenate([end[left], b[right]]))
                for (a, b), begin, end in zip(box, begins, ends, strict=True)
            ]
            row, model = (np.concatenate([v[left], v[right]]) for v in (row, model))
            node = np.concatenate([self.left[node[left]], self.right[node[right]]])

    def _cut(self, column: int, z: np.ndarray) -> np.ndarray:
        at = self.cuts.get(column, np.empty(0))
        return np.array([np.searchsorted(row, at, "right") for row in z], np.int64).reshape(len(z), len(at))

    def _blocks(self, rows: int, bytes_a_row: int) -> Iterator[slice]:
        step = max(1, min(BOXES // len(self.roots), GRID_BYTES // bytes_a_row))
        for a in range(0, rows, step):
            yield slice(a, min(rows, a + step))

    def score(self, x: np.ndarray) -> np.ndarray:
        """P of every row (axis 0) under every model (axis 1)."""
        out = np.empty((len(x), self.models))
        for part in self._blocks(len(x), 8 * self.models):
            sums = np.zeros((len(x[part]), self.models), np.int64)
            for row, model, _, value in self.boxes(x[part]):
                np.add.at(sums, (row, model), value)
            out[part] = self.chances(sums)
        return out

    def curves(self, x: np.ndarray, column: int, z: np.ndarray) -> np.ndarray:
        """P along one swept column: rows x models x points; ``z`` holds each row's ascending points."""
        n = z.shape[1]
        out = np.empty((len(x), self.models, n))
        for part in self._blocks(len(x), 8 * self.models * (n + 1)):
            sums = np.zeros((len(x[part]), self.models, n + 1), np.int64)
            for row, model, [(begin, end)], value in self.boxes(x[part], [column], [self._cut(column, z[part])], [n]):
                np.add.at(sums, (row, model, begin), value)
                np.subtract.at(sums, (row, model, end), value)
            out[part] = self.chances(np.cumsum(sums, 2)[:, :, :n])
        return out

    def surfaces(self, x: np.ndarray, columns: tuple[int, int], zx: np.ndarray, zy: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Blocks of rows with P over two swept columns: rows x models x points of zx x points of zy."""
        nx, ny = zx.shape[1], zy.shape[1]
        for part in self._blocks(len(x), 8 * self.models * (nx + 1) * (ny + 1)):
            sums = np.zeros((len(x[part]), self.models, nx + 1, ny + 1), np.int64)
            cuts = [self._cut(columns[0], zx[part]), self._cut(columns[1], zy[part])]
            for row, model, [(a, b), (c, d)], value in self.boxes(x[part], columns, cuts, [nx, ny]):
                np.add.at(sums, (row, model, a, c), value)
                np.subtract.at(sums, (row, model, b, c), value)
                np.subtract.at(sums, (row, model, a, d), value)
                np.add.at(sums, (row, model, b, d), value)
            np.cumsum(sums, 2, out=sums)
            np.cumsum(sums, 3, out=sums)
            yield part, self.chances(sums[:, :, :nx, :ny])

    def leaf_boxes(self, features: list[str]) -> pd.DataFrame:
        """Every leaf as a row: model, tree, value, and the bounds ``<f>_above < f <= <f>_upto``."""
        found = []
        for tree, root in enumerate(self.roots):
            todo = [(int(root), [-np.inf] * len(features), [np.inf] * len(features))]
            while todo:
                node, above, upto = todo.pop()
                f = self.feature[node]
                if f < 0:
                    found.append([int(self.model[tree]), tree, int(self.value[node]), *above, *upto])
                    continue
                at = float(self.threshold[node])
                todo.append((int(self.left[node]), above, [min(v, at) if k == f else v for k, v in enumerate(upto)]))
                todo.append((int(self.right[node]), [max(v, at) if k == f else v for k, v in enumerate(above)], upto))
        names = [f"{f}_above" for f in features] + [f"{f}_upto" for f in features]
        return pd.DataFrame(found, columns=["model", "tree", "value", *names])

    def total_sql(self, features: list[str], model: int = 0) -> str:
        """SQL text with ``{feature}`` places for the summed leaf values of one model, a CASE per tree."""

        def text(node: int) -> str:
            f = self.feature[node]
            if f < 0:
                return f"{self.value[node]}"
            at = f"{float(self.threshold[node])!r}e0" if "e" not in repr(float(self.threshold[node])) else repr(float(self.threshold[node]))
            return f"CASE WHEN {{{features[f]}}} <= {at} THEN {text(int(self.left[node]))} ELSE {text(int(self.right[node]))} END"

        each = [f"CAST({text(int(r))} AS BIGINT)" for r, m in zip(self.roots, self.model, strict=True) if m == model]
        return " + ".join(each)

    def expression(self, features: list[str], model: int = 0) -> ExpressionScorer:
        """The model as a SQL expression. For ensembles of small trees, such as boosted ones of depth 3;
        deep forests have too many nodes for generated code and go by ``TreeScorer``."""
        total = f"CAST({self.total_sql(features, model)} AS DOUBLE)"
        if self.boosted:
            return ExpressionScorer(f"1e0 / (1e0 + exp(-2e0 * ({total} / {SCALE!r}e0)))", features)
        return ExpressionScorer(f"{total} / {float(self.counts[model] * SCALE)!r}e0", features)


def _matrix(columns: Sequence[pa.Array]) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) if len(columns[0]) else np.empty((0, len(columns)))


def _grids(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of equal length as a list array; NaN is null."""
    flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
    width = values.shape[1] if values.ndim > 1 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), flat)


#: Over the models: median, least and greatest swing and place (left end) of the largest step; median and greatest
#: deviation over the points.
SPREAD = ["swing_median", "swing_min", "swing_max", "step_median", "step_min", "step_max", "sd_median", "sd_max"]


def seed_spread(p: np.ndarray, grid: np.ndarray) -> pa.StructArray:
    """How curves of several models, rows x models x points, differ."""
    swing, sd = p.max(2) - p.min(2), p.std(1)
    # to 1e-12, below which differences are rounding, so that the first of equal steps is taken
    step = np.take_along_axis(grid, np.round(np.abs(np.diff(p, axis=2)), 12).argmax(2), 1)
    made = [f(v, 1) for v in (swing, step) for f in (np.median, np.min, np.max)]
    made += [np.median(sd, 1), sd.max(1)]
    return pa.StructArray.from_arrays([pa.array(v) for v in made], SPREAD)


class TreeScorer(RowScorer):
    """One or several fitted tree ensembles, sent to the tasks once as arrays."""

    def __init__(self, spark, trees: Trees, features: list[str]):
        self.features = features
        self.shared = spark.sparkContext.broadcast(trees)

    def _own(self) -> list[Column]:
        return [F.col(f).cast("double") for f in self.features]

    def score(self, df: DataFrame, out: str = "p", model: Column | None = None) -> DataFrame:
        """P under the model whose number the column ``model`` holds, or else the first."""
        shared = self.shared

        @F.arrow_udf("double")
        def scored(model: pa.Array, *columns: pa.Array) -> pa.Array:
            wanted = model.to_numpy(zero_copy_only=False).astype(int)
            return pa.array(np.take_along_axis(shared.value.score(_matrix(columns)), wanted[:, None], 1)[:, 0])

        return df.withColumn(out, scored(F.lit(0) if model is None else model, *self._own()))

    def curves(self, df: DataFrame, feature: str, z: str, out: str, swept: Sequence[str], model: str | None = None) -> DataFrame:
        """``out``: array of P along ``z``, an ascending array, in the column that ``feature`` names, one of
        ``swept``; the curves of several models one after another, or that of the one whose number the column ``model``
        holds. Rows of one frame share the length of ``z``."""
        shared, names = self.shared, self.features

        @F.arrow_udf("array<double>")
        def along(feature: pa.Array, z: pa.Array, model: pa.Array, *columns: pa.Array) -> pa.Array:
            x, grid = _matrix(columns), _grids(z)
            wanted, one = np.array(feature.to_pylist(), object), model.to_numpy(zero_copy_only=False).astype(int)
            out = None
            for k in np.unique(one):
                trees = shared.value if k < 0 else shared.value.only(k)
                if out is None:
                    out = np.empty((len(x), trees.models * grid.shape[1]))
                for f in sorted(set(wanted)):
                    on = np.flatnonzero((wanted == f) & (one == k))
                    out[on] = trees.curves(x[on], names.index(f), grid[on]).reshape(len(on), -1)
            return _lists(np.empty((0, 0)) if out is None else out)

        return df.withColumn(out, along(F.col(feature), F.col(z), F.lit(-1) if model is None else F.col(model), *self._own()))

    def seed_spread(self, df: DataFrame, z: str, feature: str, out: str) -> DataFrame:
        """``out``: how curves of several models along ``z`` differ, the fields of ``SPREAD``."""
        shared, column = self.shared, self.features.index(feature)

        @F.arrow_udf(", ".join(f"{n} double" for n in SPREAD))
        def spread(z: pa.Array, *columns: pa.Array) -> pa.Array:
            grid = _grids(z)
            return seed_spread(shared.value.curves(_matrix(columns), column, grid), grid)

        return df.withColumn(out, spread(F.col(z), *self._own()))

    def boundary_distances(self, df: DataFrame, fx: str, fy: str, zx: str, zy: str, std_x: str, std_y: str, out: str) -> DataFrame:
        """``out``: distance in std from each row to the nearest cell beside which P crosses 0.5, one value a
        model, null where it crosses nowhere in the window."""
        shared, at = self.shared, (self.features.index(fx), self.features.index(fy))

        @F.arrow_udf("array<double>")
        def nearest(zx: pa.Array, zy: pa.Array, std_x: pa.Array, std_y: pa.Array, *columns: pa.Array) -> pa.Array:
            trees, x, gx, gy = shared.value, _matrix(columns), _grids(zx), _grids(zy)
            std = _matrix([std_x, std_y])
            far = np.full((len(x), trees.models), np.nan)
            for part, p in trees.surfaces(x, at, gx, gy):
                side = p >= 0.5
                edge = np.zeros_like(side)
                edge[:, :, :-1] |= side[:, :, :-1] != side[:, :, 1:]
                edge[:, :, :, :-1] |= side[:, :, :, :-1] != side[:, :, :, 1:]
                dx = (gx[part] - x[part, at[0], None]) / std[part, :1]
                dy = (gy[part] - x[part, at[1], None]) / std[part, 1:]
                d = np.where(edge, (dx * dx)[:, None, :, None] + (dy * dy)[:, None, None, :], np.inf).min((2, 3))
                far[part] = np.where(np.isinf(d), np.nan, np.sqrt(d))
            return _lists(far)

        return df.withColumn(out, nearest(*[F.col(c) for c in (zx, zy, std_x, std_y)], *self._own()))
