"""Forests too large for the driver: their trees stay a table, and rows meet them in the tasks.

A forest grown on cells sees a row only through its bins, at most 256 a column. Rows that agree in them are scored
once: their bins are met in blocks by groups of a forest's trees, and sums of leaf values, whole numbers whose order
doesn't matter, go back to the rows. Where columns are swept, all leaves of a forest, boxes of bins, are added up over
the lattice of all bins by differences and running sums, a plane of it for each bin of one column that stands still.
The planes are dealt to the rows in that bin, so a point of a sweep is one look-up, whatever the number of trees.

Everything equals ``TreeScorer`` to the last bit; what a task holds is bounded by the bins and by ``BLOCK_CODES``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from probewise.operators.forest import on_driver, pack, unpack
from probewise.operators.trees import SCALE, SPREAD, Trees, TreeScorer, _grids, _lists, _matrix, forest_nodes, seed_spread
from probewise.plans.scorers import RowScorer

#: Distinct rows that meet a group of trees at once, and trees of a group.
BLOCK_CODES, GROUP_TREES = 65536, 25
#: Bins of all columns together up to which a forest is laid out over them: three columns of 256.
LATTICE_CELLS = 1 << 24
#: Rows that meet the planes of a bin at once.
ROWS_PER_TASK = 8192


def packed_nodes(nodes: pd.DataFrame, columns: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Cuts and packed trees of a node table whose inner nodes have thresholds and weights: Spark ML's own fits."""
    inner = nodes["feature"] >= 0
    cuts = [np.unique(nodes["threshold"][inner & (nodes["feature"] == c)]) for c in range(columns)]
    bin_ = np.zeros(len(nodes), np.int16)
    for c, cut in enumerate(cuts):
        on = (nodes["feature"] == c).to_numpy()
        bin_[on] = np.searchsorted(cut, nodes["threshold"].to_numpy()[on])
    ones = np.round(nodes["value"].to_numpy() / SCALE * nodes["weight"].to_numpy()).astype(np.int64)
    whole = nodes.assign(bin=bin_, n1=ones, n0=nodes["weight"].to_numpy().astype(np.int64) - ones)
    return cuts, [pack(own) for _, own in whole.groupby("tree")]


class Leaves:
    """A packed tree in arrays; a leaf's value is its vote in whole numbers of 2^-40."""

    def __init__(self, packed: bytes):
        nodes = unpack(packed)
        self.feature, self.bin = nodes["feature"].to_numpy(), nodes["bin"].to_numpy()
        self.left, self.right = nodes["left"].to_numpy(), nodes["right"].to_numpy()
        self.value = forest_nodes(nodes)["value"].to_numpy()

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The values of the leaves in which rows of bins end."""
        node = np.zeros(len(bins), np.int64)
        on = np.arange(len(bins)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(on):
            at = node[on]
            at = np.where(bins[on, self.feature[at]] > self.bin[at], self.right[at], self.left[at])
            node[on] = at
            on = on[self.feature[at] >= 0]
        return self.value[node]

    def boxes(self, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first bins, first bins beyond, value) of every leaf."""
        lo = np.zeros((len(self.feature), len(sizes)), np.int64)
        hi = np.tile(np.array(sizes, np.int64), (len(self.feature), 1))
        level = np.array([0])
        while len(inner := level[self.feature[level] >= 0]):
            l, r, f, at = self.left[inner], self.right[inner], self.feature[inner], self.bin[inner].astype(np.int64) + 1
            for child in (l, r):
                lo[child], hi[child] = lo[inner], hi[inner]
            hi[l, f] = np.minimum(hi[l, f], at)
            lo[r, f] = np.maximum(lo[r, f], at)
            level = np.concatenate([l, r])
        leaf = np.flatnonzero((self.feature < 0) & (lo < hi).all(1))
        return lo[leaf], hi[leaf], self.value[leaf]


def lattice(trees: Iterator[Leaves], sizes: Sequence[int], order: Sequence[int]) -> np.ndarray:
    """Summed leaf values over all bins, axes in the given order of columns; along all but the first still as
    differences, most of which are zero: ``whole_plane`` sums them."""
    shape = [sizes[c] for c in order]
    stride = np.array([int(np.prod(shape[i + 1 :])) for i in range(len(shape))], np.int64)
    sums = np.zeros(int(np.prod(shape)), np.int64)
    for tree in trees:
        lo, hi, value = tree.boxes(sizes)
        ends = lo[:, order], hi[:, order]
        for corner in product((0, 1), repeat=len(shape)):
            at = np.stack([ends[side][:, k] for k, side in enumerate(corner)], 1)
            on = np.flatnonzero((at < np.array(shape)).all(1))
            np.add.at(sums, at[on] @ stride, -value[on] if sum(corner) % 2 else value[on])
    sums = sums.reshape(shape)
    return np.cumsum(sums, 0, out=sums)


def whole_plane(differences: np.ndarray, shape: Sequence[int]) -> np.ndarray:
    plane = differences.reshape(shape)
    for axis in range(len(shape)):
        plane = np.cumsum(plane, axis)
    return plane.ravel()


class StoredTrees:
    """Forests as a table (model, tree, nodes) of packed trees, and each model's cuts and number of trees."""

    def __init__(self, packed: DataFrame, cuts: Sequence[Sequence[np.ndarray]], counts: Sequence[int]):
        self.packed, self.cuts, self.counts = packed, list(cuts), list(counts)
        self.models = len(self.cuts)

    def only(self, model: int) -> StoredTrees:
        """One of the models by itself."""
        own = self.packed.where(F.col("model") == model).withColumn("model", F.lit(0))
        return StoredTrees(own, [self.cuts[model]], [self.counts[model]])

    def on_driver(self) -> Trees:
        """The same forests as arrays on the driver."""
        own = lambda k: self.packed.where(F.col("model") == k).orderBy("tree")
        return Trees([forest_nodes(on_driver(own(k), cut)) for k, cut in enumerate(self.cuts)])


def _bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """A byte a column: x <= cut b just where the bin is at most b; a missing value lies beyond all cuts."""
    return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1).astype(np.uint8)


class Planes:
    """The planes of some models for one bin of the still column, and how they are looked up."""

    def __init__(self, cuts: Sequence[np.ndarray], still: int, p: np.ndarray):
        self.cuts, self.still, self.p = cuts, still, p
        self.others = [c for c in range(len(cuts)) if c != still]
        self.stride, step = {}, 1
        for c in reversed(self.others):
            self.stride[c] = step
            step *= len(cuts[c]) + 1

    def curves(self, x: np.ndarray, column: int, z: np.ndarray) -> np.ndarray:
        """P along one swept column: rows x models x points."""
        bins = _bins(x, self.cuts).astype(np.int64)
        base = sum((bins[:, c] * self.stride[c] for c in self.others if c != column), np.zeros(len(x), np.int64))
        at = np.searchsorted(self.cuts[column], z.ravel(), "left").reshape(z.shape) * self.stride[column]
        return self.p[:, base[:, None] + at].transpose(1, 0, 2)

    def nearest(self, x: np.ndarray, columns: tuple[int, int], zx: np.ndarray, zy: np.ndarray, std: np.ndarray) -> np.ndarray:
        """Distance of every row to the nearest cell of its window beside which P crosses 0.5, a value a model. Points in
        one bin are alike, so an edge lies at the last point of a bin, beside all points of a bin of the other axis."""
        a, b = columns
        bins, side = _bins(x, self.cuts).astype(np.int64), self.p >= 0.5
        base = sum((bins[:, c] * self.stride[c] for c in self.others if c not in columns), np.zeros(len(x), np.int64))
        far = np.full((len(x), len(side)), np.inf)
        dx, dy = (zx - x[:, a, None]) / std[:, :1], (zy - x[:, b, None]) / std[:, 1:]
        dx, dy = dx * dx, dy * dy
        at = [np.searchsorted(self.cuts[c], z.ravel(), "left").reshape(z.shape) for c, z in ((a, zx), (b, zy))]
        for i in range(len(x)):
            (first_x, last_x), (first_y, last_y) = (_runs(v[i]) for v in at)
            cell = base[i] + at[0][i, first_x, None] * self.stride[a] + at[1][i, first_y] * self.stride[b]
            s = side[:, cell]
            least_x, least_y = np.minimum.reduceat(dx[i], first_x), np.minimum.reduceat(dy[i], first_y)
            for edge, d in ((s[:, :-1] != s[:, 1:], dx[i, last_x[:-1], None] + least_y), (s[:, :, :-1] != s[:, :, 1:], least_x[:, None] + dy[i, last_y[:-1]])):
                if d.size:
                    far[i] = np.minimum(far[i], np.where(edge, d, np.inf).min((1, 2)))
        return np.where(np.isinf(far), np.nan, np.sqrt(far))


def _runs(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    return first, np.append(first[1:], len(bins)) - 1


class StoredScorer(RowScorer):
    """The probes of ``TreeScorer`` for forests that stay a table."""

    def __init__(self, trees: StoredTrees, features: list[str]):
        self.trees, self.features = trees, features

    def _own(self) -> list[Column]:
        return [F.col(f).cast("double") for f in self.features]

    def score(self, df: DataFrame, out: str = "p", model: Column | None = None) -> DataFrame:
        """P under the model whose number the column ``model`` holds, or else the first."""
        cuts, counts, columns = self.trees.cuts, self.trees.counts, len(self.features)

        @F.arrow_udf("binary")
        def coded(model: pa.Array, *values: pa.Array) -> pa.Array:
            wanted, x = model.to_numpy(zero_copy_only=False).astype(int), _matrix(values)
            found = np.zeros((len(x), columns), np.uint8)
            for k in np.unique(wanted):
                on = np.flatnonzero(wanted == k)
                found[on] = _bins(x[on], cuts[k])
            return pa.array([row.tobytes() for row in found], pa.binary())

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            codes = left["_code"].to_pylist()
            bins = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), columns)
            sums = np.zeros(len(codes), np.int64)
            for packed in right["nodes"] if len(codes) else ():
                sums += Leaves(packed.as_py()).reached(bins)
            return pa.table({"_model": left["_model"], "_code": left["_code"], "sums": pa.array(sums)})

        own = df.withColumn("_model", (F.lit(0) if model is None else model).cast("int"))
        own = own.withColumn("_code", coded(F.col("_model"), *self._own()))
        codes = own.select("_model", "_code").distinct()
        # a row a model
        load = codes.groupBy("_model").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CODES).cast("int").alias("blocks"))
        groups = -(-max(counts) // GROUP_TREES)
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        sent = codes.join(F.broadcast(load), "_model").withColumn("_block", F.pmod(F.xxhash64("_code"), "blocks").cast("int"))
        sent = sent.withColumn("_group", each(F.lit(groups))).drop("blocks")
        held = self.trees.packed.join(F.broadcast(load), F.col("model") == F.col("_model")).withColumn("_block", each(F.col("blocks")))
        held = held.select(F.col("model").alias("_m"), "_block", (F.col("tree") % groups).alias("_group"), "nodes")
        found = sent.groupBy("_model", "_block", "_group").cogroup(held.groupBy("_m", "_block", "_group")).applyInArrow(
            met, "_model int, _code binary, sums long")
        total = F.element_at(F.array(*[F.lit(c * SCALE) for c in counts]), F.col("_model") + 1)
        scored = found.groupBy("_model", "_code").agg(F.sum("sums").alias("_sums")).select("_model", "_code", (F.col("_sums") / total).alias("_p"))
        return own.drop(out).join(scored, ["_model", "_code"]).select(*[c for c in df.columns if c != out], F.col("_p").alias(out))

    def _still(self, swept: Sequence[str], one: bool = False) -> int | None:
        """A column that no sweep moves and by which planes are dealt, if there is one and lattices are small enough;
        all models that a row meets have one lattice."""
        cuts = self.trees.cuts
        still = [c for c, f in enumerate(self.features) if f not in swept]
        alike = one or all(len(a) == len(b) and (a == b).all() for k in cuts for a, b in zip(k, cuts[0], strict=True))
        small = all(np.prod([float(len(c) + 1) for c in k]) <= LATTICE_CELLS for k in cuts)
        return max(still, key=lambda c: len(cuts[0][c])) if still and alike and small else None

    def _beside_planes(self, df: DataFrame, still: int, compute, made: str, model: str | None = None) -> DataFrame:
        """``df`` with the columns ``made`` that ``compute(planes, table)`` returns for the rows of one bin of the still
        column, under all models or the one that the column ``model`` names."""
        cuts, counts, packed = self.trees.cuts, self.trees.counts, self.trees.packed
        sizes, order = [[len(c) + 1 for c in k] for k in cuts], [still, *[c for c in range(len(self.features)) if c != still]]

        @F.arrow_udf("int")
        def placed(model: pa.Array, value: pa.Array) -> pa.Array:
            wanted, x = model.to_numpy(zero_copy_only=False).astype(int), _matrix([value])[:, 0]
            found = np.zeros(len(x), np.int32)
            for k in np.unique(wanted):
                on = np.flatnonzero(wanted == k)
                found[on] = np.searchsorted(cuts[k][still], x[on], "left")
            return pa.array(found)

        def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Trees come a model after another, read as they are added up."""
            trees = ((m, packed) for batch in batches for m, packed in zip(batch["model"].to_pylist(), batch["nodes"].to_pylist(), strict=True))
            for model, own in groupby(trees, lambda t: t[0]):
                sums = lattice((Leaves(t[1]) for t in own), sizes[model], order)
                for a in range(0, len(sums), 16):
                    some = range(a, min(a + 16, len(sums)))
                    yield pa.RecordBatch.from_pydict({
                        "model": pa.array([model] * len(some), pa.int32()), "_at": pa.array(some, pa.int32()),
                        "sums": pa.array([sums[k].tobytes() for k in some], pa.binary())})

        trees = packed.repartitionById(len(counts), F.col("model")).sortWithinPartitions("model").select("model", "nodes")
        held = trees.mapInArrow(planes, "model int, _at int, sums binary")
        # without a model's number a row meets them all, which have the cuts of the first
        held = held.withColumn("_m", F.lit(0) if model is None else F.col("model"))
        own = df.withColumn("_m", F.lit(0) if model is None else F.col(model).cast("int"))
        own = own.withColumn("_at", placed(F.col("_m"), self._own()[still]))
        # a row a bin
        load = own.groupBy("_m", "_at").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_TASK).cast("int").alias("_chunks"))
        plain = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
        own = own.join(F.broadcast(load), ["_m", "_at"]).withColumn("_chunk", F.pmod(F.xxhash64(*plain), "_chunks").cast("int")).drop("_chunks")
        held = held.join(F.broadcast(load), ["_m", "_at"]).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        fields = StructType([*df.schema.fields, *StructType.fromDDL(made).fields])
        kept, added, empty = df.columns, StructType.fromDDL(made).fieldNames(), list(to_arrow_schema(StructType.fromDDL(made)))

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.combine_chunks()
            # a chunk may be empty
            found = [pa.array([], f.type) for f in empty]
            if len(left):
                models, m = right["model"].to_pylist(), left["_m"][0].as_py()
                plane = lambda v: whole_plane(np.frombuffer(v.as_buffer(), np.int64), [sizes[m][c] for c in order[1:]])
                p = {k: plane(v) / (counts[k] * SCALE) for k, v in zip(models, right["sums"], strict=True)}
                found = compute(Planes(cuts[m], still, np.stack([p[k] for k in sorted(p)])), left)
            return pa.table([*[left[c] for c in kept], *found], names=[*kept, *added])

        held = held.select(F.col("_m").alias("_n"), F.col("_at").alias("_a"), F.col("_chunk").alias("_c"), "model", "sums")
        return own.groupBy("_m", "_at", "_chunk").cogroup(held.groupBy("_n", "_a", "_c")).applyInArrow(met, fields)

    def _near(self, df: DataFrame) -> TreeScorer:
        return TreeScorer(df.sparkSession, self.trees.on_driver(), self.features)

    def curves(self, df: DataFrame, feature: str, z: str, out: str, swept: Sequence[str], model: str | None = None) -> DataFrame:
        still, names = self._still(swept, model is not None), self.features
        if still is None:
            return self._near(df).curves(df, feature, z, out, swept, model)

        def compute(planes: Planes, table: pa.Table) -> list:
            grid, rows = _grids(_column(table, z)), _rows(table, names)
            found = np.empty((len(rows), len(planes.p) * grid.shape[1]))
            wanted = np.array(_column(table, feature).to_pylist(), object)
            for f in sorted(set(wanted)):
                on = np.flatnonzero(wanted == f)
                found[on] = planes.curves(rows[on], names.index(f), grid[on]).reshape(len(on), -1)
            return [_lists(found)]

        return self._beside_planes(df, still, compute, f"`{out}` array<double>", model)

    def seed_spread(self, df: DataFrame, z: str, feature: str, out: str) -> DataFrame:
        still, column, names = self._still([feature]), self.features.index(feature), self.features
        if still is None:
            return self._near(df).seed_spread(df, z, feature, out)

        def compute(planes: Planes, table: pa.Table) -> list:
            grid, rows, made = _grids(_column(table, z)), _rows(table, names), []
            for i in range(0, len(rows), 1024):
                made.append(seed_spread(planes.curves(rows[i : i + 1024], column, grid[i : i + 1024]), grid[i : i + 1024]))
            return [pa.concat_arrays(made)]

        spread = ", ".join(f"{n}: double" for n in SPREAD)
        return self._beside_planes(df, still, compute, f"`{out}` struct<{spread}>")

    def boundary_distances(self, df: DataFrame, fx: str, fy: str, zx: str, zy: str, std_x: str, std_y: str, out: str) -> DataFrame:
        still, at, names = self._still([fx, fy]), (self.features.index(fx), self.features.index(fy)), self.features
        if still is None:
            return self._near(df).boundary_distances(df, fx, fy, zx, zy, std_x, std_y, out)

        def compute(planes: Planes, table: pa.Table) -> list:
            std = _matrix([_column(table, std_x), _column(table, std_y)])
            return [_lists(planes.nearest(_rows(table, names), at, _grids(_column(table, zx)), _grids(_column(table, zy)), std))]

        return self._beside_planes(df, still, compute, f"`{out}` array<double>")


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _rows(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return _matrix([_column(table, n) for n in names])
