"""Random forests over tables of any size, grown on binned cells instead of rows.

Columns are cut at the same places as Spark ML's (at most 256 bins), and rows that agree in every bin are
one cell with a count per class: a tree cannot tell them apart, and a bag that draws each row by Poisson(1)
draws a cell by Poisson(count). While a node holds more cells than a task should, its split is found from
summed histograms; a smaller node goes to one task, which grows the rest below it, all nodes of a level at
once. Spark ML sums a full histogram for every node down to the last, which is most of its time on deep trees.

Rules are Spark ML's: bags with replacement, the root of the column count as candidates per node, gini gain,
the first of equal splits, a least number of drawn rows in a leaf, and two leaves of one parent that predict
the same class are merged. What is random depends on seed, tree, node and cell only, never on partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.functions.materialise import materialise

#: Cells of one node that a task may hold, and trees whose bags it makes at once.
CELLS_PER_TASK, TREES_AT_ONCE = 65536, 64
#: Rows that place the cuts of a column, as in Spark ML, where 256 bins are asked for.
SPLIT_ROWS_PER_BIN = 256


def split_points(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 cuts between distinct ascending values, at about equal counts."""
    between = (values[:-1] + values[1:]) / 2.0
    if len(between) <= bins - 1:
        return between
    stride = counts.sum() / bins
    upto, found, target = np.cumsum(counts), [], stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found[: bins - 1])


def cuts_of(train: DataFrame, n: int, columns: int, bins: int) -> list[np.ndarray]:
    """The cuts of every entry of ``features``, from about ``bins`` * 256 rows, or all if there are fewer."""
    want, bins = SPLIT_ROWS_PER_BIN * bins, min(bins, n)
    drawn = train.sample(fraction=want / n, seed=7) if want < n else train
    counted = drawn.select(F.posexplode("features").alias("column", "value")).groupBy("column", "value").count()

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("value")
        found = split_points(frame["value"].to_numpy(), frame["count"].to_numpy(), bins)
        return pd.DataFrame({"column": [frame["column"].iloc[0]], "cuts": [found]})

    # at most 255 numbers a column
    found = {r.column: np.array(r.cuts, float) for r in counted.groupBy("column").applyInPandas(cut, "column int, cuts array<double>").collect()}
    return [found[c] for c in range(columns)]


def celled(train: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(bins, key, n0, n1): the distinct bin numbers, a byte a column, and their rows of either class."""
    def binned(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["features"].to_numpy())
                at = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1).astype(np.uint8)
                yield pd.DataFrame({"bins": [row.tobytes() for row in at], "label": pdf["label"].to_numpy()})

    rows = train.select("features", F.col("label").cast("int").alias("label"))
    count = lambda v: F.sum((F.col("label") == v).cast("long"))
    cells = rows.mapInPandas(binned, "bins binary, label int").groupBy("bins").agg(count(0).alias("n0"), count(1).alias("n1"))
    return cells.select("bins", F.xxhash64("bins").alias("key"), "n0", "n1")


def _bags(frame: pd.DataFrame, seed: int, trees: int) -> np.ndarray:
    """Drawn rows of every cell: cells x trees x classes."""
    out = np.empty((len(frame), trees, 2), np.int64)
    keys = np.stack([frame["key"].to_numpy().astype(np.uint64), np.full(len(frame), seed, np.uint64)], 1)
    for i, rows in enumerate(frame[["n0", "n1"]].to_numpy()):
        out[i] = np.random.Generator(np.random.Philox(key=keys[i])).poisson(rows, (trees, 2))
    return out


def _narrow(bag: np.ndarray) -> bytes:
    """A bag in the least bytes a number that hold it."""
    return bag.astype(np.min_scalar_type(int(bag.max(initial=0)))).tobytes()


def _wide(bag: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(bag, f"u{len(bag) // (2 * cells)}").reshape(-1, 2).astype(np.int64)


def _batches(frames: Iterator[pd.DataFrame], seed: int, trees: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bin numbers and bags of a few cells at a time."""
    for pdf in frames:
        for i in range(0, len(pdf), 4096):
            part = pdf.iloc[i : i + 4096]
            yield np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(len(part), -1), _bags(part, seed, trees)


def _candidates(random: np.ndarray, m: int) -> np.ndarray:
    """``m`` columns for every node by a reservoir, from one random number a node and column."""
    chosen = np.tile(np.arange(m), (len(random), 1))
    for c in range(m, random.shape[1]):
        at = (random[:, c] * (c + 1)).astype(int)
        hit = np.flatnonzero(at < m)
        chosen[hit, at[hit]] = c
    return chosen


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.maximum(a + b, 1)
    return 1.0 - (a / n) ** 2 - (b / n) ** 2


def _best(node: np.ndarray, bins: np.ndarray, w: np.ndarray, total: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, bin) of the best split ``bin`` and below for every node, in one column; -inf where none is allowed."""
    key = node * 256 + bins
    order = np.argsort(key, kind="stable")
    key, upto = key[order], np.cumsum(w[order], 0)
    last = np.flatnonzero(np.append(np.diff(key), 1))
    at, bin_, left = key[last] // 256, key[last] % 256, upto[last]
    # what earlier nodes hold comes before a node's own rows
    left = left - (np.cumsum(total, 0) - total)[at]
    right = total[at] - left
    n, nl, nr = total[at].sum(1), left.sum(1), right.sum(1)
    gain = _gini(*total[at].T) - nl / n * _gini(*left.T) - nr / n * _gini(*right.T)
    gain = np.where((nl >= min_leaf) & (nr >= min_leaf), gain, -np.inf)
    first = np.searchsorted(at, np.arange(len(total)))
    most = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == most[at])
    return most, bin_[hit[np.searchsorted(at[hit], np.arange(len(total)))]]


class Grown:
    """A tree as lists of arrays, a level each: column (-1 at leaves), bin, left, right, drawn rows by class."""

    def __init__(self, total: np.ndarray):
        self.column, self.bin = np.array([-1]), np.array([0])
        self.left, self.right, self.total = np.array([-1]), np.array([-1]), total[None, :]
        self.levels: list[np.ndarray] = []

    def split(self, nodes: np.ndarray, column: np.ndarray, bin_: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Give ``nodes`` two children each; returns the left ones, the right ones follow them by one."""
        children = len(self.column) + 2 * np.arange(len(nodes))
        self.column[nodes], self.bin[nodes], self.left[nodes], self.right[nodes] = column, bin_, children, children + 1
        both = np.stack([left, self.total[nodes] - left], 1).reshape(-1, 2)
        none = np.full(len(both), -1)
        self.column, self.bin = np.append(self.column, none), np.append(self.bin, none * 0)
        self.left, self.right = np.append(self.left, none), np.append(self.right, none)
        self.total = np.concatenate([self.total, both])
        self.levels.append(nodes)
        return children

    def pruned(self) -> pd.DataFrame:
        """The tree without pairs of leaves that predict one class, numbered from 0 without gaps."""
        one = self.total[:, 1] > self.total[:, 0]
        for nodes in reversed(self.levels):
            l, r = self.left[nodes], self.right[nodes]
            same = (self.column[l] < 0) & (self.column[r] < 0) & (one[l] == one[r])
            self.column[nodes[same]] = -1
        kept = np.zeros(len(self.column), bool)
        kept[0] = True
        for nodes in self.levels:
            inner = nodes[kept[nodes] & (self.column[nodes] >= 0)]
            kept[self.left[inner]] = kept[self.right[inner]] = True
        number, leaf = np.cumsum(kept) - 1, self.column < 0
        place = lambda side: np.where(leaf, -1, number[side])[kept]
        return pd.DataFrame({
            "id": number[kept], "feature": self.column[kept], "bin": self.bin[kept], "left": place(self.left),
            "right": place(self.right), "n0": self.total[kept, 0], "n1": self.total[kept, 1]})


def grow(bins: np.ndarray, w: np.ndarray, seed: list[int], depth: int, m: int, min_leaf: int, max_depth: int) -> Grown:
    """The tree below a node at ``depth`` that holds these cells, all nodes of a level at once."""
    rng = np.random.default_rng(seed)
    tree = Grown(w.sum(0))
    nodes = np.array([0])[: int(depth < max_depth and (tree.total > 0).all())]
    node = np.zeros(len(w), np.int64)
    while len(nodes):
        total = tree.total[nodes]
        chosen = _candidates(rng.random((len(nodes), bins.shape[1])), m)
        gain, column, cut = np.zeros(len(nodes)), np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        for j in range(m):
            here = bins[np.arange(len(bins)), chosen[node, j]].astype(np.int64)
            g, b = _best(node, here, w, total, min_leaf)
            better = g > gain
            gain[better], column[better], cut[better] = g[better], chosen[better, j], b[better]
        parted = column >= 0
        on = np.flatnonzero(parted[node])
        bins, w, node = bins[on], w[on], (np.cumsum(parted) - 1)[node[on]]
        column, cut = column[parted], cut[parted]
        right = bins[np.arange(len(bins)), column[node]] > cut[node]
        left = np.stack([np.bincount(node[~right], w[~right, c], len(column)) for c in (0, 1)], 1).astype(np.int64)
        children = tree.split(nodes[parted], column, cut, left)
        depth += 1
        both = np.stack([children, children + 1], 1).ravel()
        go = (tree.total[both] > 0).all(1) & (depth < max_depth)
        at = 2 * node + right
        on = np.flatnonzero(go[at])
        bins, w, node, nodes = bins[on], w[on], (np.cumsum(go) - 1)[at[on]], both[go]
    return tree


class _Tops:
    """The upper part of every tree, as far as its nodes are split from histograms."""

    def __init__(self, trees: int):
        self.trees = [Grown(np.zeros(2, np.int64)) for _ in range(trees)]
        self.depth = [{0: 0} for _ in range(trees)]

    def reach(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The node of one tree at which every cell now stands."""
        t, node = self.trees[tree], np.zeros(len(bins), np.int64)
        while (inner := np.flatnonzero(t.column[node] >= 0)).size:
            at = node[inner]
            node[inner] = np.where(bins[inner, t.column[at]] > t.bin[at], t.right[at], t.left[at])
        return node


class ForestFit:
    """Forests of several seeds over one training table: ``label`` 0 or 1 and ``features``, an array of doubles."""

    def __init__(self, train: DataFrame, n: int, columns: int, trees: int, min_leaf: int, max_depth: int, bins: int, cells_per_task: int = CELLS_PER_TASK):
        if not n:
            raise ValueError("a forest needs training rows")
        self.spark, self.columns, self.trees = train.sparkSession, columns, trees
        self.m, self.min_leaf, self.max_depth, self.limit = int(np.ceil(np.sqrt(columns))), min_leaf, max_depth, cells_per_task
        self.cuts = cuts_of(train, n, columns, bins)
        self.cells = materialise(celled(train, self.cuts))
        self.n_cells = self.cells.count()
        # cells are few bytes, bags of them are not: every task slot gets its part
        self.parts = max(self.spark.sparkContext.defaultParallelism, -(-self.n_cells // 16384))

    def _upper(self, seed: int) -> _Tops:
        """Split nodes that hold too many cells for a task, level by level, from histograms summed over tasks."""
        tops, m, columns, limit = _Tops(self.trees), self.m, self.columns, self.limit
        todo = [(t, 0) for t in range(self.trees)] if self.n_cells > limit else []
        trees, min_leaf = self.trees, self.min_leaf
        while todo:
            wanted = np.array(todo)
            chosen = np.stack([_candidates(np.random.default_rng([seed, t, v]).random((1, columns)), m)[0] for t, v in todo])
            shared = self.spark.sparkContext.broadcast((tops, wanted, chosen))

            def summed(frames):
                tops, wanted, chosen = shared.value
                sums = np.zeros((len(wanted), m, 256, 3), np.int64)
                for bins, bags in _batches(frames, seed, trees):
                    for t in np.unique(wanted[:, 0]):
                        drawn, node = bags[:, t], tops.reach(t, bins)
                        w = np.concatenate([drawn, (drawn.sum(1, keepdims=True) > 0)], 1)
                        for k in np.flatnonzero(wanted[:, 0] == t):
                            on = np.flatnonzero((node == wanted[k, 1]) & (w[:, 2] > 0))
                            for j in range(m):
                                for c in range(3):
                                    sums[k, j, :, c] += np.bincount(bins[on, chosen[k, j]], w[on, c], 256).astype(np.int64)
                for a in range(0, len(wanted), 64):
                    yield pd.DataFrame({"node": np.arange(a, min(a + 64, len(wanted))), "sums": [s.tobytes() for s in sums[a : a + 64]]})

            def chosen_split(frame: pd.DataFrame) -> pd.DataFrame:
                sums = sum(np.frombuffer(s, np.int64).reshape(m, 256, 3) for s in frame["sums"])
                total, best = sums[0].sum(0), (0.0, -1, 0)
                for j in range(m):
                    held = np.flatnonzero(sums[j, :, 2])
                    g, b = _best(np.zeros(len(held), np.int64), held, sums[j, held, :2], total[None, :2], min_leaf)
                    if g[0] > best[0]:
                        best = (float(g[0]), j, int(b[0]))
                left = sums[max(best[1], 0), : best[2] + 1].sum(0)
                return pd.DataFrame({"node": [frame["node"].iloc[0]], "j": [best[1]], "bin": [best[2]], "total": [total], "left": [left]})

            found = self.cells.repartition(self.parts).mapInPandas(summed, "node int, sums binary").groupBy("node").applyInPandas(
                chosen_split, "node int, j int, bin int, total array<long>, left array<long>")
            # a row per open node, whose number is bounded by the cells over the limit
            todo_next = []
            for r in found.collect():
                (t, v), total, left = todo[r.node], np.array(r.total), np.array(r.left)
                top = tops.trees[t]
                top.total[v] = total[:2]
                if r.j < 0 or not (total[:2] > 0).all() or tops.depth[t][v] >= self.max_depth:
                    continue
                first = int(top.split(np.array([v]), chosen[r.node, r.j][None], np.array([r.bin]), left[None, :2])[0])
                for child, cells in ((first, left[2]), (first + 1, total[2] - left[2])):
                    tops.depth[t][child] = tops.depth[t][v] + 1
                    if cells > limit:
                        todo_next.append((t, child))
            todo = sorted(todo_next)
        return tops

    def packed(self, seeds: Sequence[int]) -> DataFrame:
        """(seed, tree, n, nodes): every grown tree of these seeds with its number of nodes, written once. No tree
        comes to the driver."""
        with ThreadPool(min(len(seeds), 4)) as pool:
            tops = dict(zip(seeds, pool.map(self._upper, seeds), strict=True))
        shared, trees, columns = self.spark.sparkContext.broadcast(tops), self.trees, self.columns
        m, min_leaf, max_depth, whole = self.m, self.min_leaf, self.max_depth, self._whole

        def dealt(frames):
            for pdf in frames:
                for seed in seeds:
                    top = shared.value[seed]
                    for bins, bags in _batches([pdf], seed, trees):
                        for a in range(0, trees, TREES_AT_ONCE):
                            out = []
                            for t in range(a, min(a + TREES_AT_ONCE, trees)):
                                drawn = np.flatnonzero(bags[:, t].any(1))
                                at = top.reach(t, bins[drawn])
                                for v in np.unique(at):
                                    on = drawn[at == v]
                                    out.append((seed, t, int(v), bins[on].tobytes(), _narrow(bags[on, t])))
                            yield pd.DataFrame(out, columns=["seed", "tree", "top", "bins", "w"])

        def finished(frame: pd.DataFrame) -> pd.DataFrame:
            seed, t, v = (int(frame[c].iloc[0]) for c in ("seed", "tree", "top"))
            bins = np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(-1, columns)
            w = np.concatenate([_wide(w, len(b) // columns) for w, b in zip(frame["w"], frame["bins"], strict=True)])
            made = grow(bins, w, [seed, t, v, 1], shared.value[seed].depth[t][v], m, min_leaf, max_depth).pruned()
            return pd.DataFrame({"seed": [seed], "tree": [t], "top": [v], "nodes": [pack(made)]})

        def joined(frame: pd.DataFrame) -> pd.DataFrame:
            seed, t = int(frame["seed"].iloc[0]), int(frame["tree"].iloc[0])
            parts = {int(v): unpack(b) for v, b in zip(frame["top"], frame["nodes"]) if v >= 0}
            made = whole(shared.value[seed].trees[t], parts)
            return pd.DataFrame({"seed": [seed], "tree": [t], "n": [len(made)], "nodes": [pack(made)]})

        cells = self.cells.repartition(self.parts)
        lower = cells.mapInPandas(dealt, "seed long, tree int, top int, bins binary, w binary").groupBy("seed", "tree", "top").applyInPandas(
            finished, "seed long, tree int, top int, nodes binary")
        # a bag may, rarely, be empty, and its tree is there nevertheless
        every = self.spark.range(len(seeds) * trees).select(
            F.element_at(F.array(*[F.lit(int(s)).cast("long") for s in seeds]), (F.floor(F.col("id") / trees) + 1).cast("int")).alias("seed"),
            (F.col("id") % trees).cast("int").alias("tree"), F.lit(-1).alias("top"), F.lit(None).cast("binary").alias("nodes"))
        return materialise(lower.unionByName(every).groupBy("seed", "tree").applyInPandas(joined, "seed long, tree int, n long, nodes binary"))

    def nodes(self, seed: int, packed: DataFrame | None = None) -> pd.DataFrame:
        """The forest of one seed on the driver: a row per node with tree, id, feature, threshold, left, right, n0, n1."""
        found = (self.packed([seed]) if packed is None else packed.where(F.col("seed") == seed)).orderBy("tree")
        return on_driver(found, self.cuts)

    @staticmethod
    def _whole(top: Grown, parts: dict[int, pd.DataFrame]) -> pd.DataFrame:
        """Lower parts set in the places of the upper part's leaves, then leaves of one class merged once more."""
        if len(top.column) == 1:
            # an empty bag is a leaf of nothing
            return parts[0] if parts else top.pruned().astype(_PACKED)[["id", *[c for c in _PACKED if c != "id"]]]
        base = len(top.column)
        tree = Grown(np.zeros(2, np.int64))
        tree.column, tree.bin, tree.left, tree.right, tree.total = top.column, top.bin, top.left, top.right, top.total
        tree.levels = list(top.levels)
        for v, p in sorted(parts.items()):
            # the part's root takes the place of v, its other nodes follow at the end
            number = np.append(v, base + np.arange(len(p) - 1))
            column, place = p["feature"].to_numpy(np.int64), lambda c: np.where(p[c] < 0, -1, number[p[c]])  # noqa: B023
            left, right, total = place("left"), place("right"), p[["n0", "n1"]].to_numpy(np.int64)
            tree.column, tree.bin = np.append(tree.column, column[1:]), np.append(tree.bin, p["bin"].to_numpy(np.int64)[1:])
            tree.left, tree.right = np.append(tree.left, left[1:]), np.append(tree.right, right[1:])
            tree.total = np.concatenate([tree.total, total[1:]])
            tree.column[v], tree.bin[v], tree.left[v], tree.right[v], tree.total[v] = column[0], p["bin"].iloc[0], left[0], right[0], total[0]
            # parents stand before their children, which is all that a level means to pruning
            deep, level = np.zeros(len(p), int), np.array([0])
            while len(level):
                inner = level[column[level] >= 0]
                if len(inner):
                    tree.levels.append(number[inner])
                level = np.concatenate([p["left"].to_numpy()[inner], p["right"].to_numpy()[inner]])
            base += len(p) - 1
        return tree.pruned().astype(_PACKED)


#: How a grown tree is kept.
_PACKED = {"id": np.int32, "feature": np.int32, "bin": np.int16, "left": np.int32, "right": np.int32, "n0": np.int64, "n1": np.int64}
_PACKED_BYTES = sum(np.dtype(d).itemsize for d in _PACKED.values())


def pack(nodes: pd.DataFrame) -> bytes:
    return zlib.compress(b"".join(nodes[c].to_numpy(d).tobytes() for c, d in _PACKED.items()), 1)


def unpack(packed: bytes) -> pd.DataFrame:
    raw = zlib.decompress(packed)
    n, at, found = len(raw) // _PACKED_BYTES, 0, {}
    for c, d in _PACKED.items():
        found[c] = np.frombuffer(raw, d, n, at)
        at += n * np.dtype(d).itemsize
    return pd.DataFrame(found)


def on_driver(packed: DataFrame, cuts: Sequence[np.ndarray]) -> pd.DataFrame:
    """Packed trees in their order as one node table, thresholds in place of bins."""
    every = pd.concat([unpack(r.nodes).assign(tree=np.int32(r.tree)) for r in packed.select("tree", "nodes").collect()], ignore_index=True)
    threshold = np.zeros(len(every))
    for k, cut in enumerate(cuts):
        on = np.flatnonzero(every["feature"].to_numpy() == k)
        threshold[on] = cut[every["bin"].to_numpy()[on]]
    return every.drop(columns="bin").assign(threshold=threshold)
