"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are summed by membership pattern, the set of sources they belong to. A pattern's words flow to
the quotas of its sources; each further copy of a pattern costs more, so nothing is repeated while fresh
words can fill a quota. Patterns that share no source, directly or over others, are networks of their
own and are solved side by side. A pattern's documents stand in a seeded order, one copy of the whole
line after another, and a source takes the stretch that the flow gives it; the document at a stretch's
end is taken in part, so quotas are met to the word.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm import simhash, store
from probewise.llm.ordering import meet, placed

WEIGHTS, SHARE_PERCENT, REPEATS, SEED = (3, 1, 2), 150, 2, 42
WORD = r"[^\x20\x09-\x0D]+"


class Network:
    """A flow network; ``run`` finds a largest flow of least cost by shortest paths over reduced costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[float] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, room: float, cost: float = 0.0) -> int:
        """Adds an arc and its reverse; returns the arc's number."""
        for tail, end, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out[tail].append(len(self.head))
            self.head.append(end)
            self.room.append(r)
            self.cost.append(c)
        return len(self.head) - 2

    def _distances(self, begin: int, potential: list[float], least: float) -> list[float]:
        far = [float("inf")] * len(self.out)
        far[begin] = 0.0
        heap = [(0.0, begin)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in self.out[a]:
                b = self.head[e]
                to = d + self.cost[e] + potential[a] - potential[b]
                if self.room[e] > least and to < far[b] - 1e-12:
                    far[b] = to
                    heapq.heappush(heap, (to, b))
        return far

    def _augment(self, begin: int, end: int, potential: list[float], least: float) -> None:
        """Saturate the arcs of reduced cost zero, one path of fewest arcs after another."""
        while True:
            came: dict[int, int] = {begin: -1}
            line = [begin]
            for a in line:
                for e in self.out[a]:
                    b = self.head[e]
                    if b not in came and self.room[e] > least and abs(self.cost[e] + potential[a] - potential[b]) < 1e-9:
                        came[b] = e
                        line.append(b)
                if end in came:
                    break
            if end not in came:
                return
            path, b = [], end
            while came[b] >= 0:
                path.append(came[b])
                b = self.head[came[b] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push

    def run(self, begin: int, end: int, least: float = 0.0) -> None:
        """Room of ``least`` or less counts as none. Costs at the start must not be negative."""
        potential = [0.0] * len(self.out)
        while True:
            far = self._distances(begin, potential, least)
            if far[end] == float("inf"):
                return
            # nodes beyond the end's distance keep reduced costs at or above zero
            potential = [p + min(d, far[end]) for p, d in zip(potential, far, strict=True)]
            self._augment(begin, end, potential, least)


def route(
    sizes: Sequence[int], quotas: Sequence[float], links: Sequence[tuple[int, int]], costs: Sequence[float]
) -> list[float]:
    """Words that flow along each link (pattern, source): as much of the quotas as can be met, and of
    all ways to do so the one of least cost, where copy k of a word of a pattern costs ``costs[k]``."""
    begin, end = len(sizes) + len(quotas), len(sizes) + len(quotas) + 1
    net = Network(end + 1)
    for p, size in enumerate(sizes):
        for cost in costs:
            net.arc(begin, p, float(size), float(cost))
    arcs = [net.arc(p, len(sizes) + s, float("inf")) for p, s in links]
    for s, quota in enumerate(quotas):
        net.arc(len(sizes) + s, end, float(quota))
    net.run(begin, end, 1e-9 * (1.0 + sum(quotas)))
    return [net.room[a + 1] for a in arcs]


def _solve(costs: Sequence[float]):
    def solve(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["pattern", "source"], ignore_index=True)
        patterns = found.drop_duplicates("pattern")
        sources = found.drop_duplicates("source")
        p = {k: i for i, k in enumerate(patterns["pattern"])}
        s = {k: i for i, k in enumerate(sources["source"])}
        links = [(p[a], s[b]) for a, b in zip(found["pattern"], found["source"], strict=True)]
        flow = pd.Series(route(patterns["pattern_size"].tolist(), sources["target"].tolist(), links, costs))
        upto = flow.groupby(found["pattern"]).cumsum()
        found["begin"] = (upto - flow + 0.5).floordiv(1).astype("int64")
        found["end"] = (upto + 0.5).floordiv(1).astype("int64")
        return found[["pattern", "source", "begin", "end"]]

    return solve


def targets(sources: DataFrame, budget: float, repeats: int) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: the budget by weight, none above ``repeats``
    times its source's size, the excess shared by weight among the others.

    What a unit of weight gets only rises as sources reach their bound, so it is found by a few sums.
    """
    cap = F.col("source_size") * F.lit(repeats)
    unit, bound = 0.0, -1
    while True:
        full = cap <= F.lit(unit) * F.col("weight")
        row = sources.agg(
            F.sum(full.cast("long")).alias("bound"), F.sum(F.when(full, cap)).alias("filled"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if row["bound"] == bound or not row["open"]:
            return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.lit(unit) * F.col("weight")))
        bound, unit = row["bound"], (budget - (row["filled"] or 0)) / row["open"]


def _components(links: DataFrame) -> DataFrame:
    """``links`` (pattern, source, ..) with ``component``, one number for all that shares sources."""
    first = links.groupBy("pattern").agg(F.min("source").alias("a"))
    joined = links.join(first, "pattern")
    edges = store.kept(joined.where("source != a").select("a", F.col("source").alias("b")).distinct(), "overlaps")
    if edges.isEmpty():
        return joined.withColumnRenamed("a", "component")
    roots = simhash.component_roots(edges).select(F.col("fp").alias("a"), "root")
    return joined.join(roots, "a", "left").withColumn("component", F.coalesce("root", "a")).drop("root", "a")


def mix(
    docs: DataFrame,
    members: Column,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    repeats: int = REPEATS,
    costs: Sequence[float] | None = None,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, size, sources, parts, taken) of every row of ``docs``.

    ``members`` gives the array of a row's sources; they weigh ``weights`` in turn, by code point, a null
    source last, and share ``share_percent`` of all words. ``sources`` lists a row's sources with their
    size and target, ``parts`` the words that each takes of it, ``taken`` their sum, at most ``repeats``
    times ``size``. Copy k costs ``costs[k]`` a word, which must not fall; 0, 1, 2, .. if not given.

    A null or empty text has size 0 and is taken 0 times; a row with a null or empty array of sources counts
    among all words, but nothing takes it. A null id is ordered as an empty one. Rows with equal ids are
    ordered by size and text; repeated rows each stand for themselves. A very long text may be taken in
    part only. An empty table gives no rows. Other columns are ignored.

    Memory of one task grows with the distinct pairs of pattern and source of one network, never with rows.
    """
    costs = list(range(repeats)) if costs is None else list(costs)
    if len(costs) != repeats or any(a > b for a, b in zip(costs, costs[1:], strict=False)) or min(weights) <= 0:
        raise ValueError("one cost a copy, none below the one before, and weights above zero")
    none = F.array().cast("array<string>")
    own = F.sort_array(F.array_distinct(F.coalesce(members.cast("array<string>"), none)), True)
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.to_json(own).alias("pattern"), own.alias("names"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    )
    sized = store.kept(sized, "sizes")
    patterns = sized.groupBy("pattern").agg(F.any_value("names").alias("names"), F.sum("size").alias("pattern_size"))
    patterns = store.kept(patterns, "patterns")
    budget = share_percent * (patterns.agg(F.sum("pattern_size")).first()[0] or 0) / 100

    pairs = patterns.select("pattern", "pattern_size", F.explode("names").alias("name"))
    sources = pairs.groupBy("name").agg(F.sum("pattern_size").alias("source_size"))
    sources = placed(sources, [F.col("name").isNull(), F.col("name")], [])
    turn = F.array(*[F.lit(int(w)) for w in weights])
    sources = sources.withColumn("weight", F.get(turn, F.pmod("at", F.lit(len(weights))).cast("int")))
    sources = store.kept(targets(sources.withColumnRenamed("at", "source"), budget, repeats), "sources")

    links = store.kept(meet(pairs, sources.select("name", "source", "source_size", "target"), ["name"]), "links")
    flows = _components(links).groupBy("component").applyInPandas(
        _solve(costs), "pattern string, source long, begin long, end long"
    )
    flows = links.join(flows, ["pattern", "source"]).groupBy("pattern").agg(
        F.any_value("pattern_size").alias("pattern_size"),
        F.sort_array(F.collect_list(F.struct("source", "name", "begin", "end", "source_size", "target"))).alias("flows"),
    )
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    order = [key, F.col("doc_id"), F.col("size"), F.col("body")]
    lines = placed(sized.drop("names"), order, ["pattern"], amount="size", extra=store.kept(flows, "flows"))

    def words(flow: Column) -> Column:
        got = F.lit(0).cast("long")
        for k in range(repeats):
            begin = F.col("before") + F.col("pattern_size") * k
            overlap = F.least(begin + F.col("size"), flow["end"]) - F.greatest(begin, flow["begin"])
            got = got + F.greatest(overlap, F.lit(0).cast("long"))
        return got

    parts = F.transform("flows", lambda f: F.struct(f["name"].alias("name"), words(f).alias("words")))
    lines = lines.withColumn("parts", parts)
    return lines.select(
        "doc_id", "size",
        F.transform("flows", lambda f: F.struct(f["name"].alias("name"), f["source_size"].alias("source_size"), f["target"].alias("target"))).alias("sources"),
        "parts", F.coalesce(F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]), F.lit(0)).alias("taken"),
    )
