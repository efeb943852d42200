"""Merkle manifest of a table: a tree of hashes per group of rows, one more over the groups, and proofs.

A parent's children are spread into ``fanout`` slot columns by conditional aggregates. The slots'
concatenation is hashed to the parent; without a child's own slot it is that child's siblings. Blocks
of ``fanout ** BLOCK_LEVELS`` neighbours climb their levels in one task each, and a block's rows wait in
its node with the siblings met so far; only one row a block goes on. Null keys come first, rows with
equal keys by their hash; rows that are equal throughout are leaves of their own with equal hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm import store
from probewise.llm.ordering import meet, placed

LEAVES_A_BLOCK = 256


def leaf_digest(columns: list[Column]) -> Column:
    """Hash of the values as length, ``:`` and value, ``-`` for a null, so no two rows read alike."""
    shown = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]
    return F.sha2(F.concat(*parts), 256)


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level up: nodes (grp, block, at, n, digest, members) to their parents. A group's only node stays."""
    slot = F.pmod("at", F.lit(fanout))
    picks = []
    for s in range(fanout):
        picks.append(F.max(F.when(slot == s, F.col("digest"))).alias(f"kid_{s}"))
        picks.append(F.any_value(F.when(slot == s, F.col("members")), F.lit(True)).alias(f"members_{s}"))
    parent = F.floor(F.col("at") / fanout).cast("long").alias("at")
    pivot = nodes.groupBy("grp", "block", "n", parent).agg(*picks)
    kids = [F.coalesce(f"kid_{s}", F.lit("")) for s in range(fanout)]
    none = F.lit("")

    def climbed(s: int) -> Column:
        step = F.struct(F.concat(none, *kids[:s]).alias("before"), F.concat(none, *kids[s + 1 :]).alias("after"))
        with_step = F.transform(
            f"members_{s}", lambda m: F.struct(m["row"].alias("row"), F.concat(m["path"], F.array(step)).alias("path"))
        )
        return F.filter(with_step, lambda m: m.isNotNull())

    empty = F.filter("members_0", lambda m: F.lit(False))
    joined = F.concat(*[F.coalesce(climbed(s), empty) for s in range(fanout)])
    only = F.col("n") == 1
    return pivot.select(
        "grp", "block", "at",
        F.floor((F.col("n") + (fanout - 1)) / fanout).cast("long").alias("n"),
        F.when(only, F.col("kid_0")).otherwise(F.sha2(F.concat(*kids), 256)).alias("digest"),
        F.when(only, F.col("members_0")).otherwise(joined).alias("members"),
    )


def _climb(nodes: DataFrame, largest: int, fanout: int, grouped: bool) -> DataFrame:
    """(grp, at, row, path, subroot, root) of every node (grp, at, n, digest, row); ``largest`` is the greatest n.

    Takes a block's levels at a time, and calls itself for the blocks' nodes until each group is one
    node; those are then the nodes of the tree over groups.
    """
    levels, wide = 0, 1
    while wide < min(largest, LEAVES_A_BLOCK):
        levels, wide = levels + 1, wide * fanout
    path = F.array().cast("array<struct<before:string,after:string>>")
    held = nodes.select(
        "grp", F.floor(F.col("at") / wide).cast("long").alias("block"), "at", "n", "digest",
        F.array(F.struct(F.struct("at", "row").alias("row"), path.alias("path"))).alias("members"),
    )
    # every level groups by more than (grp, block), so no level shuffles again
    held = held.repartition("grp", "block")
    for _ in range(levels):
        held = _level(held, fanout)
    blocks = store.kept(held.select("grp", "at", "n", "digest", "members"), "blocks")
    larger = -(-largest // wide)
    if larger > 1:
        single = blocks.select("grp", "at", "n", "digest", F.lit(None).cast("int").alias("row"))
        above, on = _climb(single, larger, fanout, grouped).drop("row"), ["grp", "at"]
    elif grouped:
        tops = placed(blocks.select("digest", F.col("grp").alias("name"), F.lit(0).alias("grp")), [F.col("name")], ["grp"])
        tops = tops.select("grp", "at", F.col("group_rows").alias("n"), "digest", F.struct("name", "digest").alias("row"))
        over = _climb(tops, tops.agg(F.max("n")).first()[0] or 1, fanout, False)
        above, on = over.select(F.col("row.name").alias("grp"), "path", F.col("row.digest").alias("subroot"), "root"), ["grp"]
    else:
        top = F.col("digest")
        above, on = blocks.select("grp", path.alias("path"), top.alias("subroot"), top.alias("root")), ["grp"]
    met = meet(blocks.select("grp", "at", "members"), above.withColumnRenamed("path", "rest"), on)
    met = met.select("grp", F.explode("members").alias("m"), "rest", "subroot", "root")
    return met.select(
        "grp", F.col("m.row.at").alias("at"), F.col("m.row.row").alias("row"),
        F.concat("m.path", "rest").alias("path"), "subroot", "root",
    )


def manifest(
    rows: DataFrame,
    columns: list[str],
    group: str,
    key: str,
    carry: dict[str, Column] | None = None,
    fanout: int = 2,
) -> DataFrame:
    """One row per row of ``rows``: key, ``leaf``, ``subroot`` of its group, ``root``, and ``path``.

    ``columns`` are hashed in this order; ``carry`` names further expressions over ``rows`` to hand on,
    such as a second hash. ``path`` lists, from the leaf up to the root, the concatenated siblings
    before and after the row's own node; a node without siblings has two empty texts, a tree of one
    node no step. Null keys and a null group come first; a null value is hashed as ``-``, an empty text
    as ``0:``. Rows of equal keys stand by their hash; repeated rows are leaves of their own. Other
    columns of ``rows`` are ignored. An empty table gives no rows.
    """
    if fanout < 2:
        raise ValueError("a parent needs two slots at least")
    extra = [c.alias(n) for n, c in (carry or {}).items()]
    leaves = rows.select(
        F.col(group).alias("grp"), leaf_digest([F.col(c) for c in columns]).alias("digest"),
        F.struct(F.col(key).alias("key"), *extra).alias("row"),
    )
    # kept, so that dealing by range reads short rows instead of hashing the texts again
    leaves = store.kept(leaves, "leaves")
    nodes = placed(leaves, [F.col("row.key"), F.col("digest")], ["grp"]).withColumnRenamed("group_rows", "n")
    nodes = nodes.select("grp", "at", "n", "digest", F.struct("row.*", F.col("digest").alias("own")).alias("row"))
    largest = leaves.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    out = _climb(nodes, largest, fanout, True)
    shown = [F.col(f"row.{n}").alias(n) for n in (carry or {})]
    return out.select(F.col("row.key").alias(key), *shown, F.col("row.own").alias("leaf"), "subroot", "root", "path")


def proof_digest(path: Column | str) -> Column:
    """Hash of all siblings of a path, from the leaf's to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and the siblings on its path give."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
