"""Places and running sums in a total order over the cluster, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probewise.llm import store


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join where all of ``on`` are equal, nulls too; the columns of ``left`` and the others of ``right``."""
    other = right.withColumnsRenamed({n: f"_of_{n}" for n in on})
    met = F.lit(True)
    for n in on:
        met = met & F.col(n).eqNullSafe(F.col(f"_of_{n}"))
    return left.join(other, met, how).drop(*[f"_of_{n}" for n in on])


def placed(
    rows: DataFrame,
    order: list[Column],
    group: list[str],
    amount: str | None = None,
    extra: DataFrame | None = None,
) -> DataFrame:
    """``rows`` with ``at``, the 0-based place in ``order`` inside its group, and ``group_rows``.

    With ``amount`` also ``before``, the sum of that column over the group's earlier rows, and
    ``group_amount``. ``extra`` holds columns of a group, one row for each; a group without one gets nulls.

    Rows are dealt by range of (group, order) and the row's number, so that neither a group that holds
    most rows nor a run of equal rows meets in one task. The dealt rows are written, which fixes their
    partitions; a place is the row's number there plus the rows of its group in earlier partitions. What
    a group adds is joined to (group, partition), so a large group is no hot key of that join either.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order, strict=True)) | {"_tie": F.monotonically_increasing_id()})
    keys = [*group, *names, "_tie"]
    dealt = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*names, "_tie")
    dealt = dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33))
    dealt = store.kept(dealt, "placed")

    sums = {"_size": F.count(F.lit(1)), "_first": F.min("_row")}
    if amount:
        sums["_mass"] = F.sum(amount)
    pieces = dealt.groupBy(*group, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    # a row for each partition and group in it: as many as partitions and groups together
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    added = {"_rows_before": F.coalesce(F.sum("_size").over(upto), F.lit(0)), "group_rows": F.sum("_size").over(whole)}
    if amount:
        added["_mass_before"] = F.coalesce(F.sum("_mass").over(upto), F.lit(0))
        added["group_amount"] = F.sum("_mass").over(whole)
    pieces = pieces.withColumns(added).drop("_size", "_mass")
    if extra is not None:
        pieces = meet(pieces, extra, group, "left")
    found = meet(dealt, pieces, [*group, "_part"])
    found = found.withColumn("at", F.col("_rows_before") + F.col("_row") - F.col("_first"))
    used = ["_row", "_part", "_first", "_rows_before"]
    if amount:
        inside = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("before", F.col("_mass_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        used.append("_mass_before")
    return found.drop(*used)
