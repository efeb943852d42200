"""Bounded samples of labelled documents, and the split that keeps a third of them out of training."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id's decimal text leaves remainder 1 by 3. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def sampled(rows: DataFrame, label: str, per_class: int, key: list[str]) -> DataFrame:
    """About ``per_class`` rows of each label: those whose hash of ``key`` is below the class's share.

    One count by label decides the shares. Fixed for the same rows; at most twice the wanted number
    of rows even where many rows share a key."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect() if r[label] is not None}
    unit = F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(1.1 * per_class / n)).otherwise(share)
    return rows.where(unit < share).limit(2 * per_class * max(1, len(counts)))


def texts(rows: DataFrame, label: str, per_class: int, chars: int) -> list[tuple[str, object]]:
    """(text, label) of at most ``per_class`` rows a class, in an order fixed by hashes, with at most
    ``chars`` code points of each, from a start that depends on the row."""
    order = F.xxhash64("doc_id", "text")
    begin = F.greatest(F.lit(0), F.length("text") - chars) * (F.pmod(order, F.lit(1000)) / 1000) + 1
    found = rows.select(order.alias("o"), F.substring("text", begin.cast("int"), F.lit(chars)).alias("t"), label).collect()
    taken: Counter = Counter()
    out = []
    for r in sorted(found, key=lambda r: (r["o"], r["t"])):
        taken[r[label]] += 1
        if taken[r[label]] <= per_class:
            out.append((r["t"], r[label]))
    return out
