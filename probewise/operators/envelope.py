"""Dependence envelopes: which generated rows imply a ratio no real row has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.functions.numeric import ratio
from probewise.functions.ranks import exact_quantiles
from probewise.operators.profiles import point_sql, wide_sql


def ratio_bounds(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: ``{a}_lo``, ``{a}_hi`` of a / b over all rows, zero partners skipped."""
    cols = []
    for a, b in pairs:
        r = ratio(F.col(a), F.col(b))
        cols += [F.min(r).alias(f"{a}_lo"), F.max(r).alias(f"{a}_hi")]
    return rows.agg(*cols)


def ratio_tolerance(rows: DataFrame, a: str, b: str, qs=(0.01, 0.99)) -> DataFrame:
    """One row: the ratio band between two quantiles instead of min and max."""
    ratios = rows.select(ratio(F.col(a), F.col(b)).alias("ratio"))
    q = exact_quantiles(ratios, "ratio", list(qs))
    return q.select(F.col("q")[0].alias(f"{a}_lo"), F.col("q")[1].alias(f"{a}_hi"))


def outside(z: Column, partner: Column, lo: Column, hi: Column) -> Column:
    """True where the ratio leaves the band, NULL for a zero partner."""
    r = ratio(z, partner)
    return (r < lo) | (r > hi)


def outside_keep_zero(z: Column, partner: Column, lo: Column, hi: Column) -> Column:
    """Single-row form: with a zero partner every point counts as possible."""
    return F.coalesce(outside(z, partner, lo, hi), F.lit(False))


def count_outside(sweeps: DataFrame, n: int, partner: str, low: str, high: str, out: str = "n_out") -> DataFrame:
    """The sweeps with the number of their ``n`` grid points whose ratio to ``partner`` leaves the band, null
    for a zero partner.

    Along a grid the ratio rises, or falls for a negative partner, so it passes either end of the band once.
    Where it does follows by arithmetic and is set right by the points beside it; grids too narrow for that
    are counted point by point.
    """
    last = n - 1
    divisor = f"nullif({partner}, 0e0)"

    def place(bound: str) -> str:
        at = f"({bound} * {partner} - lo) / nullif((hi - lo) / {last}, 0e0)"
        return f"cast(ceil(least(greatest({at}, 0e0), {n}e0)) as int)"

    def first(guess: str, test: str) -> str:
        """The first index whose ratio passes the test, ``n`` if none."""
        at = lambda i: f"({point_sql(f'({i})', n)}) / {divisor} {test}"
        return (f"({guess} + CASE WHEN {guess} > 0 AND {at(f'{guess} - 1')} THEN -1"
                f" WHEN {guess} < {n} AND NOT {at(guess)} THEN 1 ELSE 0 END)")

    ratio_at = f"({point_sql('k', n)}) / {divisor}"
    rising = f"{first('_at_low', f'>= {low}')} + {n} - {first('_at_high', f'> {high}')}"
    falling = f"{first('_at_high', f'<= {high}')} + {n} - {first('_at_low', f'< {low}')}"
    one_by_one = f"size(filter(sequence(0, {last}), k -> {ratio_at} < {low} OR {ratio_at} > {high}))"
    found = sweeps.withColumns({"_at_low": F.expr(place(low)), "_at_high": F.expr(place(high))})
    return found.withColumn(out, F.expr(
        f"CASE WHEN {divisor} IS NULL OR {low} IS NULL OR lo IS NULL OR hi IS NULL THEN NULL"
        f" WHEN NOT {wide_sql()} THEN {one_by_one} WHEN {partner} > 0 THEN {rising} ELSE {falling} END"
    ).cast("long")).drop("_at_low", "_at_high")


def partner_pairs(partners: DataFrame) -> list[tuple[str, str]]:
    """Feature and partner names for building columns: one pair per feature."""
    return [(r.feature, r.partner) for r in partners.orderBy("feature").collect()]


def partner_value(pairs: list[tuple[str, str]]) -> Column:
    """The frozen partner of the swept feature, read from the row."""
    return F.coalesce(*[F.when(F.col("feature") == a, F.col(b)) for a, b in pairs])


def by_feature(pairs: list[tuple[str, str]], struct: str, suffix: str) -> Column:
    return F.coalesce(
        *[F.when(F.col("feature") == a, F.col(f"{struct}.{a}_{suffix}")) for a, _ in pairs]
    )


def share_outside(low: Column, high: Column) -> Column:
    """Share of a sweep's length (``lo`` to ``hi``) below ``low`` or above ``high``; of a sweep without
    length, whether its point is outside."""
    lo, hi = F.col("lo"), F.col("hi")
    inside = F.greatest(F.least(high, hi) - F.greatest(low, lo), F.lit(0.0))
    point = ((lo < low) | (lo > high)).cast("double")
    return F.when(hi > lo, 1 - inside / F.nullif(hi - lo, F.lit(0.0))).otherwise(point)
