"""Two-dimensional score surfaces around every row, and distances to their 0.5 contour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.functions.numeric import spread
from probewise.operators.columns import attach
from probewise.operators.profiles import piece_starts, point_sql, span_bounds

WINDOW = 1.5


def windowed(rows: DataFrame, stats: DataFrame, fx: str, fy: str, window: float = WINDOW):
    """Bounds of the clipped window of each row in both features."""
    bounds = {}
    for axis, f in (("x", fx), ("y", fy)):
        lo, hi = span_bounds(f, window)
        bounds |= {f"lo_{axis}": lo, f"hi_{axis}": hi, f"std_{axis}": F.col(f"st.{f}_std")}
    # a generator of one row is evaluated once; as plain columns the bounds would be copied into all that use them
    one = F.inline(F.array(F.struct(*[c.alias(name) for name, c in bounds.items()])))
    return attach(spread(rows, "row_id"), stats).select(*rows.columns, one)


def pieces(windows: DataFrame, scorer, axes: dict[str, tuple[str, int]]) -> DataFrame:
    """``starts_x``, ``starts_y`` for the axes given as (feature, grid size): the first indices of the pieces
    into which the edges of a scorer that only steps cut the axis. On a product of pieces it is constant."""
    cut = {f"_edges_{a}": F.array(*scorer.edge_columns(f)) for a, (f, _) in axes.items()}
    starts = {f"starts_{a}": piece_starts(f"_edges_{a}", n, f"lo_{a}", f"hi_{a}") for a, (_, n) in axes.items()}
    return windows.withColumns(cut).withColumns(starts).drop(*cut)


def runs(starts: str, n: int) -> Column:
    """(at, many) of each piece: its first index and its length."""
    ends = f"concat(slice({starts}, 2, size({starts})), array({n}))"
    return F.expr(f"zip_with({starts}, {ends}, (s, e) -> struct(s AS at, e - s AS many))")


def contour_indices(axis: str, own: str, n: int) -> Column:
    """Indices of an axis that a cell of the contour nearest to the row can have: both ends of a piece, where the
    surface steps or a stretch of contour ends, and those around the row's own value ``own``."""
    lo, hi, starts = f"lo_{axis}", f"hi_{axis}", f"starts_{axis}"
    at = f"cast(floor(least(greatest(({own} - {lo}) / nullif(({hi} - {lo}) / {n - 1}, 0e0), 0e0), {n}e0)) as int)"
    near = f"transform(sequence(-1, 2), d -> least(greatest({at} + d, 0), {n - 1}))"
    return F.expr(
        f"filter(array_distinct(concat({starts}, transform({starts}, s -> s - 1), {near}, array({n - 1}))), i -> i >= 0)")


def cells(windows: DataFrame, nx: int, ny: int, at_x: Column | None = None, at_y: Column | None = None) -> DataFrame:
    """The cells of every window, or those at the indices listed for an axis."""
    grid = windows
    for index, n, at in (("i", nx, at_x), ("j", ny, at_y)):
        grid = grid.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if at is None else F.explode_outer(at))
    return grid.withColumns(
        {
            "zx": F.expr(point_sql("i", nx, "lo_x", "hi_x")),
            "zy": F.expr(point_sql("j", ny, "lo_y", "hi_y")),
        }
    )


def with_neighbours(grid: DataFrame, scorer, fx: str, fy: str, nx: int, ny: int) -> DataFrame:
    """p of each cell and of its right and lower neighbour, all scored from the same row."""
    grid = grid.withColumns(
        {
            "zx_next": F.expr(point_sql(f"least(i + 1, {nx - 1})", nx, "lo_x", "hi_x")),
            "zy_next": F.expr(point_sql(f"least(j + 1, {ny - 1})", ny, "lo_y", "hi_y")),
        }
    )
    return grid.withColumns(
        {
            "p": scorer.column({fx: "zx", fy: "zy"}),
            "p_right": scorer.column({fx: "zx_next", fy: "zy"}),
            "p_low": scorer.column({fx: "zx", fy: "zy_next"}),
        }
    )


def edge_distance(fx: str, fy: str) -> Column:
    """Distance in std from the row to a cell on the contour, NULL for any other cell."""
    side = F.col("p") >= 0.5
    edge = (side != (F.col("p_right") >= 0.5)) | (side != (F.col("p_low") >= 0.5))
    dx = (F.col("zx") - F.col(fx)) / F.col("std_x")
    dy = (F.col("zy") - F.col(fy)) / F.col("std_y")
    return F.when(edge, F.sqrt(dx * dx + dy * dy))


def cell_index(z: Column, lo: Column, hi: Column, n: int) -> Column:
    """Grid cell a value falls into, kept within the grid."""
    at = F.floor((z - lo) / ((hi - lo) / (n - 1)))
    return F.least(F.greatest(at, F.lit(0)), F.lit(n - 2)).cast("int")
