from __future__ import annotations

from oracles.common import DOC, DOCS, point, r6, stats, with_
from oracles.surrogate import _DFIT, draws, more
from probewise.plans.scorers import DOC_STAIRS, doc_stairs_shifted

_WIN = """win AS (SELECT feat.*, st.n_words_std AS std_x, st.n_chars_std AS std_y,
  greatest(n_words_min, n_words - 1.5e0 * n_words_std) AS lo_x, least(n_words_max, n_words + 1.5e0 * n_words_std) AS hi_x,
  greatest(n_chars_min, n_chars - 1.5e0 * n_chars_std) AS lo_y, least(n_chars_max, n_chars + 1.5e0 * n_chars_std) AS hi_y
  FROM feat, st)"""


def cells(scorer, nx, ny, seeds=False):
    x = lambda i: point(i, nx, "lo_x", "hi_x")
    y = lambda j: point(j, ny, "lo_y", "hi_y")
    s = ", seed" if seeds else ""
    return (
        DOCS, stats(DOC), _WIN,
        f"""cl AS (SELECT win.*, i, j{s}, {x('i')} AS zx, {y('j')} AS zy, {x(f'least(i + 1, {nx - 1})')} AS zxn,
          {y(f'least(j + 1, {ny - 1})')} AS zyn FROM win, (SELECT range::INTEGER AS i FROM range({nx})),
          (SELECT range::INTEGER AS j FROM range({ny})){', (SELECT range AS seed FROM range(12))' if seeds else ''})""",
        f"""sc AS (SELECT *, {scorer.sql({'n_words': 'zx', 'n_chars': 'zy'})} AS p, {scorer.sql({'n_words': 'zxn', 'n_chars': 'zy'})} AS pr,
          {scorer.sql({'n_words': 'zx', 'n_chars': 'zyn'})} AS pl FROM cl)""",
    )


_EDGE = """CASE WHEN (p >= 0.5e0) <> (pr >= 0.5e0) OR (p >= 0.5e0) <> (pl >= 0.5e0) THEN
  sqrt(((zx - n_words) / std_x) * ((zx - n_words) / std_x) + ((zy - n_chars) / std_y) * ((zy - n_chars) / std_y)) END"""
_S = DOC_STAIRS


def _cell(z, lo, hi, n):
    return f"least(greatest(floor(({z} - {lo}) / (({hi} - {lo}) / {n - 1})), 0), {n - 2})::INTEGER"


SQL = {
    "slice_2d": with_(*cells(_S, 220, 200))
    + f"""SELECT row_id, count(*) AS cells, {r6('avg(p)')} AS mean_p, {r6('min(p)')} AS min_p, {r6('max(p)')} AS max_p,
      count(*) FILTER (p >= 0.5e0) AS positive FROM sc GROUP BY row_id""",
    "slice_columns": with_(*cells(_S, 220, 200))
    + f"SELECT i, {r6('avg(p)')} AS mean_p, {r6('avg((p >= 0.5e0)::INTEGER)')} AS positive FROM sc GROUP BY i",
    "boundary_distance": with_(*cells(_S, 220, 200))
    + f"SELECT row_id, {r6(f'min({_EDGE})')} AS sigma FROM sc GROUP BY row_id",
    "boundary_shifted": with_(
        *cells(doc_stairs_shifted("seed"), 60, 60, True),
        f"bs AS (SELECT row_id, seed, min({_EDGE}) AS sigma FROM sc GROUP BY row_id, seed)",
    )
    + f"""SELECT row_id, count(sigma) AS n, {r6('min(sigma)')} AS min, {r6('median(sigma)')} AS median,
      {r6('max(sigma)')} AS max FROM bs GROUP BY row_id""",
    "slice_agreement": with_(
        DOCS, stats(_S.features), draws(_S.features, _S, n=500), _WIN.replace("FROM feat, st", "FROM feat, st"),
        f"""ag AS (SELECT win.*, y AS f, {point(_cell('r_n_words', 'lo_x', 'hi_x', 220), 220, 'lo_x', 'hi_x')} AS zx,
          {point(_cell('r_n_chars', 'lo_y', 'hi_y', 200), 200, 'lo_y', 'hi_y')} AS zy FROM win, draws
          WHERE r_n_words >= lo_x AND r_n_words <= hi_x AND r_n_chars >= lo_y AND r_n_chars <= hi_y)""",
        f"ah AS (SELECT row_id, f, {_S.sql({'n_words': 'zx', 'n_chars': 'zy'})} AS p FROM ag)",
    )
    + f"""SELECT row_id, count(*) AS in_window, {r6('avg(((p >= 0.5e0) = (f >= 0.5e0))::INTEGER)')} AS agree,
      {r6('greatest(avg((f >= 0.5e0)::INTEGER), 1 - avg((f >= 0.5e0)::INTEGER))')} AS baseline FROM ah GROUP BY row_id""",
    "isoline": more(
        more(_DFIT, _WIN),
        f"""il AS (SELECT fit.row_id, i, g, k1, k2, lo_y, hi_y, zx, CASE WHEN abs(k2) >= 1e-9
            THEN win.n_chars - (k1 / k2) * ((zx - win.n_words) / std_x) * std_y END AS y
          FROM fit JOIN (SELECT win.*, range::INTEGER AS i, {point('range', 220, 'lo_x', 'hi_x')} AS zx FROM win, range(220)) win
            ON fit.row_id = win.row_id)""",
    )
    + f"""SELECT row_id, i, {r6('zx', 3)} AS zx, {r6('y', 3)} AS y, coalesce(y >= lo_y AND y <= hi_y, false) AS inside,
      {r6('abs(g - 0.5e0) / nullif(sqrt(k1 * k1 + k2 * k2), 0)')} AS contour_distance FROM il""",
}
