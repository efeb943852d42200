"""SQL of the queries with fitted trees, over the leaves of the fit.

A fit is the engine's own, so these are no twins by themselves: they read a view ``boxes`` that holds one
row per leaf (``Trees.leaf_boxes``), find each row's leaves by its bounds and sum them. The tests run a
query, give DuckDB the leaves of that very fit, and compare.
"""

from __future__ import annotations

from oracles.basics import _band
from oracles.common import DOC, DOCS, grid, normal, point, r6, stats, sweep, with_
from oracles.ice import bundle, slope_points
from oracles.surrogate import fit
from probewise.plans.scorers import ExpressionScorer

SQL: dict[str, str] = {}


def boxed(model: str = "0", trees: int = 300, scale: float = 2.0**40) -> ExpressionScorer:
    """A forest as text: the summed leaves whose bounds hold the row, over trees and scale."""
    inside = " AND ".join(f"({{{f}}}) > {f}_above AND ({{{f}}}) <= {f}_upto" for f in DOC)
    text = f"((SELECT sum(value) FROM boxes WHERE model = {model} AND {inside})::DOUBLE / {trees * scale!r}e0)"
    return ExpressionScorer(text, DOC)


def _placed(over: str, name: str = "placed") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY {over} ORDER BY md5('42|' || row_id), row_id) AS pos,
      count(*) OVER (PARTITION BY {over}) AS n_class FROM raw)"""


#: All documents with the exact split by class in place of the hashed flag.
SPLIT = (
    DOCS.replace("feat AS", "raw AS", 1),
    _placed("label"),
    "feat AS (SELECT * EXCLUDE (pos, n_class, is_test), pos <= ceil(0.25e0 * n_class) AS is_test FROM placed)",
    "held AS (SELECT * FROM feat WHERE is_test)",
)
FOLDS = (
    DOCS.replace("feat AS", "raw0 AS", 1), "raw AS (SELECT * FROM raw0 WHERE label IS NOT NULL)", _placed("label"),
    "s AS (SELECT *, CAST((pos - 1) % 10 AS INTEGER) AS fold FROM placed)",
    f"o AS (SELECT row_id, fold, label, {boxed('fold').sql()} AS p FROM s)",
)
_AUC = """SELECT count(*) AS n, avg((CAST(p >= 0.5e0 AS INTEGER) = label)::INTEGER) AS accuracy,
  (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2e0)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc
  FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r FROM o)"""


def _scores(scorer: ExpressionScorer) -> str:
    return with_(*SPLIT) + f"SELECT row_id, label::DOUBLE AS label, {r6(scorer.sql())} AS p FROM held"


def gbt_scores(scorer: ExpressionScorer) -> str:
    """The boosted model by its own SQL text."""
    return _scores(scorer)


SQL_OVER_BOXES = {
    "rf_scores": _scores(boxed()),
    "rf_metrics": with_(
        *SPLIT, f"o AS (SELECT label, round({boxed().sql()}, 6) AS p FROM held WHERE label IS NOT NULL)", f"a AS ({_AUC})"
    )
    + f"SELECT n, {r6('accuracy')} AS accuracy, {r6('auc')} AS auc FROM a",
    "oof_scores": with_(*FOLDS) + f"SELECT row_id, fold, label, {r6('p')} AS p FROM o",
    "oof_accuracy_by_band": with_(
        *FOLDS[:-1], f"o AS (SELECT row_id, label, round({boxed('fold').sql()}, 6) AS p FROM s)", f"a AS ({_AUC})",
        f"b AS (SELECT *, {_band('p', True)} AS band FROM o)",
    )
    + f"""SELECT band, count(*) AS n, {r6('avg((CAST(p >= 0.5e0 AS INTEGER) = label)::INTEGER)')} AS accuracy,
      {r6('(SELECT auc FROM a)')} AS auc FROM b GROUP BY band""",
    "ice_forest": with_(
        *SPLIT, stats(DOC), sweep(["n_words", "n_chars"], "full", src="held"), grid(120),
        slope_points(boxed(), ["n_words", "n_chars"], 120), bundle(),
    )
    + f"SELECT feature, grid_idx, {r6('pdp')} AS pdp, moving, against, {r6('share')} AS against_share FROM b",
    "cp_seed_forest": with_(
        *SPLIT, stats(DOC), sweep(["n_chars"], src="held"), grid(200),
        f"""pts AS (SELECT row_id, grid_idx, seed, z, {boxed('seed').sql({'n_chars': 'z'})} AS p
          FROM (SELECT sweep.*, grid_idx, range AS seed, {point('grid_idx', 200)} AS z FROM sweep, grid, range(12)))""",
        """st1 AS (SELECT row_id, seed, z, grid_idx, abs(lead(p) OVER (PARTITION BY row_id, seed ORDER BY grid_idx) - p) AS step FROM pts)""",
        "places AS (SELECT row_id, seed, arg_min(z, (-round(step, 12), grid_idx)) AS z FROM st1 WHERE step IS NOT NULL GROUP BY row_id, seed)",
        "a AS (SELECT row_id, seed, max(p) - min(p) AS swing FROM pts GROUP BY row_id, seed)",
        "b AS (SELECT row_id, grid_idx, stddev_pop(p) AS sd FROM pts GROUP BY row_id, grid_idx)",
        "c AS (SELECT row_id, median(swing) AS m, min(swing) AS lo, max(swing) AS hi FROM a GROUP BY row_id)",
        "d AS (SELECT row_id, median(sd) AS sm, max(sd) AS sx FROM b GROUP BY row_id)",
        "e AS (SELECT row_id, median(z) AS zm, min(z) AS zl, max(z) AS zh FROM places GROUP BY row_id)",
    )
    + f"""SELECT c.row_id, {r6('m')} AS swing_median, {r6('lo')} AS swing_min, {r6('hi')} AS swing_max,
      {r6('zm', 3)} AS step_median, {r6('zl', 3)} AS step_min, {r6('zh', 3)} AS step_max,
      {r6('sm')} AS sd_median, {r6('sx')} AS sd_max FROM c JOIN d ON c.row_id = d.row_id JOIN e ON c.row_id = e.row_id""",
    "explain_forest": with_(*fit(False, scorer=boxed(), tables=SPLIT, rows="held"))
    + f"""SELECT row_id, {r6('k1')} AS coef_n_chars, {r6('k2')} AS coef_n_words, {r6('k3')} AS coef_chars_per_word,
      {r6('p')} AS p, {r6('g')} AS g, {r6('r2')} AS r2 FROM fit""",
    "interaction_forest": with_(
        DOCS.replace("feat AS", "own AS", 1), stats(["n_words", "chars_per_word"], "own", "so"),
        """strengths AS (SELECT model, strength FROM (VALUES (0, 0e0), (1, 0.25e0), (2, 0.5e0), (3, 0.75e0), (4, 1e0)) s(model, strength))""",
        f"""raw AS (SELECT own.* EXCLUDE (label), model AS which, strength, CAST(((n_words - n_words_mean) / n_words_std) * ((1 - strength)
          + strength * sign((chars_per_word - chars_per_word_mean) / chars_per_word_std)) + 0.3e0 * {normal("'0'", 'row_id')} > 0 AS INTEGER) AS label
          FROM own, so, strengths)""",
        _placed("which, label"),
        "feat AS (SELECT * FROM own)", stats(DOC),
        "held AS (SELECT * FROM placed WHERE pos <= ceil(0.25e0 * n_class))",
        sweep(["n_words"], "full", src="held"), grid(120),
        slope_points(boxed("which"), ["n_words"], 120, keep="row_id, strength"), bundle("strength"),
        "sw AS (SELECT strength, max(pdp) - min(pdp) AS swing FROM b GROUP BY strength)",
        "md AS (SELECT strength, median(rng) AS m FROM ranges GROUP BY strength)",
    )
    + f"""SELECT sw.strength, {r6('share')} AS against_at_steepest, {r6('swing')} AS pdp_swing, {r6('m')} AS median,
      {r6('swing / nullif(m, 0)')} AS ratio
      FROM sw JOIN md ON sw.strength = md.strength JOIN steep ON sw.strength = steep.strength""",
}


def boundary_seeds(nx: int, ny: int) -> str:
    p = lambda i, j: boxed("seed").sql({"n_words": point(i, nx, "lo_x", "hi_x"), "n_chars": point(j, ny, "lo_y", "hi_y")})
    bounds = ", ".join(
        f"greatest({f}_min, {f} - 1.5e0 * {f}_std) AS lo_{a}, least({f}_max, {f} + 1.5e0 * {f}_std) AS hi_{a}"
        for a, f in (("x", "n_words"), ("y", "n_chars"))
    )
    dx = f"({point('i', nx, 'lo_x', 'hi_x')} - n_words) / n_words_std"
    dy = f"({point('j', ny, 'lo_y', 'hi_y')} - n_chars) / n_chars_std"
    return with_(
        *SPLIT, stats(DOC), f"w AS (SELECT held.*, n_words_std, n_chars_std, {bounds} FROM held, st)",
        f"""cells AS (SELECT row_id, seed, i, j, {p('i', 'j')} >= 0.5e0 AS side, sqrt(({dx}) * ({dx}) + ({dy}) * ({dy})) AS d
          FROM (SELECT w.*, x.range AS i, y.range AS j, s.range AS seed FROM w, range({nx}) x, range({ny}) y, range(12) s))""",
        """near AS (SELECT *, lead(side) OVER (PARTITION BY row_id, seed, j ORDER BY i) AS r,
          lead(side) OVER (PARTITION BY row_id, seed, i ORDER BY j) AS l FROM cells)""",
        """e AS (SELECT row_id, seed, min(d) FILTER (side <> coalesce(r, side) OR side <> coalesce(l, side)) AS sigma
          FROM near GROUP BY row_id, seed)""",
    ) + f"""SELECT row_id, count(sigma) AS n, {r6('min(sigma)')} AS min, {r6('median(sigma)')} AS median, {r6('max(sigma)')} AS max
      FROM e GROUP BY row_id"""
