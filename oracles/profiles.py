from __future__ import annotations

from oracles.common import DOC, DOCS, ORD, ORDERS, grid, point, r6, stats, sweep, with_
from probewise.plans.scorers import DOC_STAIRS, ORDER_STAIRS, doc_stairs_shifted

OF = ORDER_STAIRS.features
SETTINGS = """settings AS (SELECT span, n FROM (VALUES (1e0), (2.5e0), (5e0)) a(span),
  (VALUES (50), (200), (800)) b(n))"""


def points(scorer, features, n, keep="sweep.*", name="pts"):
    nxt = point(f"least(grid_idx + 1, {n - 1})", n)
    return f"""{name} AS (SELECT *, {scorer.swept_sql('z', features)} AS p,
      {scorer.swept_sql('z_next', features)} AS p_next
      FROM (SELECT {keep}, grid_idx, {point('grid_idx', n)} AS z, {nxt} AS z_next FROM sweep, grid))"""


def partners(names):
    """Strongest TRAIN partner of each feature and the ratio bounds of the pair (ALL rows)."""
    corr = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {ORD.index(b)} AS i, corr({a}, {b}) AS r FROM feat WHERE NOT is_test"
        for a in names for b in ORD if a != b
    )
    bounds = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, min({a} / nullif({b}, 0)) AS rlo, max({a} / nullif({b}, 0)) AS rhi FROM feat"
        for a in names for b in ORD if a != b
    )
    return (
        f"""corrs AS ({corr}), best AS (SELECT a, b, r FROM (SELECT *, row_number() OVER (
          PARTITION BY a ORDER BY abs(r) DESC, i) AS k FROM corrs) WHERE k = 1),
        allbounds AS ({bounds}),
        partner AS (SELECT best.a AS pfeature, best.b AS partner, r, rlo, rhi
          FROM best JOIN allbounds ON best.a = allbounds.a AND best.b = allbounds.b)"""
    )


PICK = "CASE partner " + " ".join(f"WHEN '{f}' THEN {f}" for f in ORD) + " END"
_STEP = "{'k': floor(abs(p_next - p) * 1e12 + 0.5e0), 'g': -grid_idx, 's': abs(p_next - p), 'z': z, 'zn': z_next}"
_ORD_SWEEP = (ORDERS, stats(OF), sweep(OF), grid(200), points(ORDER_STAIRS, OF, 200))
_BAND = "band AS (SELECT min(n_chars / n_words) AS rlo, max(n_chars / n_words) AS rhi FROM feat)"
_LOGIT = "1e0 / (1e0 + exp(-(0.002e0 * ({w} - 390e0) - 0.5e0 * ({c} - 6.4e0))))"

SQL = {
    "cp_grid": with_(ORDERS, stats(OF), sweep(OF))
    + f"""SELECT row_id, feature, {r6('lo', 3)} AS z_first, {r6('hi', 3)} AS z_last,
      {r6('(lo - x) / x_std')} AS reach_down, {r6('(hi - x) / x_std')} AS reach_up FROM sweep""",
    "full_grid": with_(ORDERS, stats(ORD), grid(120))
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, grid_idx, {r6(point('grid_idx', 120, f'{f}_min', f'{f}_max'), 4)} AS z FROM st, grid"
        for f in ORD
    ),
    "trimmed_grid": with_(
        ORDERS, stats(["qty"]), grid(120),
        """b AS (SELECT 'p5_p95' AS grid_name, quantile_cont(qty, 0.05) AS lo, quantile_cont(qty, 0.95) AS hi FROM feat
          UNION ALL SELECT 'median_1sd', median(qty) - any_value(qty_std), median(qty) + any_value(qty_std) FROM feat, st)""",
    )
    + f"SELECT grid_name, grid_idx, {r6(point('grid_idx', 120))} AS z FROM b, grid",
    "cp_profile": with_(DOCS, stats(DOC), sweep(DOC), grid(200), points(DOC_STAIRS, DOC, 200))
    + f"SELECT row_id, feature, grid_idx, {r6('z')} AS z, {r6('p')} AS p FROM pts",
    "cp_profile_pandas": with_(
        DOCS, stats(["n_words", "chars_per_word"]), sweep(["n_words", "chars_per_word"]), grid(200),
        f"q AS (SELECT sweep.*, grid_idx, {point('grid_idx', 200)} AS z FROM sweep, grid)",
    )
    + f"""SELECT row_id, feature, grid_idx, {r6('CASE feature WHEN $$n_words$$ THEN '
      + _LOGIT.format(w='z', c='chars_per_word') + ' ELSE ' + _LOGIT.format(w='n_words', c='z') + ' END')} AS p FROM q""",
    "cp_summary": with_(*_ORD_SWEEP)
    + f"""SELECT row_id, feature, {r6('min(p)')} AS p_min, {r6('max(p)')} AS p_max,
      {r6('max(p) - min(p)')} AS swing, max(p) >= 0.5e0 AND min(p) < 0.5e0 AS crosses
      FROM pts GROUP BY row_id, feature""",
    "cp_steps": with_(
        *_ORD_SWEEP,
        f"""agg AS (SELECT row_id, feature, count(*) FILTER (abs(p_next - p) > 0.01e0) AS n_big,
          max({_STEP}) AS w FROM pts GROUP BY row_id, feature)""",
    )
    + f"""SELECT row_id, feature, n_big, {r6('w.s')} AS largest, {r6('w.z', 3)} AS step_left,
      {r6('w.zn', 3)} AS step_right FROM agg""",
    "cp_grid_sensitivity": with_(
        DOCS, stats(DOC), _BAND, SETTINGS,
        """sweep AS (SELECT feat.*, span, n, rlo, rhi, greatest(n_chars_min, n_chars - span * n_chars_std) AS lo,
          least(n_chars_max, n_chars + span * n_chars_std) AS hi FROM feat, st, band, settings)""",
        grid(800),
        f"""pts AS (SELECT *, {DOC_STAIRS.sql({'n_chars': 'z'})} AS p, {DOC_STAIRS.sql({'n_chars': 'z_next'})} AS p_next
          FROM (SELECT sweep.*, grid_idx, {point('grid_idx', 'n')} AS z,
            {point('least(grid_idx + 1, n - 1)', 'n')} AS z_next FROM sweep JOIN grid ON grid_idx < n))""",
        f"""agg AS (SELECT row_id, span, n, max(p) - min(p) AS swing, max({_STEP}) AS w,
          avg((z / n_words < rlo OR z / n_words > rhi)::INTEGER) AS impossible FROM pts GROUP BY row_id, span, n)""",
    )
    .rstrip() + f""", wide AS (SELECT DISTINCT * EXCLUDE (n) FROM sweep),
      ends AS (SELECT row_id, span, lo AS e, true AS at_lo FROM wide
        UNION ALL SELECT row_id, span, 190.5e0 + 610e0 * range, false FROM wide, range(8)
          WHERE 190.5e0 + 610e0 * range >= lo AND 190.5e0 + 610e0 * range < hi),
      sides AS (SELECT ends.row_id, ends.span, e, at_lo, {DOC_STAIRS.sql({'n_chars': 'e'})} AS p,
        {DOC_STAIRS.sql({'n_chars': '(e + 1e-6)'})} AS q, hi FROM ends JOIN wide ON ends.row_id = wide.row_id AND ends.span = wide.span),
      jumps AS (SELECT row_id, span, greatest(max(p), max(q) FILTER (NOT at_lo)) - least(min(p), min(q) FILTER (NOT at_lo)) AS swing,
        max({{'s': round(abs(q - p), 12), 'e': -e}}) FILTER (NOT at_lo) AS w FROM sides GROUP BY row_id, span)
      SELECT row_id, span, n, {r6('swing')} AS swing, {r6('w.s')} AS largest,
      {r6('w.z', 3)} AS step_left, {r6('impossible')} AS impossible FROM agg
      UNION ALL SELECT wide.row_id, wide.span, 0, {r6('swing')}, {r6('coalesce(w.s, 0)')}, {r6('-w.e', 3)},
        {r6("""CASE WHEN hi > lo THEN 1 - greatest(least(rhi * n_words, hi) - greatest(rlo * n_words, lo), 0) / (hi - lo)
          ELSE (lo < rlo * n_words OR lo > rhi * n_words)::INTEGER END""")}
        FROM wide JOIN jumps ON wide.row_id = jumps.row_id AND wide.span = jumps.span""",
    "cp_seed_sensitivity": with_(
        DOCS, stats(["n_words"]), sweep(["n_words"]), grid(200),
        f"""pts AS (SELECT row_id, grid_idx, seed, {doc_stairs_shifted('seed').sql({'n_words': 'z'})} AS p
          FROM (SELECT sweep.*, grid_idx, range AS seed, {point('grid_idx', 200)} AS z FROM sweep, grid, range(12)))""",
        "a AS (SELECT row_id, seed, max(p) - min(p) AS swing FROM pts GROUP BY row_id, seed)",
        "b AS (SELECT row_id, grid_idx, stddev_pop(p) AS sd FROM pts GROUP BY row_id, grid_idx)",
        "c AS (SELECT row_id, median(swing) AS m, min(swing) AS lo, max(swing) AS hi FROM a GROUP BY row_id)",
        "d AS (SELECT row_id, median(sd) AS sm, max(sd) AS sx FROM b GROUP BY row_id)",
    )
    + f"""SELECT c.row_id, {r6('m')} AS swing_median, {r6('lo')} AS swing_min, {r6('hi')} AS swing_max,
      {r6('sm')} AS sd_median, {r6('sx')} AS sd_max FROM c JOIN d ON c.row_id = d.row_id""",
    "cp_slope": with_(
        ORDERS, stats(OF), sweep(OF),
        f"""d AS (SELECT *, {ORDER_STAIRS.swept_sql('(x + h * x_std)', OF)}
          - {ORDER_STAIRS.swept_sql('(x - h * x_std)', OF).join(['(', ')'])} AS delta
          FROM sweep, (VALUES (0.1e0), (0.3e0), (0.5e0), (1e0)) s(h))""",
    )
    + f"SELECT row_id, feature, h, {r6('delta')} AS delta, {r6('delta / (2 * h)')} AS slope FROM d",
    "cp_restricted": with_(
        DOCS, stats(DOC), sweep(["n_chars"]), grid(200), points(DOC_STAIRS, ["n_chars"], 200), _BAND,
        """o AS (SELECT *, CASE WHEN z / n_words >= rlo AND z / n_words <= rhi THEN p END AS ok FROM pts, band)""",
        """a AS (SELECT row_id, max(p) - min(p) AS f, max(ok) - min(ok) AS r, max(p) >= 0.5e0 AND min(p) < 0.5e0 AS cf,
          coalesce(max(ok) >= 0.5e0 AND min(ok) < 0.5e0, false) AS cr FROM o GROUP BY row_id)""",
    )
    + f"""SELECT row_id, {r6('f')} AS swing_full, {r6('r')} AS swing_restricted,
      {r6('r / nullif(f, 0)')} AS surviving, cf AS crosses_full, cr AS crosses_restricted FROM a""",
    "cp_feature_summary": with_(
        ORDERS, stats(OF), partners(OF), sweep(OF), grid(200),
        f"""pts AS (SELECT *, {ORDER_STAIRS.swept_sql('z', OF)} AS p,
          z / nullif({PICK}, 0) AS ratio FROM (SELECT sweep.*, partner, rlo, rhi, grid_idx,
          {point('grid_idx', 200)} AS z FROM sweep JOIN partner ON pfeature = feature, grid))""",
    )
    + f"""SELECT row_id, feature, {r6('avg(coalesce(ratio < rlo OR ratio > rhi, false)::INTEGER)')} AS impossible,
      {r6('max(p) - min(p)')} AS swing FROM pts GROUP BY row_id, feature""",
}

SQL["cp_profile_batch"] = SQL["cp_profile_pandas"]
