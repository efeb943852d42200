from __future__ import annotations

from oracles.basics import _band
from oracles.common import DOC, DOCS, ORDERS, grid, p_of, point, r6, stats, sweep, with_
from probewise.plans.scorers import DOC_STAIRS, ORDER_STAIRS, interaction_scorer

OF = ORDER_STAIRS.features
N = 120


def slope_points(scorer, features, n, src="sweep", keep="row_id, feature", name="pts", on=""):
    top = n - 1 if isinstance(n, int) else f"({n} - 1)"
    zl, zr = point("greatest(grid_idx - 1, 0)", n), point(f"least(grid_idx + 1, {top})", n)
    return f"""{name} AS (SELECT {keep}, grid_idx, z, p, (pr - pl) / (zr - zl) AS slope FROM (
      SELECT *, {scorer.swept_sql('z', features)} AS p, {scorer.swept_sql('zl', features)} AS pl,
        {scorer.swept_sql('zr', features)} AS pr FROM (
        SELECT {src}.*, grid_idx, {point('grid_idx', n)} AS z, {zl} AS zl, {zr} AS zr
        FROM {src} JOIN grid ON {on or 'true'})))"""


def bundle(key="feature"):
    return f"""b0 AS (SELECT {key}, grid_idx, min(z) AS z, count(*) AS n, avg(p) AS pdp, avg(slope) AS ms,
        stddev_pop(slope) AS sd, count(*) FILTER (slope > 1e-9) AS up, count(*) FILTER (slope < -1e-9) AS down
        FROM pts GROUP BY {key}, grid_idx),
      b1 AS (SELECT *, up + down AS moving, CASE WHEN ms > 1e-12 THEN down WHEN ms < -1e-12 THEN up
        ELSE up + down END AS against FROM b0),
      b AS (SELECT *, against / greatest(moving, 1)::DOUBLE AS share FROM b1),
      steep0 AS (SELECT *, max(abs(ms)) OVER (PARTITION BY {key}) AS top FROM b),
      steep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY grid_idx) AS k
        FROM steep0 WHERE abs(ms) >= top * (1 - 1e-9)) WHERE k = 1),
      ranges AS (SELECT row_id, {key}, max(p) - min(p) AS rng FROM pts GROUP BY row_id, {key})"""


def orders(features):
    return with_(
        ORDERS, stats(OF), sweep(features, "full"), grid(N),
        slope_points(ORDER_STAIRS, features, N), bundle(),
    )


def edges(features):
    return with_(
        ORDERS, stats(OF), sweep(features, "full"),
        f"""e AS (SELECT *, pl - pf AS net FROM (SELECT row_id, feature,
          {ORDER_STAIRS.swept_sql('lo', features)} AS pf, {ORDER_STAIRS.swept_sql('hi', features)} AS pl FROM sweep))""",
    )


_DOC = (DOCS, stats(DOC), sweep(["n_words"], "full"), grid(N), slope_points(DOC_STAIRS, ["n_words"], N))
_INTER = with_(
    ORDERS, stats(["qty", "gross"]), sweep(["qty"], "full"),
    "ss AS (SELECT sweep.*, strength FROM sweep, (VALUES (0e0), (0.25e0), (0.5e0), (0.75e0), (1e0)) s(strength))",
    grid(N), slope_points(interaction_scorer("strength"), ["qty"], N, "ss", "row_id, strength"),
    bundle("strength"),
    """sw AS (SELECT b.strength, max(pdp) - min(pdp) AS swing, max(share) AS worst FROM b GROUP BY strength),
      md AS (SELECT strength, median(rng) AS m FROM ranges GROUP BY strength)""",
)

SQL = {
    "ice_curves": with_(*_DOC) + f"SELECT row_id, grid_idx, {r6('z')} AS z, {r6('p')} AS p FROM pts",
    "ice_centred": with_(*_DOC)
    + f"""SELECT row_id, grid_idx, {r6('p - first_value(p) OVER (PARTITION BY row_id ORDER BY grid_idx)')} AS change
      FROM pts""",
    "ice_centred_mean": orders(["qty"]).rstrip()
    + f""", c AS (SELECT grid_idx, p - first_value(p) OVER (PARTITION BY row_id ORDER BY grid_idx) AS d FROM pts)
      SELECT grid_idx, {r6('avg(d)')} AS change FROM c GROUP BY grid_idx""",
    "pdp": orders(OF) + f"SELECT feature, grid_idx, {r6('z', 3)} AS z, {r6('pdp')} AS pdp FROM b",
    "ice_range": orders(["qty"])
    + f"""SELECT count(*) AS n, {r6('median(rng)')} AS median, {r6('avg(rng)')} AS mean, {r6('min(rng)')} AS min,
      {r6('max(rng)')} AS max, {r6('avg((rng < 0.05e0)::INTEGER)')} AS flat, {r6('max(rng) / min(rng)')} AS ratio
      FROM ranges""",
    "range_histogram": orders(["qty"]).rstrip()
    + """, e AS (SELECT min(rng) AS lo, max(rng) AS hi FROM ranges),
      h AS (SELECT least(floor((rng - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, count(*) AS n FROM ranges, e GROUP BY 1)
      SELECT range::INTEGER AS bin, coalesce(n, 0) AS n FROM range(30) LEFT JOIN h ON h.bin = range""",
    "ice_edge_modes": edges(OF)
    + """SELECT feature, count(*) FILTER (pf > 0.8e0) AS above, count(*) FILTER (pf < 0.2e0) AS below,
      count(*) FILTER (pf >= 0.2e0 AND pf <= 0.8e0) AS between FROM e GROUP BY feature""",
    "ice_net_change": edges(OF)
    + f"""SELECT feature, {r6('quantile_cont(net, 0.05)')} AS p5, {r6('median(net)')} AS median,
      {r6('quantile_cont(net, 0.95)')} AS p95, count(*) FILTER (net > 0) AS rising, count(*) AS n_rows
      FROM e GROUP BY feature""",
    "ice_net_cv": edges(OF)
    + f"SELECT feature, {r6('stddev_pop(net) / greatest(abs(avg(net)), 1e-12)')} AS cv FROM e GROUP BY feature",
    "ice_derivative": orders(["qty"])
    + f"SELECT grid_idx, {r6('ms')} AS mean_slope, {r6('sd')} AS sd_slope, up, down FROM b",
    "ice_derivative_rows": with_(*_DOC) + f"SELECT row_id, grid_idx, {r6('slope')} AS slope FROM pts",
    "ice_disagreement": orders(OF)
    + f"""SELECT feature, grid_idx, {r6('z', 3)} AS z, {r6('pdp')} AS pdp, moving, against,
      {r6('share')} AS against_share FROM b""",
    "ice_steepest": orders(OF)
    + f"""SELECT feature, grid_idx AS steep_idx, {r6('z', 3)} AS steep_z, {r6('share')} AS against_at_steepest,
      moving AS moving_at_steepest, n AS n_rows FROM steep""",
    "pdp_active_range": orders(OF)
    + f"""SELECT feature, {r6('min(z)', 3)} AS z_from, {r6('max(z)', 3)} AS z_to, count(*) AS n_points
      FROM b WHERE abs(ms) > 1e-12 GROUP BY feature""",
    "ice_spikes": orders(OF)
    + f"""SELECT feature, grid_idx, {r6('share')} AS against_share, moving, {r6('abs(ms) / top', 5)} AS relative_slope
      FROM (SELECT *, lag(share) OVER w AS l, lead(share) OVER w AS r FROM steep0
        WINDOW w AS (PARTITION BY feature ORDER BY grid_idx))
      WHERE share >= l AND share >= r AND share > 0.05e0""",
    "ice_feature_table": orders(OF).rstrip()
    + f""", a AS (SELECT feature, avg((rng < 0.05e0)::INTEGER) AS flat, median(rng) AS m FROM ranges GROUP BY feature),
      x AS (SELECT feature, max(share) AS worst FROM b GROUP BY feature)
      SELECT a.feature, {r6('flat')} AS flat, {r6('m')} AS median, {r6('steep.share')} AS against_at_steepest,
        {r6('worst')} AS max_against
      FROM a JOIN x ON a.feature = x.feature JOIN steep ON a.feature = steep.feature""",
    "dice_gate": orders(OF).rstrip()
    + f""", g AS (SELECT feature, quantile_cont(abs(ms), 0.75) AS gate FROM b GROUP BY feature),
      k AS (SELECT b.*, abs(ms) > gate * (1 + 1e-9) AS inside FROM b JOIN g ON b.feature = g.feature)
      SELECT feature, count(*) FILTER (inside) AS n_gate,
        {r6('median(sd / greatest(abs(ms), 1e-12)) FILTER (inside)', 5)} AS sd_ratio,
        {r6('avg(against / n::DOUBLE) FILTER (inside)')} AS flips_all,
        {r6('avg(share) FILTER (inside)')} AS flips_movers,
        {r6('avg((n - moving) / n::DOUBLE) FILTER (inside)')} AS still_gate,
        {r6('sum(n - moving)::DOUBLE / sum(n)')} AS still_grid FROM k GROUP BY feature""",
    "ice_grid_robustness": with_(
        ORDERS, stats(["qty"]),
        """grids AS (SELECT 'full_' || n AS grid_name, qty_min AS lo, qty_max AS hi, n FROM st, (VALUES (40), (120), (400)) v(n)
          UNION ALL SELECT 'p5_p95', quantile_cont(qty, 0.05), quantile_cont(qty, 0.95), 120 FROM feat
          UNION ALL SELECT 'median_1sd', median(qty) - any_value(qty_std), median(qty) + any_value(qty_std), 120 FROM feat, st)""",
        "sg AS (SELECT feat.*, grid_name, lo, hi, n FROM feat, grids)",
        grid(400),
        slope_points(ORDER_STAIRS, ["qty"], "n", "sg", "row_id, grid_name", on="grid_idx < n"),
        bundle("grid_name"),
        "a AS (SELECT grid_name, avg((rng < 0.05e0)::INTEGER) AS flat, median(rng) AS m FROM ranges GROUP BY grid_name)",
    )
    + f"""SELECT a.grid_name, {r6('flat')} AS flat, {r6('m')} AS median, {r6('share')} AS against_at_steepest
      FROM a JOIN steep ON a.grid_name = steep.grid_name""",
    "swing_ratio": orders(OF).rstrip()
    + f""", s AS (SELECT feature, max(pdp) - min(pdp) AS sw FROM b GROUP BY feature),
      a AS (SELECT feature, avg(rng) AS mean, median(rng) AS m FROM ranges GROUP BY feature)
      SELECT s.feature, {r6('sw')} AS pdp_swing, {r6('sw / m')} AS to_median, {r6('sw / mean')} AS to_mean
      FROM s JOIN a ON s.feature = a.feature""",
    "interaction_control": _INTER
    + f"""SELECT {r6('share')} AS against_at_steepest, {r6('worst')} AS max_against, {r6('swing')} AS pdp_swing,
      {r6('m')} AS median FROM sw JOIN md ON sw.strength = md.strength JOIN steep ON sw.strength = steep.strength
      WHERE sw.strength = 1e0""",
    "interaction_power": _INTER
    + f"""SELECT sw.strength, {r6('share')} AS against_at_steepest, {r6('swing')} AS pdp_swing, {r6('m')} AS median,
      {r6('swing / m')} AS ratio
      FROM sw JOIN md ON sw.strength = md.strength JOIN steep ON sw.strength = steep.strength""",
    "confidence_vs_range": orders(["qty"]).rstrip()
    + f""", o AS (SELECT feat.row_id, {ORDER_STAIRS.sql()} AS own FROM feat),
      j AS (SELECT own, abs(own - 0.5e0) AS conf, rng FROM ranges JOIN o ON ranges.row_id = o.row_id),
      c AS (SELECT corr(conf, rng) AS r, count(*) AS n FROM j),
      k AS (SELECT {_band('own')} AS band, rng FROM j)
      SELECT band, count(*) AS n_rows, {r6('median(rng)')} AS median_range, {r6('any_value(r)')} AS r,
        {r6('any_value(r * sqrt((c.n - 2) / (1 - r * r)))', 4)} AS t, {r6('any_value(p)', 9)} AS p
      FROM k, (SELECT *, {p_of('r', 'n')} AS p FROM c) c WHERE band IS NOT NULL GROUP BY band""",
}
