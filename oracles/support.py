from __future__ import annotations

from oracles.common import DOC, DOCS, ORD, ORDERS, grid, point, r6, stats, sweep, uniform, with_
from oracles.profiles import PICK, _STEP, partners, points
from probewise.plans.scorers import DOC_STAIRS, ORDER_STAIRS

OF = ORDER_STAIRS.features


def rows_share(band):
    return with_(
        ORDERS, stats(["qty"]), sweep(["qty"]), grid(200), f"band AS (SELECT {band} FROM feat)",
        f"pts AS (SELECT row_id, z / list_value AS r FROM (SELECT sweep.*, {point('grid_idx', 200)} AS z FROM sweep, grid))",
        """per_row AS (SELECT row_id, count(*) FILTER (r < rlo OR r > rhi) AS k, avg((r < rlo OR r > rhi)::INTEGER) AS s
          FROM pts, band GROUP BY row_id)""",
    )


_MINMAX = "min(qty / list_value) AS rlo, max(qty / list_value) AS rhi"
_TOL = "quantile_cont(qty / list_value, 0.01) AS rlo, quantile_cont(qty / list_value, 0.99) AS rhi"


def all_features(names, kind, n):
    return with_(
        ORDERS, stats(ORD), partners(ORD), sweep(names, kind), grid(n),
        f"""pts AS (SELECT feature, z / nullif({PICK}, 0) AS ratio, rlo, rhi FROM (SELECT sweep.*, partner, rlo, rhi,
          {point('grid_idx', n)} AS z FROM sweep JOIN partner ON pfeature = feature, grid))""",
        "sh AS (SELECT feature, avg((ratio < rlo OR ratio > rhi)::INTEGER) AS s FROM pts GROUP BY feature)",
        """tab AS (SELECT feature, partner, abs(r) AS abs_r, s, CASE WHEN rlo > 0 THEN rhi / rlo ELSE 'inf'::DOUBLE END AS band
          FROM sh JOIN partner ON feature = pfeature)""",
    )


def _gap(a, b, n):
    return " + ".join(f"({a}.z{i} - {b}.z{i}) * ({a}.z{i} - {b}.z{i})" for i in range(n))


def distances(a, b, metric="e"):
    """Distance of two aliases over the three document columns."""
    if metric == "e":
        return f"sqrt({_gap(a, b, 3)})"
    terms = [f"({a}.z{i} - {b}.z{i}) * ({a}.z{j} - {b}.z{j}) * i{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)]
    return f"sqrt(greatest({' + '.join(terms)}, 0))"


_MINORS = {  # of the symmetric 3 x 3 covariance c00 .. c22
    "00": "c11 * c22 - c12 * c12", "01": "c02 * c12 - c01 * c22", "02": "c01 * c12 - c02 * c11",
    "11": "c00 * c22 - c02 * c02", "12": "c01 * c02 - c00 * c12", "22": "c00 * c11 - c01 * c01",
}


def sweep_nn(metric="e", exclude=True):
    cov = ", ".join(f"covar_samp(z{i}, z{j}) AS c{i}{j}" for i in range(3) for j in range(i, 3))
    inv = ", ".join(f"({m}) / det AS i{k}" for k, m in _MINORS.items())
    det = f"c00 * ({_MINORS['00']}) + c01 * ({_MINORS['01']}) + c02 * ({_MINORS['02']})"
    own = ", ".join(f"({f} - {f}_mean) / {f}_std AS z{i}" for i, f in enumerate(DOC))
    moved = ", ".join(f"({'z' if f == 'n_chars' else f} - {f}_mean) / {f}_std AS z{i}" for i, f in enumerate(DOC))
    return with_(
        DOCS, stats(DOC), sweep(["n_chars"]), grid(200),
        f"real AS (SELECT row_id, {own} FROM feat, st)",
        f"cv AS (SELECT {cov} FROM real)", f"cd AS (SELECT *, {det} AS det FROM cv)", f"inv AS (SELECT {inv} FROM cd)",
        "band AS (SELECT min(n_chars / n_words) AS rlo, max(n_chars / n_words) AS rhi FROM feat)",
        f"nn AS (SELECT a.row_id, min({distances('a', 'b', metric)}) AS d FROM real a JOIN real b ON a.row_id <> b.row_id, inv GROUP BY a.row_id)",
        "cut AS (SELECT quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.75) AS p75, quantile_cont(d, 0.95) AS p95 FROM nn)",
        f"""probes AS (SELECT row_id, grid_idx, {moved},
          abs(z - x) / x_std AS moved, z / n_words < rlo OR z / n_words > rhi AS bad
          FROM (SELECT sweep.*, grid_idx, {point('grid_idx', 200)} AS z FROM sweep, grid), st, band)""",
        f"""pd AS (SELECT row_id, grid_idx, any_value(moved) AS moved, any_value(bad) AS bad, min(w.d) AS d, min(w).id AS id
          FROM (SELECT p.row_id, p.grid_idx, moved, bad, {{'d': {distances('p', 'b', metric)}, 'id': b.row_id}} AS w
            FROM probes p JOIN real b ON {'p.row_id <> b.row_id' if exclude else 'true'}, inv) GROUP BY row_id, grid_idx)""",
    )


def _near(src, names):
    """Nearest other row of every row over the standardised ``names``, the least id of equally near ones."""
    z = ", ".join(f"({f} - {f}_mean) / {f}_std AS z{i}" for i, f in enumerate(names))
    return with_(
        src, stats(names), f"z AS (SELECT row_id, {z} FROM feat, st)",
        f"""nn AS (SELECT row_id, min(w).d AS d, min(w).id AS id FROM (SELECT a.row_id, {{'d': sqrt({_gap('a', 'b', len(names))}), 'id': b.row_id}} AS w
          FROM z a JOIN z b ON a.row_id <> b.row_id) GROUP BY row_id)""",
    )


_ORDNN = _near(ORDERS, ORD)
_DIMS = [f"d{i}" for i in range(64)]
_VEC = f"""feat AS (SELECT vec_id AS row_id, {', '.join(f'embedding[{i + 1}]::DOUBLE AS d{i}' for i in range(64))},
  {uniform("'42'", 'vec_id')} < 0.25e0 AS is_test FROM embeddings)"""

SQL = {
    "envelope": with_(ORDERS)
    + " UNION ALL ".join(
        f"""SELECT '{a}/{b}' AS pair, {r6(f'min({a} / {b})')} AS lo, {r6(f'max({a} / {b})')} AS hi,
        {r6(f'max({a} / {b}) / min({a} / {b})')} AS band FROM feat"""
        for a, b in (("qty", "list_value"), ("net", "gross"), ("gross", "qty"))
    ),
    "impossible_share": rows_share(_MINMAX)
    + f"SELECT row_id, k AS n_impossible, {r6('s')} AS impossible FROM per_row",
    "impossible_tolerance": rows_share(_TOL)
    + f"SELECT row_id, k AS n_impossible, {r6('s')} AS impossible FROM per_row",
    "step_inside_band": with_(
        DOCS, stats(DOC), sweep(["n_chars"]), grid(200), points(DOC_STAIRS, ["n_chars"], 200),
        "band AS (SELECT min(n_chars / n_words) AS rlo, max(n_chars / n_words) AS rhi FROM feat)",
        f"a AS (SELECT row_id, n_words, max({_STEP}) AS w FROM pts GROUP BY row_id, n_words)",
    )
    + f"""SELECT row_id, {r6('w.z', 3)} AS step_left, w.z / n_words >= rlo AND w.z / n_words <= rhi AS inside
      FROM a, band""",
    "strongest_partner": with_(ORDERS, partners(ORD))
    + f"SELECT pfeature AS feature, partner, {r6('r')} AS r FROM partner",
    "envelope_all_features": all_features(ORD, "span", 200)
    + f"""SELECT feature, partner, {r6('abs_r', 5)} AS abs_r, {r6('s', 5)} AS impossible, {r6('band', 5)} AS band FROM tab""",
    "envelope_rank_corr": all_features(ORD, "span", 200).rstrip()
    + f""", l AS (SELECT 'abs_r' AS against, round(abs_r, 9) AS x, round(s, 9) AS y FROM tab
        UNION ALL SELECT 'band', round(band, 6), round(s, 9) FROM tab),
      k AS (SELECT against, rank() OVER (PARTITION BY against ORDER BY x) + (count(*) OVER (PARTITION BY against, x) - 1) / 2e0 AS rx,
        rank() OVER (PARTITION BY against ORDER BY y) + (count(*) OVER (PARTITION BY against, y) - 1) / 2e0 AS ry FROM l),
      c AS (SELECT against, corr(rx, ry) AS rho, count(*) AS n FROM k GROUP BY against)
      SELECT against, {r6('rho')} AS rho, n, {r6('(SELECT median(s) FROM tab)')} AS median_all,
        {r6('(SELECT median(s) FROM tab WHERE abs_r > 0.9e0)')} AS median_strong FROM c""",
    "ice_envelope": with_(
        ORDERS, stats(["qty"]), sweep(["qty"], "full"), grid(120), f"band AS (SELECT {_MINMAX} FROM feat)",
        f"""pts AS (SELECT row_id, grid_idx, z / list_value < rlo OR z / list_value > rhi AS o
          FROM (SELECT sweep.*, grid_idx, {point('grid_idx', 120)} AS z FROM sweep, grid), band)""",
    )
    + f"""SELECT 'grid' AS level, grid_idx, {r6('avg(o::INTEGER)')} AS impossible FROM pts GROUP BY grid_idx
      UNION ALL SELECT 'pooled', -1, {r6('avg(o::INTEGER)')} FROM pts
      UNION ALL SELECT 'rows_over_half', -1, {r6('avg((s > 0.5e0)::INTEGER)')}
        FROM (SELECT avg(o::INTEGER) AS s FROM pts GROUP BY row_id)""",
    "ice_envelope_local": rows_share(_MINMAX)
    + f"SELECT {r6('avg(s)')} AS pooled, {r6('median(s)')} AS median, count(*) AS n FROM per_row",
    "ice_envelope_features": all_features(OF, "full", 120)
    + f"SELECT feature, partner, {r6('abs_r')} AS abs_r, {r6('s')} AS impossible FROM tab",
    "envelope_clusters": all_features(ORD, "full", 120)
    + f"""SELECT count(*) FILTER (s < 0.5e0) AS below_half, count(*) FILTER (s >= 0.5e0) AS above_half,
      {r6('median(s)')} AS median FROM tab""",
    "nn_real": _ORDNN + f"SELECT row_id, {r6('d')} AS d, id AS nearest FROM nn",
    "nn_vectors": _near(_VEC, _DIMS) + f"SELECT row_id, {r6('d')} AS d, id AS nearest FROM nn",
    "nn_cutoffs": _ORDNN
    + f"""SELECT {r6('quantile_cont(d, 0.5)')} AS p50, {r6('quantile_cont(d, 0.75)')} AS p75,
      {r6('quantile_cont(d, 0.95)')} AS p95 FROM nn""",
    "nn_probe_naive": sweep_nn(exclude=False)
    + f"""SELECT row_id, {r6('max(d)')} AS max_d, {r6('avg((d > p95)::INTEGER)')} AS rejects
      FROM pd, cut GROUP BY row_id""",
    "nn_self_match": sweep_nn(exclude=False)
    + f"""SELECT row_id, {r6('avg((id = row_id)::INTEGER)')} AS self_share, {r6('max(d)')} AS max_d,
      {r6('max(moved)')} AS span FROM pd GROUP BY row_id""",
    "nn_probe_loo": sweep_nn()
    + f"""SELECT row_id, {r6('min(d)')} AS min_d, {r6('max(d)')} AS max_d,
      {r6('avg((d > p50)::INTEGER)')} AS rejects_p50, {r6('avg((d > p75)::INTEGER)')} AS rejects_p75,
      {r6('avg((d > p95)::INTEGER)')} AS rejects_p95 FROM pd, cut GROUP BY row_id""",
    "nn_probe_curve": sweep_nn()
    + f"SELECT row_id, grid_idx, {r6('d / p95')} AS relative FROM pd, cut",
    "nn_mahalanobis": sweep_nn("m")
    + f"""SELECT row_id, {r6('max(d)')} AS max_d, {r6('avg((d > p95)::INTEGER)')} AS rejects
      FROM pd, cut GROUP BY row_id""",
    "verdict_agreement": sweep_nn("m")
    + f"""SELECT count(*) AS n, {r6('avg((d > p95)::INTEGER)')} AS distance_rejects,
      {r6('avg(bad::INTEGER)')} AS envelope_rejects, {r6('avg(((d > p95) = bad)::INTEGER)')} AS agree,
      count(*) FILTER (d > p95 AND NOT bad) AS only_distance, count(*) FILTER (d <= p95 AND bad) AS only_envelope
      FROM pd, cut""",
    "pairwise_median": with_(
        DOCS, stats(DOC),
        "z AS (SELECT row_id, " + ", ".join(f"({f} - {f}_mean) / {f}_std AS z{i}" for i, f in enumerate(DOC)) + " FROM feat, st)",
        """p AS (SELECT sqrt((a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2)) AS d
          FROM z a JOIN z b ON a.row_id < b.row_id)""",
    )
    + f"SELECT {r6('median(d)')} AS median, {r6('sqrt(6e0)')} AS sqrt_2p, count(*) AS pairs FROM p",
}
