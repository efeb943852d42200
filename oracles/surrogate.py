from __future__ import annotations

from oracles.basics import _band
from oracles.common import DOCS, ORD, ORDERS, normal, p_of, r6, stats, with_
from probewise.plans.scorers import DOC_STAIRS, ORDER_LOGIT, ORDER_STAIRS

OF, DF = ORDER_STAIRS.features, DOC_STAIRS.features
NU2 = 0.75 * 0.75 * 3
SYM = {(1, 1): "11", (1, 2): "12", (1, 3): "13", (2, 2): "22", (2, 3): "23", (3, 3): "33"}


def draws(features, scorer, seeds=(42,), first=0, n=5000):
    z = ", ".join(f"{normal('seed', 'draw_id', repr(f))} AS z{i}" for i, f in enumerate(features, 1))
    raw = {f: f"({f}_mean + {f}_std * z{i})" for i, f in enumerate(features, 1)}
    values = ", ".join(f"({s})" for s in seeds)
    return f"""d0 AS MATERIALIZED (SELECT seed, draw_id, {z} FROM (SELECT seed, range AS draw_id
        FROM range({n}), (VALUES {values}) s(seed)) WHERE draw_id >= {first}),
      draws AS MATERIALIZED (SELECT d0.*, {', '.join(f'{v} AS r_{f}' for f, v in raw.items())},
        {scorer.sql({f: v for f, v in raw.items() if f in scorer.features})} AS y FROM d0, st)"""


def zrows(features, scorer, src="feat"):
    x = ", ".join(f"({f} - {f}_mean) / {f}_std AS x{i}" for i, f in enumerate(features, 1))
    return f"zr AS MATERIALIZED (SELECT {src}.*, {x}, {scorer.sql()} AS p FROM {src}, st)"


def base(orders):
    scorer = ORDER_STAIRS if orders else DOC_STAIRS
    return scorer, (ORDERS if orders else DOCS), stats(scorer.features), zrows(scorer.features, scorer)


_D2 = "((x1 - z1) * (x1 - z1) + (x2 - z2) * (x2 - z2) + (x3 - z3) * (x3 - z3))"
_W = f"exp(-{_D2} / (2e0 * {NU2!r}e0))"
_TERMS = {"sw": "1e0", "sy": "y", "syy": "y * y"}
_TERMS |= {f"s{i}": f"z{i}" for i in (1, 2, 3)} | {f"sy{i}": f"z{i} * y" for i in (1, 2, 3)}
_TERMS |= {f"s{c}": f"z{i} * z{j}" for (i, j), c in SYM.items()}


def _own(term):
    return term.replace("z1", "x1").replace("z2", "x2").replace("z3", "x3").replace("y", "p")


def fit(orders, variants=("kernel",), self_in=True, seeds=(42,), scorer=None, tables=None, rows="feat"):
    """CTEs up to ``fit``: two-stage ridge of every row by closed forms, three columns, two kept.
    Another ``scorer`` takes its features from the CTEs ``tables`` and explains those of ``rows``."""
    if scorer is None:
        scorer, *given = base(orders)
    else:
        given = [*tables, stats(scorer.features), zrows(scorer.features, scorer, rows)]
    *given, zr = given
    kernel = f"""SELECT row_id, seed, 'kernel' AS variant, {', '.join(f'sum(w * {t}) AS {n}' for n, t in _TERMS.items())}
      FROM (SELECT row_id, seed, z1, z2, z3, y, {_W} AS w FROM zr, draws) GROUP BY row_id, seed"""
    uniform = f"""SELECT zr.row_id, u.* FROM zr, (SELECT seed, 'uniform' AS variant,
      {', '.join(f'sum({t}) AS {n}' for n, t in _TERMS.items())} FROM draws GROUP BY seed) u"""
    parts = {"kernel": kernel, "uniform": uniform}
    add = ", ".join(f"mom.{n} + {_own(t) if self_in else '0e0'} AS {n}" for n, t in _TERMS.items())
    c = ", ".join(f"s{k} - s{i} * s{j} / sw AS c{k}" for (i, j), k in SYM.items())
    b = ", ".join(f"sy{i} - s{i} * sy / sw AS b{i}" for i in (1, 2, 3))
    a = {k: (f"(c{k} + 0.01e0)" if k[0] == k[1] else f"c{k}") for k in SYM.values()}
    m1 = f"({a['22']} * {a['33']} - c23 * c23)"
    m2 = f"(c12 * {a['33']} - c23 * c13)"
    m3 = f"(c12 * c23 - {a['22']} * c13)"
    det = f"({a['11']} * {m1} - c12 * {m2} + c13 * {m3})"
    x1 = f"(b1 * {m1} - c12 * (b2 * {a['33']} - c23 * b3) + c13 * (b2 * c23 - {a['22']} * b3)) / {det}"
    x2 = f"({a['11']} * (b2 * {a['33']} - c23 * b3) - b1 * {m2} + c13 * (c12 * b3 - b2 * c13)) / {det}"
    x3 = f"({a['11']} * ({a['22']} * b3 - b2 * c23) - c12 * (c12 * b3 - b2 * c13) + b1 * {m3}) / {det}"
    pick = lambda one, two, three: f"CASE dropped WHEN 1 THEN {one} WHEN 2 THEN {two} ELSE {three} END"
    return (
        *given, draws(scorer.features, scorer, seeds, 1 if self_in else 0), zr,
        f"mom AS ({' UNION ALL BY NAME '.join(parts[v] for v in variants)})",
        f"tot AS MATERIALIZED (SELECT zr.*, seed, variant, {add} FROM mom JOIN zr ON mom.row_id = zr.row_id)",
        f"cen AS MATERIALIZED (SELECT *, {c}, {b}, syy - sy * sy / sw AS sst FROM tot)",
        f"aux AS MATERIALIZED (SELECT *, {x1} AS a1, {x2} AS a2, {x3} AS a3 FROM cen)",
        """sel AS MATERIALIZED (SELECT *, CASE WHEN abs(a3 * x3) <= abs(a1 * x1) AND abs(a3 * x3) <= abs(a2 * x2) THEN 3
          WHEN abs(a2 * x2) <= abs(a1 * x1) THEN 2 ELSE 1 END AS dropped FROM aux)""",
        f"""sub AS MATERIALIZED (SELECT *, {pick('c22', 'c11', 'c11')} + 1e0 AS aii, {pick('c33', 'c33', 'c22')} + 1e0 AS ajj,
          {pick('c23', 'c13', 'c12')} AS aij, {pick('b2', 'b1', 'b1')} AS bi, {pick('b3', 'b3', 'b2')} AS bj FROM sel)""",
        """two AS MATERIALIZED (SELECT *, (bi * ajj - aij * bj) / (aii * ajj - aij * aij) AS ci,
          (aii * bj - aij * bi) / (aii * ajj - aij * aij) AS cj FROM sub)""",
        f"""co AS MATERIALIZED (SELECT *, {pick('0e0', 'ci', 'ci')} AS k1, {pick('ci', '0e0', 'cj')} AS k2,
          {pick('cj', 'cj', '0e0')} AS k3 FROM two)""",
        """fit0 AS MATERIALIZED (SELECT *, (sy - k1 * s1 - k2 * s2 - k3 * s3) / sw AS intercept, sst - 2 * (k1 * b1 + k2 * b2 + k3 * b3)
          + k1 * k1 * c11 + k2 * k2 * c22 + k3 * k3 * c33 + 2 * (k1 * k2 * c12 + k1 * k3 * c13 + k2 * k3 * c23) AS sse FROM co)""",
        "fit AS MATERIALIZED (SELECT *, intercept + k1 * x1 + k2 * x2 + k3 * x3 AS g, 1 - sse / sst AS r2 FROM fit0)",
    )


def gradient(scorer, f, h):
    up, down = (scorer.sql({f: f"({f} {s} {h}e0 * {f}_std)"}) for s in "+-")
    return f"(({up}) - ({down})) / (2e0 * {h}e0)"


def lead(a, b, c):
    return f"CASE WHEN abs({a}) >= abs({b}) AND abs({a}) >= abs({c}) THEN 1 WHEN abs({b}) >= abs({c}) THEN 2 ELSE 3 END"


def cos(a, b):
    dot = lambda u, v: "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v)) + ")"
    return f"{dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0)"


def kernel(self_in):
    scorer, feat, st, zr = base(False)
    own = " UNION ALL SELECT row_id, p, x1, x2, x3, 0e0, 1e0, p FROM zr" if self_in else ""
    return with_(
        feat, st, draws(scorer.features, scorer, first=1 if self_in else 0), zr,
        f"pw AS (SELECT row_id, p, x1, x2, x3, sqrt({_D2}) AS d, {_W} AS w, y AS f FROM zr, draws{own})",
        """ks0 AS (SELECT row_id, any_value(p) AS p, any_value(sqrt(x1 * x1 + x2 * x2 + x3 * x3)) AS centroid,
          median(d) AS md, median(w) AS mw, avg(w) AS aw, max(w) AS xw, min(w) AS nw, max(d) AS xd, min(d) AS nd,
          sum(w) * sum(w) / sum(w * w) AS ess, sum(w * f) / sum(w) AS m FROM pw GROUP BY row_id)""",
        """ks AS (SELECT ks0.*, v.wvar FROM ks0 JOIN (SELECT pw.row_id, sum(w * (f - m) * (f - m)) / sum(w) AS wvar
          FROM pw JOIN ks0 ON pw.row_id = ks0.row_id GROUP BY pw.row_id) v ON v.row_id = ks0.row_id)""",
    )


_K = ["k1", "k2", "k3"]
_NAME = lambda i, fs: f"CASE {i} WHEN 1 THEN '{fs[0]}' WHEN 2 THEN '{fs[1]}' ELSE '{fs[2]}' END"
_OFIT = with_(*fit(True))
_DFIT = with_(*fit(False))


def more(text, cte):
    return text.rstrip() + ",\n" + cte + "\n"


def grads(scorer, hs):
    parts = [
        f"SELECT row_id, {h}e0 AS h, {', '.join(f'{gradient(scorer, f, h)} AS g{i}' for i, f in enumerate(scorer.features, 1))} FROM feat, st"
        for h in hs
    ]
    return "gr AS (" + " UNION ALL ".join(parts) + ")"


def _spearman(src, x, y, key):
    return f"""rk AS (SELECT {key}, rank() OVER (PARTITION BY {key} ORDER BY {x}) + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2e0 AS rx,
        rank() OVER (PARTITION BY {key} ORDER BY {y}) + (count(*) OVER (PARTITION BY {key}, {y}) - 1) / 2e0 AS ry FROM {src}),
      rho AS (SELECT {key}, corr(rx, ry) AS rho FROM rk GROUP BY {key})"""


_ALLC = with_(ORDERS, stats(ORD), draws(ORD, ORDER_STAIRS))
_REFS = "refs AS (" + " UNION ALL ".join(
    [f"SELECT 'class_' || label AS reference, {', '.join(f'avg({f}) AS ref_{f}' for f in DF)} FROM feat WHERE NOT is_test AND label IS NOT NULL GROUP BY label"]
    + [f"SELECT '{n}', {', '.join(f'{fn}({f})' for f in DF)} FROM feat WHERE NOT is_test" for n, fn in (("mean", "avg"), ("median", "median"))]
) + ")"
_SEEDS = tuple(range(42, 50))

SQL = {
    "cloud": with_(ORDERS, stats(OF), draws(OF, ORDER_STAIRS))
    + f"""SELECT draw_id, {', '.join(f"{r6(f'z{i}')} AS z_{f}, {r6(f'r_{f}', 3)} AS {f}" for i, f in enumerate(OF, 1))},
      {r6('y')} AS p FROM draws""",
    "cloud_audit": with_(ORDERS, stats(OF), draws(OF, ORDER_STAIRS), zrows(OF, ORDER_STAIRS))
    + f"""SELECT {r6('any_value(md)')} AS mean_dev, {r6('any_value(sd)')} AS std_dev,
      {r6('avg(sqrt(x1 * x1 + x2 * x2 + x3 * x3))')} AS mean_distance, {r6('max(sqrt(x1 * x1 + x2 * x2 + x3 * x3))')} AS max_distance
      FROM zr, (SELECT greatest(abs(avg(z1)), abs(avg(z2)), abs(avg(z3))) AS md,
        greatest(abs(stddev_pop(z1) - 1), abs(stddev_pop(z2) - 1), abs(stddev_pop(z3) - 1)) AS sd FROM draws)""",
    "cloud_negative": _ALLC
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER (v < 0) AS n_negative, {r6('avg((v < 0)::INTEGER)')} AS negative FROM (SELECT {e} AS v FROM draws)"
        for f, e in [(f, f"r_{f}") for f in ORD] + [("any", "least(" + ", ".join(f"r_{f}" for f in ORD) + ")")]
    ),
    "cloud_ratio": _ALLC
    + f"""SELECT {r6('any_value(lo)', 9)} AS real_min, {r6('any_value(hi)', 9)} AS real_max,
      {r6('quantile_cont(r_qty / r_list_value, 0.01)', 9)} AS cloud_p1, {r6('quantile_cont(r_qty / r_list_value, 0.99)', 9)} AS cloud_p99
      FROM draws, (SELECT min(qty / list_value) AS lo, max(qty / list_value) AS hi FROM feat)""",
    "saturation": with_(
        ORDERS, stats(OF), draws(OF, ORDER_LOGIT),
        f"u AS (SELECT 'cloud' AS w, y AS p FROM draws UNION ALL SELECT 'held_out', {ORDER_LOGIT.sql()} FROM feat WHERE is_test)",
    )
    + f"""SELECT w AS "where", count(*) AS n, count(*) FILTER (p < 0.05e0 OR p > 0.95e0) AS saturated,
      {r6('avg((p < 0.05e0 OR p > 0.95e0)::INTEGER)')} AS share, {r6('min(p)')} AS min_p, {r6('max(p)')} AS max_p FROM u GROUP BY w""",
    "kernel_weights": kernel(True)
    + f"SELECT row_id, {r6('aw')} AS mean_w, {r6('xw')} AS max_w, {r6('nw')} AS min_w FROM ks",
    "kernel_ess": kernel(True)
    + f"SELECT row_id, {r6('md')} AS median_d, {r6('mw')} AS median_w, {r6('ess', 4)} AS ess FROM ks",
    "kernel_radius": with_(
        ORDERS, stats(OF), zrows(OF, ORDER_STAIRS),
        "cs AS (SELECT x1 AS z1, x2 AS z2, x3 AS z3 FROM zr ORDER BY abs(p - 0.5e0), row_id LIMIT 1)",
        f"ww AS (SELECT {_W} AS w, contour, sqrt({NU2!r}e0) * sqrt(-2e0 * ln(contour)) AS radius FROM zr, cs, (VALUES (0.95e0), (0.9e0), (0.75e0), (0.5e0)) v(contour))",
    )
    + f"""SELECT contour, count(*) FILTER (w > contour) AS n_above, {r6('avg((w > contour)::INTEGER)')} AS share,
      {r6('any_value(radius)')} AS radius, any_value(radius) < 1.5e0 AS fits FROM ww GROUP BY contour""",
    "highest_weights": _OFIT
    + f"""SELECT row_id, {', '.join(f'{r6(f"a{i}")} AS aux_{f}' for i, f in enumerate(OF, 1))},
      CASE dropped WHEN 1 THEN '{OF[1]},{OF[2]}' WHEN 2 THEN '{OF[0]},{OF[2]}' ELSE '{OF[0]},{OF[1]}' END AS kept FROM fit""",
    "surrogate_fit": _OFIT
    + f"""SELECT row_id, {', '.join(f'{r6(f"k{i}")} AS coef_{f}' for i, f in enumerate(OF, 1))},
      {r6('intercept')} AS intercept, {r6('g')} AS g FROM fit""",
    "surrogate_r2": _OFIT + f"SELECT row_id, {r6('r2')} AS r2 FROM fit",
    "explain_row": more(_OFIT, "cs AS (SELECT * FROM fit ORDER BY abs(p - 0.5e0), row_id LIMIT 1)")
    + " UNION ALL ".join(
        f"SELECT row_id, '{f}' AS feature, {r6(f'k{i}')} AS coef, {r6('p')} AS p, {r6('g')} AS g FROM cs WHERE dropped <> {i}"
        for i, f in enumerate(OF, 1)
    ),
    "level_gap": _OFIT
    + f"""SELECT count(*) AS n, {r6('median(abs(g - p))')} AS median, {r6('avg(abs(g - p))')} AS mean, {r6('max(abs(g - p))')} AS max,
      {r6('avg((abs(g - p) > 0.1e0)::INTEGER)')} AS above_010, {r6('avg(((g >= 0.5e0) = (p >= 0.5e0))::INTEGER)')} AS same_side FROM fit""",
    "explain_stability": more(
        with_(*fit(False, seeds=_SEEDS)),
        "an AS (SELECT f.*, degrees(atan2(f.k2, f.k1)) AS angle, o.dropped AS d0 FROM fit f JOIN fit o ON f.row_id = o.row_id AND o.seed = 42)",
    )
    + f"""SELECT row_id, {r6('avg(g)')} AS g_mean, {r6('stddev_pop(g)')} AS g_std,
      count(*) FILTER ((g >= 0.5e0) = (p >= 0.5e0)) AS correct_side, {r6('avg(angle)', 4)} AS angle_mean,
      {r6('stddev_pop(angle)', 4)} AS angle_std,
      {r6('sum(CASE WHEN dropped = d0 THEN 2 ELSE 1 END) FILTER (seed <> 42)::DOUBLE / 7')} AS shared FROM an GROUP BY row_id""",
    "fd_gradient": with_(ORDERS, stats(OF))
    + f"SELECT row_id, {', '.join(f'{r6(gradient(ORDER_STAIRS, f, 0.3))} AS grad_{f}' for f in OF)} FROM feat, st",
    "direction": more(_DFIT, grads(DOC_STAIRS, [0.3]))
    + f"""SELECT fit.row_id, {r6('degrees(atan2(k2, k1))', 4)} AS angle_fit, {r6('degrees(atan2(g2, g1))', 4)} AS angle_model,
      {r6(cos(['k1', 'k2'], ['g1', 'g2']))} AS cosine_plane, {r6(cos(_K, ['g1', 'g2', 'g3']))} AS cosine_full
      FROM fit JOIN gr ON fit.row_id = gr.row_id""",
    "direction_agreement": more(
        more(_OFIT, grads(ORDER_STAIRS, [0.1, 0.3, 1.0])),
        f"""j AS (SELECT h, g1 <> 0 OR g2 <> 0 OR g3 <> 0 AS anymove, {lead(*_K)} AS lk, {lead('g1', 'g2', 'g3')} AS lg,
          (g1 <> 0)::INTEGER + (g2 <> 0)::INTEGER + (g3 <> 0)::INTEGER AS moving, {cos(_K, ['g1', 'g2', 'g3'])} AS c,
          k1, k2, k3, g1, g2, g3 FROM fit JOIN gr ON fit.row_id = gr.row_id),
        q AS (SELECT *, CASE lk WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g3 END AS gl,
          CASE lk WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END AS kl FROM j)""",
    )
    + f"""SELECT h, count(*) FILTER (anymove) AS n, {r6('avg((lk = lg)::INTEGER) FILTER (anymove)')} AS top1,
      count(*) FILTER (anymove AND gl <> 0) AS n_sign, {r6('avg((sign(kl) = sign(gl))::INTEGER) FILTER (anymove AND gl <> 0)')} AS sign,
      count(*) FILTER (NOT anymove OR gl = 0) AS no_move, {r6('median(c) FILTER (anymove)')} AS median_cos,
      {r6('avg(moving) FILTER (anymove)')} AS mean_moving FROM q GROUP BY h""",
    "coef_vs_slope": more(_DFIT, grads(DOC_STAIRS, [1.0]))
    + " UNION ALL ".join(
        f"""SELECT fit.row_id, '{f}' AS feature, {r6(f'k{i}')} AS coef, {r6(f'g{i}')} AS slope,
        CASE WHEN g{i} = 0 THEN 'no move' WHEN sign(k{i}) = sign(g{i}) THEN 'same' ELSE 'other' END AS verdict
        FROM fit JOIN gr ON fit.row_id = gr.row_id WHERE dropped <> {i}"""
        for i, f in enumerate(DF, 1)
    ),
    "kernel_deletion": more(
        with_(*fit(True, ("kernel", "uniform"), False)),
        """a AS (SELECT * FROM fit WHERE variant = 'kernel'), b AS (SELECT row_id, g AS ug, dropped AS ud, k1 AS u1, k2 AS u2, k3 AS u3
          FROM fit WHERE variant = 'uniform')""",
    )
    + f"""SELECT a.row_id, {r6('g')} AS g_kernel, {r6('ug')} AS g_uniform, {r6('abs(g - ug)')} AS shift,
      CASE WHEN dropped = ud THEN 2 ELSE 1 END AS shared, {r6(cos(_K, ['u1', 'u2', 'u3']))} AS cosine
      FROM a JOIN b ON a.row_id = b.row_id""",
    "topk_overlap": more(
        with_(*fit(True, ("kernel", "uniform"), False)),
        "b AS (SELECT row_id, dropped AS ud FROM fit WHERE variant = 'uniform')",
    )
    + """SELECT CASE WHEN dropped = ud THEN 2 ELSE 1 END AS shared, count(*) AS n
      FROM fit JOIN b ON fit.row_id = b.row_id WHERE variant = 'kernel' GROUP BY 1""",
    "effects": _DFIT
    + f"""SELECT row_id, {', '.join(f'{r6(f"k{i} * x{i}")} AS effect_{f}' for i, f in enumerate(DF, 1))},
      {r6('intercept + k1 * x1 + k2 * x2 + k3 * x3')} AS total,
      {' + '.join(f'(k{i} * x{i} < 0)::INTEGER' for i in (1, 2, 3))} AS negative_effects,
      {' + '.join(f'(k{i} < 0)::INTEGER' for i in (1, 2, 3))} AS negative_coefs FROM fit""",
    "contributions": more(
        more(_DFIT, _REFS),
        "t AS (SELECT fit.row_id, reference, "
        + ", ".join(f"k{i} * (x{i} - (ref_{f} - {f}_mean) / {f}_std) AS t{i}" for i, f in enumerate(DF, 1))
        + " FROM fit, refs, st)",
    )
    + f"""SELECT row_id, reference, {r6('t1 + t2 + t3')} AS contribution,
      {' + '.join(f'(t{i} < -1e-12)::INTEGER' for i in (1, 2, 3))} AS negative_terms FROM t""",
    "fidelity_vs_confidence": more(
        _OFIT,
        "fc AS (SELECT 1 AS one, p, round(r2, 9) AS r2, round(abs(p - 0.5e0), 9) AS conf FROM fit), " + _spearman("fc", "conf", "r2", "one"),
    )
    + f"""SELECT {_band('p', True)} AS band, count(*) AS n, {r6('avg(r2)')} AS mean_r2, {r6('any_value(rho)', 5)} AS rho,
      {r6('any_value(pv)', 9)} AS p FROM fc, (SELECT *, {p_of('rho', '(SELECT count(*) FROM fc WHERE r2 IS NOT NULL)')} AS pv FROM rho) GROUP BY 1""",
    "mechanism_checks": more(
        kernel(False),
        f"""ml AS (SELECT 'wvar' AS measure, p, round(wvar, 6) AS value FROM ks UNION ALL SELECT 'centroid', p, round(centroid, 6) FROM ks
          UNION ALL SELECT 'log_skew', p, round((xd * xd - nd * nd) / (2e0 * {NU2!r}e0), 6) FROM ks),
        mc AS (SELECT *, round(abs(p - 0.5e0), 9) AS conf FROM ml), """ + _spearman("mc", "conf", "value", "measure")
        + f", bb AS (SELECT *, {_band('p')} AS band FROM ml)",
    )
    + f"""SELECT bb.measure, band, count(*) AS n_rows, {r6('avg(value)')} AS mean, {r6('median(value)')} AS median,
      {r6('any_value(rho)', 5)} AS rho FROM bb JOIN rho ON bb.measure = rho.measure WHERE band IS NOT NULL GROUP BY bb.measure, band""",
    "spanning_sample": with_(
        ORDERS,
        f"""s AS (SELECT row_id, round(abs({ORDER_LOGIT.sql()} - 0.5e0), 9) AS conf FROM feat),
        k AS (SELECT *, row_number() OVER (ORDER BY conf, row_id) - 1 AS rank, count(*) OVER () AS n FROM s)""",
    )
    + f"""SELECT row_id, {r6('conf')} AS conf, rank FROM k
      WHERE rank IN (SELECT floor(i.range * (c.n - 1) / 54e0)::BIGINT FROM range(55) i, (SELECT count(*) AS n FROM s) c)""",
    "extrapolation": more(
        _DFIT, f"l AS (SELECT *, {lead(*_K)} AS lk FROM fit)",
    ).rstrip()
    + f""", m AS (SELECT l.*, st.*, delta, {_NAME('lk', DF)} AS feature, g + delta * CASE lk WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END AS lin
        FROM l, st, (VALUES (0), (1), (2), (4), (8)) d(delta))
      SELECT row_id, delta, feature, {r6(DOC_STAIRS.sql({f: f"(CASE WHEN lk = {i} THEN {f} + delta * {f}_std ELSE {f} END)" for i, f in enumerate(DF, 1)}))} AS model,
        {r6('lin')} AS linear, lin < 0 OR lin > 1 AS outside FROM m""",
    "decorrelated_pair": more(
        _OFIT,
        f"""cr AS (SELECT abs(corr({OF[0]}, {OF[1]})) AS r12, abs(corr({OF[0]}, {OF[2]})) AS r13, abs(corr({OF[1]}, {OF[2]})) AS r23 FROM feat WHERE NOT is_test),
        l AS (SELECT *, {lead(*_K)} AS lk FROM fit),
        l2 AS (SELECT *, 6 - dropped - lk AS other FROM l),
        l3 AS (SELECT *, CASE WHEN (CASE lk + other WHEN 3 THEN r12 WHEN 4 THEN r13 ELSE r23 END) < 0.6e0 THEN {_NAME('other', OF)} END AS second FROM l2, cr)""",
    )
    + f"""SELECT row_id, {_NAME('lk', OF)} AS first, second,
      CAST(p >= 0.5e0 AS INTEGER) = label AND abs(p - 0.5e0) < 0.15e0 AND second IS NOT NULL AS candidate FROM l3""",
}
