from __future__ import annotations

from oracles.common import DOC, DOCS, ORD, ORDERS, normal, p_of, r6, stats, with_
from probewise.plans.scorers import DOC_LOGIT, ORDER_LOGIT, ORDER_STAIRS


def _melt(features, keep=""):
    return " UNION ALL ".join(
        f"SELECT {keep}'{f}' AS feature, {f} AS value FROM feat" for f in features
    )


def _band(p, half_open=False):
    conf = f"abs({p} - 0.5e0)"
    if half_open:
        return (
            f"CASE WHEN {conf} < 0.15e0 THEN 'borderline' WHEN {conf} < 0.3e0 THEN 'intermediate'"
            " ELSE 'confident' END"
        )
    return f"CASE WHEN {conf} < 0.15e0 THEN 'borderline' WHEN {conf} > 0.3e0 THEN 'confident' END"


_P = ORDER_STAIRS.sql()
_STRENGTHS = "(VALUES (0e0), (0.25e0), (0.5e0), (0.75e0), (1e0)) s(strength)"

SQL = {
    "feature_table": with_(ORDERS)
    + f"SELECT row_id, {', '.join(ORD)}, label, is_test FROM feat",
    "doc_feature_table": with_(DOCS)
    + f"SELECT row_id, {', '.join(DOC)}, label::DOUBLE AS label, is_test FROM feat",
    "vec_feature_table": f"""
      SELECT vec_id AS row_id, CAST(label < 5 AS INTEGER) AS label,
        {r6('embedding[1]::DOUBLE')} AS x_first,
        {r6('sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)))', 5)} AS norm
      FROM embeddings""",
    "binary_filter": """
      SELECT o_orderkey AS row_id, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS INTEGER)
        AS target FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "row_lookup": with_(ORDERS, f"s AS (SELECT *, {_P} AS p FROM feat)")
    + f"""SELECT row_id, qty, gross, {r6('p')} AS p FROM s
      ORDER BY abs(s.p - 0.5e0), row_id LIMIT 1""",
    "zscore": with_(ORDERS, stats(ORD))
    + f"""SELECT row_id, {', '.join(f"{r6(f'({f} - {f}_mean) / {f}_std')} AS z_{f}" for f in ORD)}
      FROM feat, st""",
    "zscore_guard": with_(DOCS, stats(["n_words"]))
    + f"""SELECT row_id, {r6('(n_words - n_words_mean) / n_words_std')} AS z_n_words,
      0e0 AS z_constant FROM feat, st""",
    "column_stats": with_(ORDERS)
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {r6(f'avg({f}) FILTER (NOT is_test)', 4)} AS mean,
        {r6(f'stddev_pop({f}) FILTER (NOT is_test)', 4)} AS std, {r6(f'min({f})', 4)} AS min,
        {r6(f'max({f})', 4)} AS max FROM feat"""
        for f in ORD
    ),
    "percentiles": with_(ORDERS, f"l AS ({_melt(ORD)})")
    + "SELECT feature, "
    + ", ".join(
        f"{r6(f'quantile_cont(value, {q})')} AS p{round(q * 100)}"
        for q in (0.01, 0.05, 0.5, 0.75, 0.95, 0.99)
    )
    + " FROM l GROUP BY feature",
    "group_medians": with_(ORDERS, f"l AS ({_melt(ORD, 'label, ')})")
    + f"""SELECT label, feature, count(*) AS n_rows, {r6('median(value)')} AS median
      FROM l GROUP BY label, feature""",
    "reference_rows": with_(DOCS, f"l AS ({_melt(DOC, 'label, is_test, ')})")
    + f"""SELECT 'class_' || label AS reference, feature, {r6('avg(value)')} AS value
        FROM l WHERE NOT is_test AND label IS NOT NULL GROUP BY label, feature
      UNION ALL SELECT 'mean', feature, {r6('avg(value)')} FROM l WHERE NOT is_test GROUP BY feature
      UNION ALL SELECT 'median', feature, {r6('median(value)')} FROM l WHERE NOT is_test
        GROUP BY feature""",
    "corr_pairs": with_(ORDERS)
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS r FROM feat WHERE NOT is_test"
        for i, a in enumerate(ORD)
        for b in ORD[i + 1 :]
    ),
    "covariance_pairs": with_(ORDERS, stats(["qty", "gross", "net"]))
    + " UNION ALL ".join(
        f"""SELECT 'z_{a}' AS a, 'z_{b}' AS b, {r6(
            f'covar_samp(({a} - {a}_mean) / {a}_std, ({b} - {b}_mean) / {b}_std)')} AS cov
        FROM feat, st"""
        for i, a in enumerate(["qty", "gross", "net"])
        for b in ["qty", "gross", "net"][i:]
    ),
    "spearman_pairs": with_(
        ORDERS,
        """l AS (SELECT 'qty~gross' AS pair, qty AS x, gross AS y FROM feat
          UNION ALL SELECT 'qty~avg_disc', qty, avg_disc FROM feat)""",
        """k AS (SELECT pair,
          rank() OVER (PARTITION BY pair ORDER BY x)
            + (count(*) OVER (PARTITION BY pair, x) - 1) / 2e0 AS rx,
          rank() OVER (PARTITION BY pair ORDER BY y)
            + (count(*) OVER (PARTITION BY pair, y) - 1) / 2e0 AS ry FROM l)""",
        "c AS (SELECT pair, corr(rx, ry) AS rho, count(*) AS n FROM k GROUP BY pair)",
    )
    + f"""SELECT pair, {r6('rho')} AS rho, n,
      {r6('rho * sqrt((n - 2) / (1 - rho * rho))', 4)} AS t, {r6(p_of('rho', 'n'), 9)} AS p FROM c""",
    "weighted_var": with_(
        ORDERS,
        f"s AS (SELECT label, qty AS w, {_P} AS p FROM feat)",
        "m AS (SELECT label, sum(w * p) / sum(w) AS mean FROM s GROUP BY label)",
    )
    + f"""SELECT s.label, {r6('any_value(mean)')} AS weighted_mean,
      {r6('sum(w * (p - mean) * (p - mean)) / sum(w)')} AS weighted_var
      FROM s JOIN m ON s.label = m.label GROUP BY s.label""",
    "confidence_bands": with_(
        ORDERS, f"s AS (SELECT *, {_P} AS p FROM feat)", f"b AS (SELECT *, {_band('p')} AS band FROM s)"
    )
    + f"""SELECT band, count(*) AS n, {r6('avg(p)')} AS mean_p,
      {r6('avg((CAST(p >= 0.5e0 AS INTEGER) = label)::INTEGER)')} AS accuracy
      FROM b WHERE band IS NOT NULL GROUP BY band""",
    "half_open_bands": with_(
        ORDERS,
        f"s AS (SELECT *, {ORDER_LOGIT.sql()} AS p FROM feat)",
        f"b AS (SELECT *, {_band('p', True)} AS band FROM s WHERE label IS NOT NULL)",
    )
    + f"SELECT band, count(*) AS n, {r6('avg(p)')} AS mean_p FROM b GROUP BY band",
    "ratio_floor": with_(DOCS.replace("feat AS", "docs AS", 1), ORDERS)
    + f"""SELECT 'n_chars/n_words' AS pair, {r6('min(n_chars / n_words)')} AS min_ratio,
        count(*) FILTER (n_chars / n_words < 6e0) AS below, count(*) AS n FROM docs
      UNION ALL SELECT 'net/gross', {r6('min(net / gross)')},
        count(*) FILTER (net / gross < 0.93e0), count(*) FROM feat""",
    "stratified_split": with_(ORDERS)
    + """SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id)
      <= ceil(0.25e0 * count(*) OVER (PARTITION BY label)) AS is_test FROM feat""",
    "kfold_assign": with_(ORDERS)
    + """SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label
      ORDER BY md5('42|' || row_id), row_id) - 1) % 10 AS INTEGER) AS fold FROM feat""",
    "interaction_label": with_(ORDERS, stats(["qty", "gross"]))
    + f"""SELECT strength, count(*) AS n, CAST(count(*) FILTER (
        ((qty - qty_mean) / qty_std) * ((1 - strength) + strength * sign((gross - gross_mean) / gross_std))
        + 0.3e0 * {normal("'0'", 'row_id')} > 0) AS BIGINT) AS positives
      FROM feat, st, {_STRENGTHS} GROUP BY strength""",
    "metrics": with_(
        ORDERS,
        f"s AS (SELECT label, {_P} AS p FROM feat)",
        """k AS (SELECT label, p, rank() OVER (ORDER BY p)
          + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r FROM s)""",
    )
    + f"""SELECT count(*) AS n, {r6('avg((CAST(p >= 0.5e0 AS INTEGER) = label)::INTEGER)')} AS accuracy,
      {r6('''(sum(r) FILTER (label = 1) - count(*) FILTER (label = 1)
        * (count(*) FILTER (label = 1) + 1) / 2e0)
        / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))''')} AS auc FROM k""",
    "accuracy_by_band": with_(
        DOCS,
        f"s AS (SELECT *, {DOC_LOGIT.sql()} AS p FROM feat)",
        f"b AS (SELECT *, {_band('p', True)} AS band FROM s WHERE label IS NOT NULL)",
    )
    + f"""SELECT band, count(*) AS n,
      {r6('avg((CAST(p >= 0.5e0 AS INTEGER) = label)::INTEGER)')} AS accuracy FROM b GROUP BY band""",
}
