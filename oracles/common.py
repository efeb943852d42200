"""Shared SQL text of the oracle queries (DuckDB dialect)."""

from __future__ import annotations

ORD = ["qty", "list_value", "gross", "net", "n_lines", "max_qty", "avg_disc"]
DOC = ["n_chars", "n_words", "chars_per_word"]


def uniform(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE + 0.5e0) / 4294967296e0)"


def normal(*parts: str) -> str:
    u, v = uniform(*parts, "'r'"), uniform(*parts, "'a'")
    return f"(sqrt(-2e0 * ln({u})) * cos(6.283185307179586e0 * {v}))"


_TEST = f"{uniform(repr('42'), 'row_id')} < 0.25e0 AS is_test"

ORDERS = f"""
feat AS (
  SELECT a.*, CAST(o_orderstatus = 'F' AS INTEGER) AS label, {_TEST}
  FROM (
    SELECT l_orderkey AS row_id, sum(l_quantity) AS qty,
      round(sum(l_quantity * p_retailprice), 4) AS list_value,
      round(sum(l_extendedprice), 4) AS gross,
      round(sum(l_extendedprice * (1 - l_discount)), 4) AS net,
      count(*)::DOUBLE AS n_lines, max(l_quantity) AS max_qty, round(avg(l_discount), 8) AS avg_disc
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
  ) a JOIN orders ON a.row_id = o_orderkey
)"""

DOCS = f"""
feat AS (
  SELECT a.*, {_TEST}, round(n_chars / n_words, 6) AS chars_per_word
  FROM (
    SELECT d.doc_id AS row_id, d.n_chars::DOUBLE AS n_chars,
      len(string_split(d.text, ' '))::DOUBLE AS n_words, l.quality::INTEGER AS label
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  ) a
)"""


def r6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


def stats(features: list[str], src: str = "feat", name: str = "st") -> str:
    cols = ", ".join(
        f"avg({f}) FILTER (NOT is_test) AS {f}_mean, stddev_pop({f}) FILTER (NOT is_test) AS {f}_std,"
        f" min({f}) AS {f}_min, max({f}) AS {f}_max"
        for f in features
    )
    return f"{name} AS (SELECT {cols} FROM {src})"


def point(i: str, n: int | str, lo: str = "lo", hi: str = "hi") -> str:
    last = n - 1 if isinstance(n, int) else f"({n} - 1)"
    return f"(CASE WHEN {i} = {last} THEN {hi} ELSE {lo} + {i} * (({hi} - {lo}) / {last}) END)"


def grid(n: int, name: str = "grid") -> str:
    return f"{name} AS (SELECT range::INTEGER AS grid_idx FROM range({n}))"


def sweep(features: list[str], kind: str = "span", span: float = 2.5, src: str = "feat") -> str:
    """Rows per (row, feature) with own value x and the bounds of its sweep."""
    parts = []
    for f in features:
        if kind == "span":
            lo = f"greatest({f}_min, {f} - {span}e0 * {f}_std)"
            hi = f"least({f}_max, {f} + {span}e0 * {f}_std)"
        else:
            lo, hi = f"{f}_min", f"{f}_max"
        parts.append(
            f"SELECT {src}.*, '{f}' AS feature, {f} AS x, {f}_mean AS x_mean, {f}_std AS x_std,"
            f" {lo} AS lo, {hi} AS hi FROM {src}, st"
        )
    return "sweep AS (" + " UNION ALL ".join(parts) + ")"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def p_of(r: str, n: str) -> str:
    """Two-sided p-value of Student's t of a correlation: the incomplete beta integral of (n - 2) / 2 and
    1/2 up to 1 - r^2, in the angle, by Simpson's rule."""
    a = f"(({n} - 2) / 2e0)"
    top = f"asin(sqrt(greatest(1 - {r} * {r}, 0)))"
    points = 4000
    # below this stretch the integrand, a power of a sine, is nothing
    span = f"least({top}, 12e0 / sqrt(2 * {a}))"
    weight = f"CASE WHEN range = 0 OR range = {points} THEN 1e0 WHEN range % 2 = 1 THEN 4e0 ELSE 2e0 END"
    log_scale = f"(lgamma({a} + 0.5e0) - lgamma({a}) - lgamma(0.5e0))"
    # scaled inside the exponent: both factors leave the range of doubles on large tables
    value = f"exp({log_scale} + (2 * {a} - 1) * ln(greatest(sin({top} - {span} + {span} * range / {points}e0), 1e-300)))"
    return f"(SELECT 2e0 * {span} / {points}e0 / 3e0 * sum({weight} * {value}) FROM range({points} + 1))"
