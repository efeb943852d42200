"""SQL twins of the text queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

#: The 256 values of CRC-32, from its polynomial.
CRC_TABLE = """
crc_steps AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (SELECT i, c FROM crc_steps WHERE k = 8)
"""


def crc_of(name: str, source: str) -> str:
    """CTE ``name`` (word, crc): the unsigned CRC-32 of each distinct non-null ``word`` of ``source``."""
    return f"""
{name}_bytes AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM {source} WHERE word IS NOT NULL),
{name}_walk AS (
  SELECT word, h, 0 AS k, 4294967295::BIGINT AS c FROM {name}_bytes
  UNION ALL
  SELECT w.word, w.h, k + 1, xor(t.c, w.c >> 8)
  FROM {name}_walk w JOIN crc_table t
    ON t.i = xor(w.c & 255, ('0x' || substr(w.h, 2 * k + 1, 2))::BIGINT)
  WHERE 2 * k < length(h)
), {name} AS (SELECT word, xor(c, 4294967295) AS crc FROM {name}_walk WHERE 2 * k = length(h))
"""


def _field(expression: str) -> str:
    return f"coalesce(octet_length(encode({expression}::VARCHAR)) || ':' || {expression}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Level by level: groups' trees (kind 0), then the tree over their roots (kind 1).
MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
{crc_of("crcs", "(SELECT doc_id::VARCHAR AS word FROM documents)")},
hashed AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    {_leaf("(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)")} AS changed
  FROM documents LEFT JOIN crcs ON word = doc_id::VARCHAR
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1
), over_tree AS (
  SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM over_tree WHERE n > 1 GROUP BY level, pos // 2, n
), walk AS (
  SELECT p.doc_id, p.lang, p.pos AS place, 0 AS level, p.pos, p.n, '' AS proof, changed AS fold FROM placed p
  UNION ALL
  SELECT w.doc_id, w.lang, place, w.level + 1, w.pos // 2, (w.n + 1) // 2, proof || coalesce(t.digest, ''),
    sha256(CASE WHEN w.pos % 2 = 0 THEN fold || coalesce(t.digest, '') ELSE t.digest || fold END)
  FROM walk w LEFT JOIN tree t
    ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos = xor(w.pos, 1)
  WHERE w.n > 1
), over_walk AS (
  SELECT w.doc_id, w.lang, place, 0 AS level, s.pos, s.n, proof, fold, s.digest AS subroot
  FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.lang, place, w.level + 1, w.pos // 2, (w.n + 1) // 2, proof || coalesce(t.digest, ''),
    sha256(CASE WHEN w.pos % 2 = 0 THEN fold || coalesce(t.digest, '') ELSE t.digest || fold END), subroot
  FROM over_walk w LEFT JOIN over_tree t ON t.level = w.level AND t.pos = xor(w.pos, 1)
  WHERE w.n > 1
)
SELECT p.doc_id, p.leaf, w.subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root,
  w.fold = r.digest AS verified
FROM placed p
JOIN over_walk w ON w.lang IS NOT DISTINCT FROM p.lang AND w.place = p.pos AND w.n = 1
CROSS JOIN (SELECT digest FROM over_tree WHERE n = 1) r
"""

_SPLIT = r"[\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"


def _grams(table: str, key: str) -> str:
    """CTEs of a table's words in order (id, i, w) and of its features, a row each (id, word)."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
{table}_lists AS (
  SELECT {key} AS id, list_filter(regexp_split_to_array({lower}, '{_SPLIT}'), lambda w: w <> '') AS w FROM {table}
), {table}_words AS (SELECT id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM {table}_lists),
{table}_runs AS (
  SELECT id, w, w || ' ' || lead(w) OVER turn AS w2, w || ' ' || lead(w) OVER turn || ' ' || lead(w, 2) OVER turn AS w3
  FROM {table}_words WINDOW turn AS (PARTITION BY id ORDER BY i)
), {table}_each AS (
  SELECT id, w AS word FROM {table}_runs
  UNION ALL SELECT id, w2 FROM {table}_runs WHERE w2 IS NOT NULL
  UNION ALL SELECT id, w3 FROM {table}_runs WHERE w3 IS NOT NULL
)
"""


RESAMPLING = f"""
WITH RECURSIVE {CRC_TABLE},
numbered AS (SELECT *, row_number() OVER () AS own FROM documents),
{_grams("numbered", "own")}, {_grams("benchmark", "item_id")},
{crc_of("crcs", "(SELECT word FROM numbered_each UNION SELECT word FROM benchmark_each)")},
corpus AS (SELECT crc % 10000 AS bucket, count(*) AS s FROM numbered_each JOIN crcs USING (word) GROUP BY 1),
aim AS (SELECT crc % 10000 AS bucket, count(*) AS t FROM benchmark_each JOIN crcs USING (word) GROUP BY 1),
totals AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE + 10000 AS s_all,
    (SELECT coalesce(sum(t), 0) FROM aim)::DOUBLE + 10000 AS t_all
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * s_all / ((s::DOUBLE + 1) * t_all)))::BIGINT AS gain
  FROM corpus LEFT JOIN aim USING (bucket), totals
), weights AS (
  SELECT id, sum(gain)::BIGINT AS weight, count(*) AS n
  FROM numbered_each JOIN crcs USING (word) JOIN gain ON bucket = crc % 10000 GROUP BY id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM numbered JOIN numbered_lists ON id = own LEFT JOIN weights USING (id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END::DOUBLE AS rank
FROM ranked
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS key, md5(coalesce(text, '')) AS body
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k FROM sources
), filled AS (
  SELECT k, 2 * source_size / weight AS reach,
    (150 * (SELECT sum(size) FROM sized) / 100
      - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM ranked
), aims AS (
  SELECT source, source_size,
    CASE WHEN 2 * source_size / weight <= unit THEN (2 * source_size)::DOUBLE ELSE unit * weight END AS target
  FROM ranked, (SELECT coalesce(arg_min(unit, k) FILTER (WHERE reach > unit), 0) AS unit FROM filled)
), lines AS (
  SELECT s.*, source_size, target, floor(target + 0.5)::BIGINT AS upto,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size, body
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN aims a ON a.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(before + size, upto) - before)
    + greatest(0, least(before + source_size + size, upto) - before - source_size))::BIGINT AS taken
FROM lines
"""
