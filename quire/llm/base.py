"""The base parts of four operators as queries of their own, with DuckDB SQL for the same rows.

Each takes its columns from its operator's whole result; only the columns that the method decides are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, pii, rules, secrets


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op8_personal_data(spark, sf_dir).drop("spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op9_secret_scan(spark, sf_dir).drop("spans")


def _spans(kind: str, rank: int, regex: str, keep: str) -> str:
    """SELECT of (doc_id, rank, kind, m, g, a, b): the leftmost non-overlapping matches of a text, and where they stand."""
    quoted = regex.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, b FROM (SELECT doc_id, m, g,
  (sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS a, (sum(length(gap)) OVER w + sum(length(m)) OVER w)::BIGINT AS b
  FROM (SELECT doc_id, i, gaps[i] AS gap, ms[i] AS m, gs[i] AS g FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}', 0) AS ms, regexp_extract_all(t, '{quoted}', {2 if kind == 'assign' else 0}) AS gs FROM d)))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {keep}"""


def _digest(kinds: list[tuple[str, str, str]], order: str) -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in kinds)
    listed = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k, _, _ in kinds)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(_spans(k, i, r, keep) for i, (k, r, keep) in enumerate(kinds))}),
c AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {order}) AS l FROM s GROUP BY doc_id)
SELECT doc_id, {listed}, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN c USING (doc_id)"""


_N = "length(regexp_replace(m, '[^0-9]', '', 'g'))"
_LUHN = """list_sum(list_transform(string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT < 5 THEN 2 * c::INT ELSE 2 * c::INT - 9 END)) % 10 = 0"""
_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLES = {
    "rules_base": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g SEMI JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) x USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(p.n, 0) > 20 * len(w) AS base_failed
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "licenses_base": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {len(k.split())}, '{v}')" for k, v in licenses.BASE.items())}) b(phrase, size, label)),
m AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), b WHERE array_to_string(w[i:i + size - 1], ' ') = phrase),
c AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN c USING (doc_id)""",
    "pii_base": _digest([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: x::DOUBLE <= 255))"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"{_N} BETWEEN 13 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{_N} BETWEEN 9 AND 15"),
    ], "rank, a"),
    "secrets_base": _digest([
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 6"),
        ("access", r"AKIA[A-Z0-9]+", "length(m) >= 20"), ("hex", r"[0-9a-f]+", "length(m) >= 24"),
    ], "a, rank"),
}
QUERIES = {"rules_base": rules_base, "licenses_base": licenses_base, "pii_base": pii_base, "secrets_base": secrets_base}
