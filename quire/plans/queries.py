"""The engine's queries by name, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import MODEL_TOKEN_LIMITS, PROVIDERS
from ..functions import css, text
from ..operators import assemble, batching, history, layout, metrics, pages, table_function, translate
from ..sources import html, sinks, tables
from ..sources.tables import lines, table, words
from ..streaming import progress as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return register


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """A VALUES table of literals."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        return str(x).lower() if isinstance(x, bool) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") v({names})"


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents"))


def word_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(table(spark, sf_dir, "documents"))
    return w.select("doc_id", "pos", F.col("word").alias("text"), F.lit(0).alias("page_idx"), F.concat(F.lit("g-"), F.col("pos").cast("string")).alias("seg_id"))


def done_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for earlier results: every third line, marked."""
    return seg(spark, sf_dir).where("pos % 3 = 0").select("doc_id", "seg_id", "page_idx", F.concat(F.lit("[x] "), F.col("text")).alias("translated"))


SEG = r"""seg AS (SELECT doc_id, pos::INT AS pos, text, (pos // 20)::INT AS page_idx, 'g-' || pos AS seg_id FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"""
TOKW = r"""tokw AS (SELECT doc_id, pos::INT AS pos, word FROM (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS word, generate_subscripts(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), 1) - 1 AS pos FROM documents))"""


def sql_reason(t: str) -> str:
    s = f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    return f"""CASE WHEN length({s}) = 0 THEN 'empty' WHEN regexp_matches({s}, '^[\\d\\s,.\\-+]+$') THEN 'numeric'
      WHEN regexp_matches({s}, '^(\\[\\d+\\]|\\(\\d+\\))$') THEN 'bracket' WHEN length({s}) = 1 AND NOT regexp_matches({s}, '^\\p{{L}}$') THEN 'symbol' END"""


def sql_tokens(t: str) -> str:
    cjk = f"length(regexp_replace({t}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))"
    return f"CASE WHEN length({t}) = 0 THEN 0 WHEN {cjk} * 10 > length({t}) * 3 THEN length({t}) * 2 // 3 ELSE greatest(1, length({t}) * 13 // 40) END"


def sql_batches(source: str, column: str, budget: int, most: int) -> str:
    """CTEs p (prose with tokens) and b (its batches) over a CTE with (doc_id, pos, <column>)."""
    return f"""p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM (SELECT *, ({sql_tokens(column)})::BIGINT AS tokens FROM {source} WHERE ({sql_reason(column)}) IS NULL)),
b AS (SELECT doc_id, rn, 0::INT AS batch_no, 1::BIGINT AS n, tokens AS t, tokens > {budget} AS shut FROM p WHERE rn = 1
  UNION ALL SELECT p.doc_id, p.rn, CASE WHEN f THEN b.batch_no ELSE b.batch_no + 1 END, CASE WHEN f THEN b.n + 1 ELSE 1 END, CASE WHEN f THEN b.t + p.tokens ELSE p.tokens END, p.tokens > {budget}
  FROM b JOIN p ON p.doc_id = b.doc_id AND p.rn = b.rn + 1, LATERAL (SELECT NOT b.shut AND p.tokens <= {budget} AND b.t + p.tokens <= {budget} AND b.n < {most} AS f))"""


def sql_plan(budget: int, most: int) -> str:
    return f"""WITH RECURSIVE {SEG}, {sql_batches('seg', 'text', budget, most)}
SELECT doc_id, batch_no, count(*) AS n_segments, sum(tokens)::BIGINT AS estimated_tokens, arg_min(seg_id, pos) AS first_seg, arg_max(seg_id, pos) AS last_seg
FROM p JOIN b USING (doc_id, rn) GROUP BY doc_id, batch_no"""


def _plan(rows: DataFrame, budget: int, most: int) -> DataFrame:
    ends = [F.get("segments", F.lit(0))["id"].alias("first_seg"), F.element_at("segments", -1)["id"].alias("last_seg")]
    return batching.batches(rows, budget=budget, max_rows=most).select("doc_id", "batch_no", "n_segments", "estimated_tokens", *ends)


@query(sql_plan(1000, 60))
def batch_plan(spark, sf_dir):
    return _plan(seg(spark, sf_dir), 0, 60)


@query(sql_plan(100, 3))
def batch_plan_tight(spark, sf_dir):
    return _plan(seg(spark, sf_dir), 100, 3)


@query(f"""WITH RECURSIVE {SEG}, {sql_batches('seg', 'text', 1000, 60)},
g AS (SELECT doc_id, batch_no, count(*) AS n, sum(tokens)::BIGINT AS t FROM p JOIN b USING (doc_id, rn) GROUP BY doc_id, batch_no)
SELECT doc_id, count(*) AS n_batches, sum(n)::BIGINT AS n_segments, sum(t)::BIGINT AS n_tokens,
  string_agg('Batch ' || lpad((batch_no + 1)::VARCHAR, greatest(2, length((batch_no + 1)::VARCHAR))::INT, '0') || ' : ' || n || ' segment(s), ~' || format('{{:,}}', t) || ' tokens', chr(10) ORDER BY batch_no) AS lines
FROM g GROUP BY doc_id""")
def batch_summary(spark, sf_dir):
    return batching.summary(batching.batches(seg(spark, sf_dir)))


@query(f"WITH {TOKW} SELECT doc_id, pos, {sql_reason('word')} AS reason FROM tokw WHERE ({sql_reason('word')}) IS NOT NULL")
def noise_reason(spark, sf_dir):
    return words(table(spark, sf_dir, "documents")).select("doc_id", "pos", text.noise_reason(F.col("word")).alias("reason")).where("reason IS NOT NULL")


@query(f"WITH {TOKW} SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS n_chars FROM tokw WHERE ({sql_reason('word')}) IS NULL GROUP BY doc_id")
def noise_filter(spark, sf_dir):
    w = words(table(spark, sf_dir, "documents")).where(text.should_translate(F.col("word")))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(F.length("word")).alias("n_chars"))


#: Keys of an order's lines in the forms that the noise rules tell apart; the same text in both dialects.
CASES = """CASE (l_orderkey + l_linenumber) % 15 WHEN 0 THEN '  ' WHEN 1 THEN concat(l_orderkey) WHEN 2 THEN concat('0.', l_partkey) WHEN 3 THEN '-' WHEN 4 THEN concat('+', l_linenumber, ', ', l_suppkey) WHEN 5 THEN concat('[', l_orderkey, ']')
  WHEN 6 THEN concat('(', l_linenumber, ')') WHEN 7 THEN '=' WHEN 8 THEN concat('(', l_linenumber, 'a)') WHEN 9 THEN concat('[', l_linenumber, ',', l_suppkey, ']') WHEN 10 THEN 'a' WHEN 11 THEN 'é' WHEN 12 THEN '漢' WHEN 13 THEN concat('x', l_partkey) ELSE '%%' END"""


@query(f"SELECT l_orderkey, l_linenumber, {sql_reason('t')} AS reason, ({sql_tokens('t')})::INT AS tokens FROM (SELECT l_orderkey, l_linenumber, {CASES} AS t FROM lineitem)")
def noise_cases(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CASES).alias("t"))
    return t.select("l_orderkey", "l_linenumber", text.noise_reason(F.col("t")).alias("reason"), text.estimate_tokens(F.col("t")).alias("tokens"))


@query(f"SELECT doc_id, ({sql_tokens('text')})::INT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {SEG} SELECT lang, count(*) AS n_segments, sum({sql_tokens('s.text')})::BIGINT AS tokens FROM seg s JOIN documents d USING (doc_id) GROUP BY lang")
def token_totals(spark, sf_dir):
    at = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("t"))
    return at.groupBy("lang").agg(F.count("*").alias("n_segments"), F.sum(text.estimate_tokens(F.col("t"))).alias("tokens"))


@query(f"WITH {TOKW} SELECT doc_id, 'g-' || pos AS seg_id, word AS text FROM tokw WHERE ({sql_reason('word')}) IS NOT NULL")
def bypass_rows(spark, sf_dir):
    w = word_segments(spark, sf_dir)
    return assemble.bypassed(w).select("doc_id", "seg_id", "text")


@query(f"""WITH RECURSIVE {SEG}, {sql_batches('seg', 'text', 1000, 60)}
SELECT doc_id, seg_id FROM seg WHERE (doc_id, seg_id) NOT IN (SELECT (doc_id, seg_id) FROM p JOIN b USING (doc_id, rn) WHERE batch_no = 0)""")
def unbatched_rows(spark, sf_dir):
    """Lines that aren't in the first batch of their document."""
    s = seg(spark, sf_dir)
    return assemble.unbatched(s, batching.members(batching.batches(s)).where("batch_no = 0")).select("doc_id", "seg_id")


@query(f"WITH {SEG} SELECT doc_id, seg_id, page_idx FROM seg WHERE pos % 3 <> 0")
def incremental_remaining(spark, sf_dir):
    return assemble.remaining(seg(spark, sf_dir), done_segments(spark, sf_dir)).select("doc_id", "seg_id", "page_idx")


#: A page range for each document, with parts that are reversed, out of bounds or no pages at all.
RANGE = """CASE WHEN doc_id % 10 = 9 THEN NULL WHEN doc_id % 10 = 8 THEN '' ELSE concat(n_chars % 9, '-', doc_id % 8, ', ', doc_id % 11, ', ', n_chars % 5, ' - ', n_chars % 7, ',x', doc_id, ',3-,1-2-', n_chars % 4) END"""


@query(f"""WITH d AS (SELECT doc_id, doc_id % 7 + 1 AS total, {RANGE} AS t FROM documents),
e AS (SELECT doc_id, total, list_transform(string_split(x, '-'), lambda y: CASE WHEN regexp_full_match(trim(y), '[0-9]+') THEN trim(y)::INT END) AS e FROM (SELECT doc_id, total, unnest(string_split(t, ',')) AS x FROM d)),
r AS (SELECT DISTINCT doc_id, unnest(range(least(e[1], e[-1]) - 1, greatest(e[1], e[-1])))::INT AS page FROM e WHERE len(e) <= 2 AND e[1] BETWEEN 1 AND total AND e[-1] BETWEEN 1 AND total)
SELECT doc_id, any_value(t) AS t, coalesce(list(page ORDER BY page) FILTER (page IS NOT NULL), []) AS pages FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id""")
def page_range(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("t", F.expr(RANGE)).select("doc_id", "t", pages.page_range(F.col("t"), F.col("doc_id") % 7 + 1).alias("pages"))


def targets(spark, sf_dir):
    """Range '1, 3-2' of each document, as (doc_id, page_idx)."""
    total = pages.total_pages(seg(spark, sf_dir))
    return total.select("doc_id", F.explode(pages.page_range(F.lit("1, 3-2"), F.col("total_pages"))).alias("page_idx"))


SQL_TARGETS = """total AS (SELECT doc_id, max(page_idx) + 1 AS n FROM seg GROUP BY doc_id),
targets AS (SELECT doc_id, unnest(CASE WHEN n >= 3 THEN [0, 1, 2] ELSE [0] END)::INT AS page_idx FROM total)"""


@query(f"WITH {SEG}, {SQL_TARGETS} SELECT doc_id, seg_id, s.page_idx FROM seg s SEMI JOIN targets t USING (doc_id, page_idx)")
def page_range_select(spark, sf_dir):
    return pages.on_pages(seg(spark, sf_dir), targets(spark, sf_dir)).select("doc_id", "seg_id", "page_idx")


@query(f"WITH {SEG}, {SQL_TARGETS} SELECT doc_id, n::INT AS total_pages, list_filter(range(0, n), lambda x: x > 2 OR (n < 3 AND x > 0))::INT[] AS off FROM total")
def pages_off_range(spark, sf_dir):
    total = pages.total_pages(seg(spark, sf_dir))
    return total.select("doc_id", "total_pages", pages.off_pages(F.col("total_pages"), pages.page_range(F.lit("1, 3-2"), F.col("total_pages"))).alias("off"))


@query(f"WITH {SEG}, {SQL_TARGETS} SELECT doc_id, bool_or(pos % 3 = 0) AS any_done FROM seg SEMI JOIN targets USING (doc_id, page_idx) GROUP BY doc_id")
def range_translated_any(spark, sf_dir):
    return pages.any_done(seg(spark, sf_dir), done_segments(spark, sf_dir), targets(spark, sf_dir))


MODELS = ["gemini/gemini-2.5-pro", "gemini/gemini-3.5-flash", "ollama/llama3", "openai/gpt-5", "openai/o4-mini", "openai/unknown", "mistral/mistral-small-latest", "gpt-5", "unknown"]
SQL_CATALOGUE = values([(i, *r) for i, r in enumerate(PROVIDERS)], "ord, provider, prefix, env, models")


def models(spark, sf_dir):
    """A model for each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, MODELS)), (F.col("doc_id") % len(MODELS) + 1).cast("int")).alias("model"), (F.col("n_chars") % 4 > 0).alias("has_key"))


SQL_MODELS = f"(SELECT doc_id, {MODELS}[doc_id % {len(MODELS)} + 1] AS model, n_chars % 4 > 0 AS has_key FROM documents)"


@query(f"SELECT doc_id, model, coalesce(token_limit, 1000)::INT AS token_limit FROM {SQL_MODELS} LEFT JOIN (SELECT * FROM {values(list(MODEL_TOKEN_LIMITS.items()), 'model, token_limit')}) USING (model)")
def model_budget(spark, sf_dir):
    return batching.model_budget(models(spark, sf_dir)).select("doc_id", "model", "token_limit")


@query(f"SELECT doc_id, model, (SELECT arg_min(provider, ord) FROM (SELECT * FROM {SQL_CATALOGUE}) c WHERE starts_with(m.model, prefix)) AS provider FROM {SQL_MODELS} m")
def provider_by_prefix(spark, sf_dir):
    return translate.provider_of(models(spark, sf_dir)).select("doc_id", "model", "provider")


@query(f"""WITH c AS (SELECT ord, provider, prefix, list_transform(models, lambda m: CASE WHEN starts_with(m, prefix) THEN m ELSE prefix || m END) AS full_names FROM {SQL_CATALOGUE}),
m AS {SQL_MODELS}
SELECT doc_id, model, has_key, CASE WHEN has_key THEN (SELECT full_names[coalesce(list_position(full_names, model), 0) + 1] FROM c WHERE starts_with(model, prefix) ORDER BY ord LIMIT 1) END AS fallback_model FROM m""")
def fallback_model(spark, sf_dir):
    return translate.fallback(models(spark, sf_dir))


@query(f"SELECT doc_id, model, provider, CASE WHEN starts_with(model, prefix) THEN model ELSE prefix || model END AS qualified FROM {SQL_MODELS} JOIN (SELECT * FROM {SQL_CATALOGUE}) ON ord = doc_id % 4")
def qualified_model(spark, sf_dir):
    at = translate.provider_at((F.col("doc_id") % 4).cast("int"))
    return models(spark, sf_dir).select("doc_id", "model", at["provider"].alias("provider"), translate.qualified(F.col("model"), at["prefix"]).alias("qualified"))


@query("SELECT l_orderkey, l_linenumber, ([2, 3, 6][least(l_linenumber, 3)] * l_linenumber)::DOUBLE AS delay FROM lineitem")
def retry_schedule(spark, sf_dir):
    """Lines of an order as attempts."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", translate.retry_delay(F.col("l_linenumber").cast("int") - 1).alias("delay"))


ERRORS = [" HTTP 429", " RESOURCE_EXHAUSTED", " bad key", " Timed Out", " model Overloaded", " Quota", " Rate-Limit", " status 503", " time out", " Connection Error", " rate_LIMIT"]


@query(f"SELECT doc_id, list_bool_or(list_transform({list(text.RATE_LIMIT)}, lambda x: contains(lower(m), x))) IS TRUE AS limited FROM (SELECT doc_id, CASE WHEN n_chars % 7 > 0 THEN text || {ERRORS}[doc_id % {len(ERRORS)} + 1] END AS m FROM documents)")
def rate_limited(spark, sf_dir):
    """Texts with an error at their end."""
    message = F.when(F.col("n_chars") % 7 > 0, F.concat("text", F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("doc_id") % len(ERRORS) + 1).cast("int"))))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_rate_limit(message).alias("limited"))


@query(f"""WITH {SEG}, s AS (SELECT *, CASE WHEN pos % 3 = 0 THEN '[x] ' || text END AS tr FROM seg),
t AS (SELECT doc_id, (max(page_idx) + 1)::INT AS total_pages, count(*) AS total_segments, count(tr) AS done_segments, sum({sql_tokens('text')})::BIGINT AS input_tokens,
  sum(CASE WHEN tr IS NULL THEN 0 ELSE {sql_tokens('tr')} END)::BIGINT AS output_tokens FROM s GROUP BY doc_id)
SELECT *, CASE WHEN total_segments / total_pages < 15 THEN 'low' WHEN total_segments / total_pages <= 45 THEN 'medium' ELSE 'high' END AS complexity,
  CASE WHEN done_segments >= total_segments THEN 'full' WHEN done_segments > 0 THEN 'partial' ELSE 'none' END AS status FROM t""")
def doc_properties(spark, sf_dir):
    return metrics.document_properties(seg(spark, sf_dir), done_segments(spark, sf_dir))


WIDTH = "(length({w}) * 7 + {r} * 5) % 29 - 6"
GEOMETRY = f"""{SEG}, runs AS (SELECT doc_id, pos AS line_no, page_idx, (r - 1)::INT AS run_no, word, ({WIDTH.format(w='word', r='(r - 1)')}) * 0.5::DOUBLE AS x FROM (
  SELECT doc_id, pos, page_idx, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS r FROM seg)),
g AS (SELECT *, coalesce(sum((abs(x) >= 6)::INT) OVER (PARTITION BY doc_id, line_no ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS grp,
  word || CASE WHEN abs(x) >= 6 THEN '' WHEN x >= 2.5 THEN ' ' ELSE '' END AS piece FROM runs),
joined AS (SELECT doc_id, page_idx, line_no, grp, regexp_replace(string_agg(piece, '' ORDER BY run_no), '^\\s+|\\s+$', '', 'g') AS text FROM g GROUP BY doc_id, page_idx, line_no, grp)"""
NUMBERED = f"""WITH {GEOMETRY} SELECT doc_id, 'g-' || (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, grp) - 1) AS seg_id, page_idx, line_no, text FROM joined WHERE text <> ''"""


def geometry(spark, sf_dir):
    """Words of lines with a made-up spacer after each (scale 0.5, break from 6)."""
    at = seg(spark, sf_dir).select("doc_id", F.col("pos").alias("line_no"), "page_idx", F.posexplode(F.split("text", " ")).alias("run_no", "word"))
    x = F.expr(WIDTH.format(w="word", r="run_no")) * F.lit(0.5)
    step = layout.spacing(x, 6.0)
    return at.withColumn("is_break", step == "break").withColumn("piece", F.concat("word", F.when(step == "space", " ").otherwise("")))


LINE = ["doc_id", "page_idx", "line_no"]


@query(f"WITH {GEOMETRY} SELECT doc_id, page_idx, line_no, grp, text FROM joined WHERE text <> ''")
def run_groups(spark, sf_dir):
    return layout.join_text(layout.group_runs(geometry(spark, sf_dir), LINE), LINE).select(*LINE, "grp", "text")


@query(NUMBERED)
def segment_ids(spark, sf_dir):
    found = layout.join_text(layout.group_runs(geometry(spark, sf_dir), LINE), LINE)
    return layout.number_segments(found, "doc_id", ["line_no", "grp"]).select("doc_id", "seg_id", "page_idx", "line_no", "text")


def laid_out(spark, sf_dir):
    """The same geometry as positioned HTML, one page for every 20 lines; words of 5, 10, ... letters have a colour."""
    rules = ".m0{transform:matrix(0.5,0,0,0.25,0,0);}.fc0{color:#000000;}.fc1{color:#0066cc;}" + "".join(f"._{i}{{width:{i - 6}px;}}" for i in range(29))
    safe = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    width = WIDTH.format(w="w", r="i")
    line = f"concat('<div class=\"t m0\">', array_join(transform(split(l, ' '), (w, i) -> concat('<span class=\"ff1 ', CASE WHEN length(w) % 5 = 0 THEN 'fc1' ELSE 'fc0' END, '\">', {safe('w')}, '</span><span class=\"_ _', cast({width} + 6 AS string), '\"> </span>')), ''), '</div>')"
    opening, closing = "'<div class=\"pf\">'", "'</div>'"
    body = f"array_join(transform(split(text, '\\n'), (l, p) -> concat(CASE WHEN p % 20 = 0 THEN {opening} ELSE '' END, {line}, CASE WHEN p % 20 = 19 THEN {closing} ELSE '' END)), '')"
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat('<html><head><style>{rules}</style></head><body>', {body}, '</body></html>')").alias("html"))


TAGGED = "CASE WHEN length(word) % 5 = 0 AND regexp_matches(word, '\\S') THEN '<color_0066cc>' || {0} || '</color_0066cc>' ELSE {0} END".format("translate(word, 'ðÞ¼þ', '()=+')")
COLORED = NUMBERED.replace("word || CASE", f"{TAGGED} || CASE")


@query(COLORED.replace("line_no, text FROM", "(line_no % 20)::INT AS line_no, 0.5::DOUBLE AS sx, 0.25::DOUBLE AS sy, text FROM"))
def layout_segments(spark, sf_dir):
    return layout.segments(laid_out(spark, sf_dir), threshold=6.0).select("doc_id", "seg_id", "page_idx", "line_no", "sx", "sy", "text")


def sql_esc(t: str) -> str:
    return f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def sql_width(t: str) -> str:
    plain = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    n = lambda r: f"length(regexp_replace({plain}, '[^{r}]', '', 'g'))"
    return f"(length({plain}) * 5 - {n('iljtfrI.,;:!|' + chr(39) * 2 + ' ')} * 2 + {n('A-HJ-Zmw')} * 2 + {n(r'\x{{2e80}}-\x{{9fff}}\x{{ac00}}-\x{{d7ff}}\x{{ff00}}-\x{{ffef}}'.replace('{{', '{').replace('}}', '}'))} * 5)"


def sql_lines(translated: str) -> str:
    """CTEs up to `lines` (doc_id, page_idx, line_no, html_fragment, fit) of laid_out, with a translation of each text."""
    new = f"CASE WHEN trim({translated}) <> trim(text) THEN {translated} END"
    shown = sql_esc("new")
    for tag in ("color_0066cc", "/color_0066cc"):
        shown = f"replace({shown}, '&lt;{tag}&gt;', '<{tag}>')"
    shown = f"regexp_replace({shown}, '(?s)<color_([0-9a-fA-F]{{6}})>(.*?)</color(?:_\\w+)?>', '<span style=\"color: #\\1;\">\\2</span>', 'g')"
    word = f"CASE WHEN word = '' THEN '' WHEN NOT regexp_matches(word, '\\S') THEN word ELSE '<span class=\"ff1 ' || CASE WHEN length(word) % 5 = 0 THEN 'fc1' ELSE 'fc0' END || '\">' || {sql_esc('word')} || '</span>' END"
    spacer = "'<span class=\"_ _' || ((length(word) * 7 + run_no * 5) % 29) || '\"></span>'"
    return f"""{GEOMETRY.replace("word || CASE", f"{TAGGED} || CASE")},
parts AS (SELECT doc_id, page_idx, line_no, grp, string_agg({word} || CASE WHEN abs(x) >= 6 THEN '' ELSE {spacer} END, '' ORDER BY run_no) AS inside, string_agg(CASE WHEN abs(x) >= 6 THEN {spacer} ELSE '' END, '' ORDER BY run_no) AS after FROM g GROUP BY ALL),
numbered AS (SELECT *, sum((text <> '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no, grp) - 1 AS seg_no FROM joined JOIN parts USING (doc_id, page_idx, line_no, grp)),
news AS (SELECT *, CASE WHEN text <> '' THEN {new} END AS new FROM numbered),
lines AS (SELECT doc_id, page_idx, line_no, string_agg(CASE WHEN text = '' THEN inside ELSE '<span class="trans-span' || CASE WHEN new IS NULL THEN '' ELSE ' translated' END || ' ff1" data-trans-id="g-' || seg_no || '" data-sx="0.5" data-sy="0.25">' || CASE WHEN new IS NULL THEN inside ELSE {shown} END || '</span>' END || after, '' ORDER BY grp) AS html_fragment,
  CASE WHEN count(new) > 0 THEN least(0.5::DOUBLE, 0.5::DOUBLE * sum({sql_width('text')}) / sum({sql_width('coalesce(new, text)')})) END AS fit FROM news GROUP BY doc_id, page_idx, line_no)"""


@query(f"WITH {sql_lines('text')} SELECT doc_id, page_idx, (line_no % 20)::INT AS line_no, md5(html_fragment) AS m FROM lines")
def layout_wrapped_lines(spark, sf_dir):
    return layout.wrapped_lines(laid_out(spark, sf_dir), threshold=6.0).select("doc_id", "page_idx", "line_no", F.md5("html_fragment").alias("m"))


def echoed(spark, sf_dir):
    """The laid-out documents, parsed once and written, and their segments with a mark before what is prose."""
    path = f"{streaming.scratch(spark)}/laid"
    layout.laid(laid_out(spark, sf_dir), threshold=6.0).write.parquet(path)
    docs = spark.read.parquet(path)
    found = layout.segments_of(docs)
    return docs, found.withColumn("translated", F.when(text.should_translate(F.col("text")), F.concat(F.lit("[x] "), F.col("text"))).otherwise(F.col("text")))


ECHOED = sql_lines(f"CASE WHEN ({sql_reason('text')}) IS NULL THEN '[x] ' || text ELSE text END")


@query(f"WITH {ECHOED} SELECT doc_id, page_idx, (line_no % 20)::INT AS line_no, md5(html_fragment) AS m, round(fit, 6) AS fit FROM lines")
def rendered_lines(spark, sf_dir):
    docs, rows = echoed(spark, sf_dir)
    return layout.lines_of(layout.wrapped_of(docs, rows=rows)).select("doc_id", "page_idx", "line_no", F.md5("html_fragment").alias("m"), F.round("fit", 6).alias("fit"))


LAID_RULES = ".m0{transform:matrix(0.5,0,0,0.25,0,0);}.fc0{color:#000000;}.fc1{color:#0066cc;}" + "".join(f"._{i}{{width:{i - 6}px;}}" for i in range(29))


@query(f"""WITH {ECHOED} SELECT doc_id, md5('<html><head><style>{LAID_RULES}</style><style>@page{{size:A4;margin:0}}body{{margin:0;padding:0}}{assemble.STYLE}</style>' || chr(10) || '</head><body>' ||
  string_agg(CASE WHEN line_no % 20 = 0 THEN '<div class="pf">' ELSE '' END || '<div class="t m0"' || CASE WHEN fit IS NULL THEN '' ELSE ' style="transform:matrix(' || (floor(fit * 1e6::DOUBLE) / 1e6::DOUBLE)::DOUBLE || ',0,0,0.25,0,0)"' END || '>' || html_fragment || '</div>'
    || CASE WHEN line_no % 20 = 19 THEN '</div>' ELSE '' END, '' ORDER BY line_no) || '</body></html>') AS html FROM lines GROUP BY doc_id""")
def rendered(spark, sf_dir):
    docs, rows = echoed(spark, sf_dir)
    return assemble.render(layout.wrapped_of(docs, rows=rows)).select("doc_id", F.md5("html").alias("html"))


@query(f"WITH {SEG} SELECT doc_id, seg_id, page_idx, text, '[x] ' || text AS translated FROM seg")
def bilingual_rows(spark, sf_dir):
    rows = seg(spark, sf_dir).withColumn("translated", F.concat(F.lit("[x] "), F.col("text")))
    return assemble.bilingual(rows)


TMX = """<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<tmx version="1.4">' || chr(10) || '<header srclang="x" datatype="plaintext" segtype="block" adminlang="en" o-tmf="none" creationtool="quire" creationtoolversion="1"/>' || chr(10) || '<body>' || chr(10)"""


def sql_plain(t: str) -> str:
    return sql_esc(f"regexp_replace(regexp_replace({t}, '<[^>]*>', '', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")


@query(f"""WITH {SEG}, r AS (SELECT *, CASE WHEN pos % 3 = 0 THEN '<b>' || text || '</b>' END AS tr FROM seg)
SELECT doc_id, md5('[' || string_agg('{{"id":' || to_json(seg_id) || ',"page":' || page_idx || ',"source":' || to_json(text) || CASE WHEN tr IS NULL THEN '' ELSE ',"target":' || to_json(tr) END || '}}', ',' || chr(10) ORDER BY pos) || ']') AS json,
  md5('{TMX} || string_agg('<tu tuid="' || seg_id || '"><tuv xml:lang="x"><seg>' || {sql_plain('text')} || '</seg></tuv><tuv xml:lang="de"><seg>' || {sql_plain('tr')} || '</seg></tuv></tu>', chr(10) ORDER BY pos) FILTER (tr IS NOT NULL) || chr(10) || '</body>' || chr(10) || '</tmx>' || chr(10)) AS tmx FROM r GROUP BY doc_id""")
def bilingual_exports(spark, sf_dir):
    """Lines of which every third is translated, as JSON and as a translation memory."""
    rows = seg(spark, sf_dir).withColumn("translated", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("<b>"), "text", F.lit("</b>"))))
    told, memory = sinks.bilingual_json(rows, order="pos"), sinks.bilingual_tmx(rows, "x", "de", order="pos")
    return told.join(memory, "doc_id", "left").select("doc_id", F.md5("json").alias("json"), F.md5("tmx").alias("tmx"))


@query(f"""WITH {SEG}, placed AS (SELECT doc_id, page_idx, pos, [5, 9.5, 1][pos % 3 + 1]::DOUBLE AS x, [50, 70, 0, 50.25][pos % 4 + 1]::DOUBLE AS y FROM seg)
SELECT doc_id, page_idx, pos AS line_no, x, y, (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y DESC, x, pos) - 1)::INT AS visual_no FROM placed""")
def visual_order(spark, sf_dir):
    """Lines in three columns and at four heights, one of which no rule knows."""
    sheet = ".x0{left:5px} .x1{left:9.5px} .x2{margin-left:1px} .y0{bottom:50px} .y1{margin-bottom:70px} .y3{bottom:50.25px}"
    classes = F.array(F.lit("t"), F.concat(F.lit("x"), F.col("pos") % 3), F.concat(F.lit("y"), F.col("pos") % 4))
    lines_ = seg(spark, sf_dir).select("doc_id", "page_idx", F.col("pos").alias("line_no"), classes.alias("line_classes"))
    rules = css.style_rules(table(spark, sf_dir, "documents").select("doc_id", F.lit(sheet).alias("css")), ["doc_id"])
    return layout.visual_order(lines_, rules).select("doc_id", "page_idx", "line_no", "x", "y", "visual_no")


CSS = [
    (1, ".m0{transform:matrix(0.125,0,0,0.25,0,0);} .m1 { x:1; transform : matrix( -1.5 , 0, 0, 2 , 0,0)} .m0{transform:matrix(0.5,0,0,0.75,1,1)}"),
    (2, "._0{margin-left:2px;} ._1{width:1.5em} ._2{left:-4.077908pt} ._a{width:50%} ._0{right:3rem}"),
    (3, ".fc0{color:#abc;} .fc1{color:#1A2b3C} .fc2{color:rgb(255,50,50);} .fc3{color:rgba(0,0,0,0.5)} .fc4{color:transparent} .fc5{color:#12345678} .fc6{background-color:red;color:#fff} .fc1{color: #ffffff }"),
    (4, ".x0{left:85px;} .x1{margin-left:-2.5px} .y0{bottom:234px} .y1{margin-top:7px}"),
]
RULES = [
    (1, "matrix", "m0", 0.5, 0.75, None), (1, "matrix", "m1", -1.5, 2.0, None), (2, "spacer", "0", 48.0, None, None), (2, "spacer", "1", 24.0, None, None), (2, "spacer", "2", round(-4.077908 * 1.333333, 6), None, None), (2, "spacer", "a", 50.0, None, None),
    (3, "color", "fc0", None, None, "aabbcc"), (3, "color", "fc1", None, None, "ffffff"), (3, "color", "fc2", None, None, "ff3232"), (3, "color", "fc3", None, None, "000000"), (3, "color", "fc5", None, None, "12345678"),
    (4, "left", "x0", 85.0, None, None), (4, "left", "x1", -2.5, None, None), (4, "bottom", "y0", 234.0, None, None), (4, "bottom", "y1", 7.0, None, None),
]


def sheets(spark, sf_dir):
    """A style sheet for each document, made from its id and length; m0 has two rules, and some rules say nothing."""
    n, sheet = "n_chars", "concat('@media print{.m0{x:1;transform:matrix(', {n} % 97 - 48, ',0,0,0.5,0,0)}} .m0 { -webkit-transform : matrix( ', {n} % 31, '.25 , 1, 0, ', {n} % 13 - 6, ' , 0,0);}\n._1{color:red; margin-left: ', {n} % 29 - 14, element_at(array('px', 'pt', 'em', '%', ' rem'), int({n} % 5) + 1), ';width:7px} ._2{height:3px}\n.fc1{background-color:#', lpad(hex({n}), 6, '0'), ';color:#fff;} .fc2{color:rgb(', {n} % 256, ', 7,', doc_id % 256, ')} .fc3{color:transparent} .x', doc_id % 3, '{left:', {n}, 'px;} .y1{color:red;bottom:5px} .y2{\ntop:-', {n}, '.5px}')"
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(sheet.replace("{n}", n)).alias("css"))


@query("""WITH d AS (SELECT doc_id, n_chars AS n FROM documents), r AS (
  SELECT doc_id, 'matrix' AS kind, 'm0' AS class, (n % 31) + 0.25::DOUBLE AS v1, (n % 13 - 6)::DOUBLE AS v2, NULL::VARCHAR AS hex FROM d
  UNION ALL SELECT doc_id, 'spacer', '1', (n % 29 - 14) * [1::DOUBLE, 1.333333::DOUBLE, 16::DOUBLE, 1::DOUBLE, 16::DOUBLE][n % 5 + 1], NULL, NULL FROM d
  UNION ALL SELECT doc_id, 'color', 'fc1', NULL, NULL, lpad(upper(to_hex(n)), 6, '0') FROM d
  UNION ALL SELECT doc_id, 'color', 'fc2', NULL, NULL, lpad(lower(to_hex(n % 256)), 2, '0') || '07' || lpad(lower(to_hex(doc_id % 256)), 2, '0') FROM d
  UNION ALL SELECT doc_id, 'left', 'x' || doc_id % 3, n::DOUBLE, NULL, NULL FROM d
  UNION ALL SELECT doc_id, 'bottom', 'y2', -n - 0.5::DOUBLE, NULL, NULL FROM d)
SELECT doc_id, kind, class, round(v1, 6) AS v1, v2, hex FROM r""")
def css_rules(spark, sf_dir):
    return css.style_rules(sheets(spark, sf_dir), ["doc_id"]).withColumn("v1", F.round("v1", 6))


@query("SELECT doc_id, md5(translate(text, 'ðÞ¼þ', '()=+')) AS m FROM documents")
def symbol_repair(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.repair_symbols(F.col("text"))).alias("m"))


@query(f"""WITH {SEG}, t AS (SELECT doc_id, seg_id, CASE WHEN regexp_matches(text, '\\S') AND pos % 2 = 0 THEN '<color_0066cc>' || text || '</color_0066cc>' ELSE text END AS tagged FROM seg)
SELECT doc_id, seg_id, md5(tagged) AS tagged, md5(regexp_replace(tagged, '(?s)<color_([0-9a-fA-F]{{6}})>(.*?)</color(?:_\\w+)?>', '<span style="color: #\\1;">\\2</span>', 'g')) AS html FROM t""")
def color_tag_html(spark, sf_dir):
    tagged = text.color_tag(F.col("text"), F.when(F.col("pos") % 2 == 0, "0066cc"))
    return seg(spark, sf_dir).select("doc_id", "seg_id", F.md5(tagged).alias("tagged"), F.md5(text.color_html(tagged)).alias("html"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS m FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("m"))


@query("SELECT page_id, coalesce(array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), chr(10)), '') AS css FROM pages")
def html_style_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", css.style_text(F.col("html")).alias("css"))


@query()
def html_runs(spark, sf_dir):
    return html.runs(table(spark, sf_dir, "pages"), "page_id", plain=True).select("page_id", "line_no", "run_no", "kind", "text")


@query("SELECT doc_id, md5(nfc_normalize(text)) AS m FROM documents")
def nfc_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.nfc(F.col("text"))).alias("m"))


@query(f"WITH {SEG} SELECT doc_id, seg_id, page_idx, '[x] ' || text AS translated FROM seg WHERE ({sql_reason('text')}) IS NULL")
def fake_translate(spark, sf_dir):
    s = seg(spark, sf_dir)
    replies = translate.translate_batches(batching.batches(s), translate.Echo())
    return assemble.with_pages(assemble.last_items(assemble.items(replies)).drop("n_items"), s)


@query(ORACLES["fake_translate"])
def translate_sql(spark, sf_dir):
    """The same batches through the table function of SQL."""
    s = seg(spark, sf_dir)
    replies = table_function.translate_table(batching.batches(s), translate.Echo())
    return assemble.with_pages(assemble.last_items(assemble.items(replies)).drop("n_items"), s)


def landed_items(spark, sf_dir):
    """Results as a transformer might leave them: one in seven missing, one in five given twice."""
    s = seg(spark, sf_dir).where(text.should_translate(F.col("text"))).where("pos % 7 <> 3")
    one = s.select("doc_id", F.lit(0).alias("batch_no"), F.col("pos").alias("item_no"), "seg_id", F.concat(F.lit("[x] "), F.col("text")).alias("translated"))
    again = s.where("pos % 5 = 0").select("doc_id", F.lit(1).alias("batch_no"), F.col("pos").alias("item_no"), "seg_id", F.concat(F.lit("[y] "), F.col("text")).alias("translated"))
    return assemble.last_items(one.unionByName(again))


@query(f"""WITH {SEG}, s AS (SELECT *, ({sql_reason('text')}) IS NULL AS prose FROM seg) SELECT doc_id, seg_id, page_idx,
  CASE WHEN NOT prose OR pos % 7 = 3 THEN text WHEN pos % 5 = 0 THEN '[y] ' || text ELSE '[x] ' || text END AS translated,
  CASE WHEN NOT prose THEN 'bypassed' WHEN pos % 7 = 3 THEN 'missing' WHEN pos % 5 = 0 THEN 'duplicate' ELSE 'ok' END AS status FROM s""")
def assembled(spark, sf_dir):
    return assemble.assemble(seg(spark, sf_dir), landed_items(spark, sf_dir)).select("doc_id", "seg_id", "page_idx", "translated", "status")


@query(f"WITH {SEG} SELECT doc_id, 'z-' || pos AS seg_id, 0 AS page_idx FROM seg WHERE pos % 11 = 0 AND pos % 3 = 0")
def unexpected_ids(spark, sf_dir):
    wrong = done_segments(spark, sf_dir).withColumn("seg_id", F.when(F.substring_index("seg_id", "-", -1).cast("int") % 11 == 0, F.replace("seg_id", F.lit("g-"), F.lit("z-"))).otherwise(F.col("seg_id")))
    return assemble.unexpected(seg(spark, sf_dir), wrong).select("doc_id", "seg_id", "page_idx")


COMMITS = f"""WITH {TOKW}, s AS (SELECT doc_id, 'g-' || pos AS seg_id, (pos // 50)::INT AS page_idx, word, ({sql_reason('word')}) IS NULL AS prose FROM tokw)
SELECT doc_id, seg_id, page_idx FROM s SEMI JOIN (SELECT DISTINCT doc_id, page_idx FROM s WHERE prose AND length(word) > 14) landed USING (doc_id, page_idx) WHERE NOT prose"""


def paged_words(spark, sf_dir):
    """Words as segments, and those whose translations have landed: the long ones."""
    w = word_segments(spark, sf_dir).withColumn("page_idx", F.expr("pos div 50").cast("int"))
    return w, w.where(text.should_translate(F.col("text")) & (F.length("text") > 14))


@query(COMMITS)
def committed_bypass(spark, sf_dir):
    w, landed = paged_words(spark, sf_dir)
    return assemble.committed_bypass(assemble.bypassed(w), landed).select("doc_id", "seg_id", "page_idx")


@query(f"WITH {SEG} SELECT doc_id, page_idx, seg_id, CASE WHEN ({sql_reason('text')}) IS NULL THEN 'new ' ELSE '[x] ' END || text AS translated FROM seg")
def upsert_results(spark, sf_dir):
    s = seg(spark, sf_dir)
    old = s.withColumn("translated", F.concat(F.lit("[x] "), F.col("text")))
    new = s.where(text.should_translate(F.col("text"))).withColumn("translated", F.concat(F.lit("new "), F.col("text")))
    return assemble.upsert(old, new)


@query(f"WITH {SEG} SELECT doc_id, seg_id, page_idx FROM seg WHERE pos % 3 = 0 AND page_idx <> 1")
def reset_pages(spark, sf_dir):
    page = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_idx")).distinct()
    return assemble.reset_pages(done_segments(spark, sf_dir), page).select("doc_id", "seg_id", "page_idx")


@query(f"WITH {SEG} SELECT doc_id, seg_id, CASE WHEN page_idx = 0 THEN text ELSE '[x] ' || text END AS translated FROM seg")
def restore_pages(spark, sf_dir):
    page = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_idx"))
    rows = seg(spark, sf_dir).withColumn("translated", F.concat(F.lit("[x] "), F.col("text")))
    return assemble.restore_pages(rows, page).select("doc_id", "seg_id", "translated")


HEAD, TAIL = (x.replace("\n", "' || chr(10) || '") for x in (translate.CONTEXT_HEAD, translate.CONTEXT_TAIL))


@query(f"""WITH RECURSIVE {SEG}, {sql_batches('seg', 'text', 1000, 60)}
SELECT doc_id, batch_no, md5(CASE WHEN doc_id % 2 = 0 THEN '{HEAD}' || 'line ' || doc_id || chr(10) || 'next' || '{TAIL}' ELSE '' END || '[' || string_agg('{{"id": ' || to_json(seg_id) || ', "text": ' || to_json(text) || '}}', ', ' ORDER BY pos) || ']') AS message FROM p JOIN b USING (doc_id, rn) GROUP BY doc_id, batch_no""")
def user_message(spark, sf_dir):
    context = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("line "), F.col("doc_id").cast("string"), F.lit("\nnext")))
    return batching.batches(seg(spark, sf_dir)).select("doc_id", "batch_no", F.md5(translate.user_message(F.col("segments"), context)).alias("message"))


@query(f"WITH RECURSIVE {SEG}, {sql_batches('seg', 'text', 1000, 60)} SELECT doc_id, batch_no, list(seg_id ORDER BY pos) AS ids FROM p JOIN b USING (doc_id, rn) GROUP BY doc_id, batch_no")
def batch_ids(spark, sf_dir):
    return batching.batches(seg(spark, sf_dir)).select("doc_id", "batch_no", batching.batch_ids().alias("ids"))


@query(f"""WITH {SEG}, g AS (SELECT doc_id, count(*)::INT AS n, string_agg(seg_id || '=[x] ' || text, chr(10) ORDER BY pos) AS items FROM seg GROUP BY doc_id),
k AS (SELECT doc_id, n, items, text, doc_id % 12 AS kind FROM g JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN kind IN (0, 1, 3, 6, 7, 8, 10) OR kind = 11 AND n > 1 THEN n WHEN kind = 9 THEN 1 WHEN kind = 5 THEN 0 END AS n_items,
  md5(CASE WHEN kind IN (0, 1, 3, 6, 7, 8, 10) OR kind = 11 AND n > 1 THEN items WHEN kind = 9 THEN 'g-0=' || text WHEN kind = 5 THEN '' END) AS items FROM k""")
def parsed_replies(spark, sf_dir):
    """Replies for all lines of a document: plain, fenced, one object, among chatter, without JSON or empty; and damaged
    ones: with a comma at the end, without commas, in single quotes, with raw quotes and line ends inside a string, cut
    off, and without a list around the objects."""
    item = lambda quote, text: f"concat('{{{quote}id{quote}: {quote}g-', i, '{quote}, {quote}translated{quote}: ', {text}, '}}')"
    each = lambda one, comma: F.expr(f"array_join(transform(split(text, '\\n'), (l, i) -> {one}), '{comma}')")
    json_text = "regexp_replace(to_json(named_struct('v', concat('[x] ', l))), '(?s)^.\"v\":(.*).$', '$1')"
    single = item("\\'", "concat('\\'[x] ', replace(replace(l, '\\\\', '\\\\\\\\'), '\\'', '\\\\\\''), '\\'')")
    good, bare = each(item('"', json_text), ", "), each(item('"', json_text), " ")
    listed = lambda body, end="]": F.concat(F.lit("["), body, F.lit(end))
    raw_text = F.concat(F.lit('[{"id": "g-0", "translated": "'), F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"},]'))
    forms = [
        listed(good), F.concat(F.lit("```json\n"), listed(good), F.lit("\n```")), F.expr("to_json(named_struct('id', 'g-0', 'translated', text))"), F.concat(F.lit("Here: "), listed(good), F.lit(" done")), F.col("source"), F.lit("[]"),
        listed(good, ",]"), listed(bare), listed(each(single, ", ")), raw_text, listed(good, ', {"id": "g-x", "translated": "cut o'), good,
    ]
    raw = F.coalesce(*[F.when(F.col("doc_id") % len(forms) == i, f) for i, f in enumerate(forms)])
    got = table(spark, sf_dir, "documents").select("doc_id", translate.parse_reply(raw).alias("got"))
    items = F.array_join(F.transform("got", lambda i: F.concat(i["id"], F.lit("="), i["translated"])), "\n")
    return got.select("doc_id", F.when(F.col("got").isNotNull(), F.size("got")).alias("n_items"), F.md5(items).alias("items"))


@query("""WITH t AS (SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) END AS context FROM t""")
def sliding_context(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return translate.context_of(talk, "conv_id", ["turn"], "text", 5).select("conv_id", "turn", "context")


@query(f"""WITH RECURSIVE {SEG}, {sql_batches('seg', 'text', 1000, 60)}, f AS (SELECT doc_id, batch_no, arg_min(page_idx, pos) AS page_idx FROM p JOIN b USING (doc_id, rn) GROUP BY doc_id, batch_no)
SELECT doc_id, batch_no, page_idx, coalesce(lag(page_idx) OVER (PARTITION BY doc_id ORDER BY batch_no) <> page_idx, true) AS page_changed FROM f""")
def page_change(spark, sf_dir):
    return metrics.page_changes(batching.members(batching.batches(seg(spark, sf_dir))))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS u, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done, min(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS u0 FROM events),
s AS (SELECT event_id, user_id, done, 100 AS total, done / greatest((u - u0) / 1e6::DOUBLE, 0.1::DOUBLE) AS speed FROM e),
l AS (SELECT *, greatest(0, total - done) / greatest(speed, 0.001::DOUBLE) AS left_s FROM s)
SELECT event_id, user_id, done, round(done / total * 100, 6) AS percent, round(speed, 6) AS speed, floor(left_s / 60)::BIGINT AS eta_mins, floor(left_s - floor(left_s / 60) * 60)::BIGINT AS eta_secs FROM l""")
def progress_eta(spark, sf_dir):
    out = metrics.progress(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", F.lit(100), ["ts", "event_id"])
    return out.select("event_id", "user_id", "done", F.round("percent", 6).alias("percent"), F.round("speed", 6).alias("speed"), "eta_mins", "eta_secs")


@query("""WITH m AS (SELECT '/data/' || source || '.pdf' AS path, max(doc_id) AS ts FROM documents GROUP BY source)
SELECT rank, split_part(path, '/', -1) AS name, path FROM (SELECT row_number() OVER (ORDER BY ts DESC, path)::INT AS rank, path FROM m) WHERE rank <= 20""")
def recent_files(spark, sf_dir):
    opened = table(spark, sf_dir, "documents").select(F.concat(F.lit("/data//./"), F.col("source"), F.lit(".pdf")).alias("path"), F.col("doc_id").alias("ts"))
    return history.recent(opened)


@query("SELECT DISTINCT '/data/' || source || '.pdf' AS path FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 7 = 0)")
def existing_files(spark, sf_dir):
    name = F.concat(F.lit("/data/"), F.col("source"), F.lit(".pdf")).alias("path")
    docs = table(spark, sf_dir, "documents")
    return history.existing(docs.select(name).distinct(), docs.where("doc_id % 7 = 0").select(name))


@query("""SELECT event_id, CASE event_id % 6 WHEN 1 THEN strftime(ts, '%Y') WHEN 2 THEN 'Unknown' WHEN 4 THEN event_type WHEN 5 THEN 'Unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def pdf_date(spark, sf_dir):
    """Times of events as a file may give them: whole, year only, none, without its mark, no date, empty."""
    kind, stamp, mark = F.col("event_id") % 6, F.date_format("ts", "yyyyMMddHHmmss"), F.lit("D:")
    raw = F.when(kind == 0, F.concat(mark, stamp, F.lit("+01'00'"))).when(kind == 1, F.concat(mark, F.date_format("ts", "yyyy"))).when(kind == 3, stamp).when(kind == 4, F.concat(mark, "event_type")).when(kind == 5, "")
    return table(spark, sf_dir, "events").select("event_id", text.pdf_date(raw).alias("parsed"))


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS kind, CASE doc_id % 3 WHEN 0 THEN printf('%.2f', (n_chars % 700) * 0.0352778::DOUBLE) WHEN 1 THEN doc_id::VARCHAR END AS w, CASE doc_id % 3 WHEN 0 THEN printf('%.2f', (n_chars % 900) * 0.0352778::DOUBLE) WHEN 1 THEN n_chars::VARCHAR END AS h FROM documents)
SELECT doc_id, coalesce(w || 'cm ' || h || 'cm', 'A4') AS css, coalesce(w::DOUBLE || 'cm ' || h::DOUBLE || 'cm', 'A4') AS css_numbers FROM d""")
def page_size_css(spark, sf_dir):
    n, kind = F.col("n_chars"), F.col("doc_id") % 3
    size = F.when(kind == 0, text.page_size_text(n % 700, n % 900)).when(kind == 1, F.format_string("[%dx%d cm]", "doc_id", n)).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.page_size_css(size).alias("css"), text.page_size_css(size, True).alias("css_numbers"))


@query("SELECT s_suppkey, '[' || printf('%.2f', (s_suppkey % 700) * 0.0352778::DOUBLE) || ' x ' || printf('%.2f', (s_suppkey % 900) * 0.0352778::DOUBLE) || ' cm]' AS size FROM supplier")
def page_size_text(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.page_size_text(F.col("s_suppkey") % 700, F.col("s_suppkey") % 900).alias("size"))


@query("""SELECT doc_id || '.pdf' AS path, '0.00 MB' AS file_size, CASE WHEN doc_id % 4 = 0 THEN 'PDF-1.4' ELSE 'PDF-1.' || doc_id % 8 END AS pdf_version, CASE WHEN doc_id % 3 = 0 THEN 'Yes' ELSE 'No' END AS linearized,
  CASE WHEN doc_id % 5 = 0 THEN 'Yes' ELSE 'No' END AS tagged, '[' || printf('%.2f', (200 + n_chars % 500) * 0.0352778::DOUBLE) || ' x ' || printf('%.2f', (300 + doc_id % 500) * 0.0352778::DOUBLE) || ' cm]' AS page_size, (doc_id % 6)::INT AS pages_count,
  CASE WHEN doc_id % 2 = 0 THEN source || ' (of ' || lang || ')' ELSE doc_id::VARCHAR END AS title, 'Unknown' AS subject, lang AS creator, 'Unknown' AS author, 'Unknown' AS producer, 'None' AS keywords,
  '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 10:20:30' AS created_date, 'Unknown' AS mod_date FROM documents""")
def pdf_properties(spark, sf_dir):
    """Small PDF files made from the documents' columns."""
    parts = [
        "CASE WHEN doc_id % 4 = 0 THEN 'no header' ELSE concat('%PDF-1.', doc_id % 8) END", "CASE WHEN doc_id % 3 = 0 THEN ' /Linearized 1' ELSE '' END", "CASE WHEN doc_id % 5 = 0 THEN ' /MarkInfo <<>>' ELSE '' END", "' /Type /Pages'",
        "repeat(' << /Type /Page >> ', int(doc_id % 6))", "concat('/MediaBox [0 0 ', 200 + n_chars % 500, ' ', 300 + doc_id % 500, ']')", "CASE WHEN doc_id % 2 = 0 THEN concat(' /Title (', source, ' \\\\(of ', lang, '\\\\))') ELSE '' END",
        "concat(' /Creator (', lang, ') /CreationDate (D:202401', lpad(doc_id % 28 + 1, 2, '0'), '102030Z)')",
    ]
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.expr(f"encode(concat({', '.join(parts)}), 'ISO-8859-1')").alias("content"))
    return tables.pdf_properties(files)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN '1.' || doc_id % 8 END AS version, doc_id % 3 = 0 AND (CASE WHEN doc_id % 4 > 0 THEN 9 ELSE 0 END) + strlen(text) + 11 <= 1024 AS linearized FROM documents""")
def pdf_header(spark, sf_dir):
    """Whole texts as files, some with a header in front, some with a mark at the end that counts within 1024 bytes."""
    head = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("%PDF-1."), (F.col("doc_id") % 8).cast("string"), F.lit("\n"))).otherwise("")
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(head, "text", F.when(F.col("doc_id") % 3 == 0, "/Linearized 1").otherwise("")), "UTF-8").alias("content"))
    return files.select("doc_id", *tables.header_fields(F.substring("content", 1, 1024)))


@query(f"WITH {SEG} SELECT pos AS current, (doc_id + pos)::INT AS total FROM seg WHERE pos % 3 > 0")
def compile_progress(spark, sf_dir):
    return tables.compile_progress(compile_log(spark, sf_dir))


def compile_log(spark, sf_dir):
    """Lines as a log in which two of three report."""
    at = F.format_string("Working:%s%d/%d", F.when(F.col("pos") % 3 == 1, " ").otherwise("  "), "pos", F.col("doc_id") + F.col("pos"))
    log = F.when(F.col("pos") % 3 == 1, at).when(F.col("pos") % 3 == 2, F.concat("text", at, F.lit(" s"))).otherwise(F.col("text"))
    return seg(spark, sf_dir).select("pos", log.alias("value"))


@query("SELECT user_id, arg_max(page_idx, (h, -page_idx))::INT AS page_idx FROM (SELECT user_id, (event_id % 5)::INT AS page_idx, greatest(0, least(value + 300, 500) - greatest(value - 100, 0)) AS h FROM events) GROUP BY user_id")
def most_visible_page(spark, sf_dir):
    boxes = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).cast("int").alias("page_idx"), (F.col("value") - 100).alias("top"), (F.col("value") + 300).alias("bottom"))
    return pages.most_visible(boxes, 500.0, "user_id")


@query(f"WITH {SEG} SELECT doc_id, seg_id, round(CASE WHEN pos % 3 = 0 THEN least(0.5, 0.5 * (1 + length(text)) / (2 + length(text) * 2)) ELSE 0.5 END::DOUBLE, 6) AS sx FROM seg")
def fit_scale(spark, sf_dir):
    n = F.length("text")
    sx = F.when(F.col("pos") % 3 == 0, text.fit_scale(F.lit(0.5), (n + 1).cast("double"), (n * 2 + 2).cast("double"))).otherwise(F.lit(0.5))
    return seg(spark, sf_dir).select("doc_id", "seg_id", F.round(sx, 6).alias("sx"))


@query(f"WITH {SEG} SELECT doc_id, count(*) FILTER (trim(text) <> trim(CASE WHEN pos % 2 = 0 THEN ' ' || text || ' ' ELSE text || '.' END)) AS n_changed FROM seg GROUP BY doc_id")
def changed_segments(spark, sf_dir):
    other = F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" "), F.col("text"), F.lit(" "))).otherwise(F.concat(F.col("text"), F.lit(".")))
    return seg(spark, sf_dir).groupBy("doc_id").agg(F.count(F.when(text.changed(F.col("text"), other), 1)).alias("n_changed"))


@query("""WITH t AS (SELECT lang, source FROM documents GROUP BY lang, source HAVING count(*) % 2 = 0)
SELECT d.lang AS locale, d.source AS key, CASE WHEN t.lang IS NOT NULL THEN d.lang || ' says 3 {n}' WHEN e.lang IS NOT NULL THEN 'en says 3 {n}' ELSE d.source END AS text
FROM documents d LEFT JOIN t ON t.lang = d.lang AND t.source = d.source LEFT JOIN t e ON e.lang = 'en' AND e.source = d.source""")
def localized_texts(spark, sf_dir):
    """Sources as keys; every second pair of language and source, by its count, has a text."""
    keys = table(spark, sf_dir, "documents").select(F.col("lang").alias("locale"), F.col("source").alias("key"))
    texts = keys.groupBy("locale", "key").count().where("count % 2 = 0").select("locale", "key", F.concat("locale", F.lit(" says {n} {n}")).alias("text"))
    return history.localized(keys, texts).withColumn("text", text.fill_first(F.col("text"), "n", F.lit("3")))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 > 0 AND doc_id % 3 = 0 AND n_chars % 2 = 0 THEN source ELSE 'd' END AS have, CASE WHEN doc_id % 7 > 0 AND doc_id % 3 = 0 AND n_chars % 2 = 1 THEN source ELSE 'd' END AS other_key,
  CASE WHEN doc_id % 7 > 0 AND doc_id % 3 > 0 AND n_chars % 2 = 0 THEN source ELSE 'd' END AS other_section FROM documents""")
def settings_lookup(spark, sf_dir):
    """Settings of one section and key for each document, or none."""
    s = F.expr("CASE WHEN doc_id % 7 > 0 THEN map(CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END, map(CASE WHEN n_chars % 2 = 0 THEN 'k' ELSE 'z' END, source)) END")
    return table(spark, sf_dir, "documents").select("doc_id", *(history.setting(s, a, k, "d").alias(name) for name, a, k in (("have", "a", "k"), ("other_key", "a", "z"), ("other_section", "b", "k"))))


@query(f"""SELECT s_suppkey, provider, coalesce(CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN '  ' END, '') NOT SIMILAR TO ' *' OR provider ILIKE '%ollama%' AS ready
FROM supplier JOIN (SELECT * FROM {SQL_CATALOGUE}) ON ord = s_suppkey % {len(PROVIDERS)}""")
def provider_status(spark, sf_dir):
    """A provider for each supplier, with its name, blanks or nothing as the key."""
    provider = translate.provider_at((F.col("s_suppkey") % len(PROVIDERS)).cast("int"))["provider"]
    key = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 1, "  ")
    return table(spark, sf_dir, "supplier").select("s_suppkey", provider.alias("provider"), history.provider_ready(provider, key).alias("ready"))


@query("""SELECT o_orderkey, 'pf' || lower(to_hex(o_orderkey % 300 + 1)) AS page_id, (o_orderkey % 300)::INT AS page, format('{:,}', o_orderkey) AS thousands,
  CASE WHEN o_orderkey % 500 >= 60 THEN (o_orderkey % 500 // 60) || ' mins ' || (o_orderkey % 500 % 60) || ' secs' ELSE (o_orderkey % 500) || ' secs' END AS duration, greatest(50, least(250, o_orderkey % 400))::INT AS zoom FROM orders""")
def scalar_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("page_id", text.hex_of_page((F.col("o_orderkey") % 300).cast("int")))
    return o.select(
        "o_orderkey", "page_id", text.page_of_hex(F.col("page_id")).alias("page"), text.thousands(F.col("o_orderkey")).alias("thousands"), text.duration(F.col("o_orderkey") % 500).alias("duration"),
        text.zoom((F.col("o_orderkey") % 400).cast("string")).alias("zoom"),
    )


@query("""WITH d AS (SELECT doc_id, doc_id % 5 AS kind, source AS s, lang AS l, doc_id::VARCHAR AS i FROM documents)
SELECT doc_id, CASE kind WHEN 0 THEN '/data/' || s || '/' || i || '.pdf' WHEN 1 THEN 'a/b' || i WHEN 2 THEN s || i || '.PDF' WHEN 3 THEN l || '/' || s || '.x.tar' ELSE '/' END AS k,
  CASE kind WHEN 0 THEN i || '.pdf' WHEN 2 THEN s || i || '.PDF' WHEN 3 THEN s || '.x.tar' ELSE '' END AS name,
  CASE kind WHEN 0 THEN '/data//' || s || '/./' || i || '_translated.pdf' WHEN 1 THEN 'a/b' || i || '/_translated' WHEN 2 THEN s || i || '_translated.PDF' WHEN 3 THEN './' || l || '//' || s || '.x_translated.tar' ELSE '/_translated' END AS out, kind IN (0, 2) AS is_pdf FROM d""")
def path_names(spark, sf_dir):
    path = "CASE doc_id % 5 WHEN 0 THEN concat('/data//', source, '/./', doc_id, '.pdf') WHEN 1 THEN concat('a/b', doc_id, '/') WHEN 2 THEN concat(source, doc_id, '.PDF') WHEN 3 THEN concat('./', lang, '//', source, '.x.tar') ELSE '/' END"
    p = F.col("path")
    return table(spark, sf_dir, "documents").withColumn("path", F.expr(path)).select("doc_id", text.path_key(p).alias("k"), text.base_name(p).alias("name"), text.output_name(p).alias("out"), tables.is_pdf(p).alias("is_pdf"))


@query("SELECT event_id, (CASE WHEN list_contains(t, page - 1) THEN list_position(t, page - 1) ELSE least(page, total) END)::INT AS step FROM (SELECT event_id, event_id % 10 + 1 AS page, [0, 2, 4 + user_id % 3] AS t, 3 + user_id % 5 AS total FROM events)")
def range_position(spark, sf_dir):
    page, user = (F.col("event_id") % 10 + 1).cast("int"), (F.col("user_id") % 15).cast("int")
    at = pages.range_position(page, F.array(F.lit(0), F.lit(2), user % 3 + 4), user % 5 + 3)
    return table(spark, sf_dir, "events").select("event_id", at.alias("step"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    return streaming.stream_counts(spark, sf_dir)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_upsert(spark, sf_dir):
    return streaming.stream_upsert(spark, sf_dir)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_once(spark, sf_dir):
    return streaming.stream_once(spark, sf_dir)


@query("""SELECT conv_id, count(*) AS n, array_to_string(list(text ORDER BY turn)[-5:], chr(10)) AS context FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def stream_context(spark, sf_dir):
    return streaming.stream_context(spark, sf_dir)


@query(COMMITS)
def stream_commits(spark, sf_dir):
    """Bypassed words and long words as two streams; the latter come in two runs, with a restart between them."""
    path, (w, landed) = streaming.scratch(spark), paged_words(spark, sf_dir)
    noise = streaming.delivered(assemble.bypassed(w).select("doc_id", "seg_id", "page_idx"), f"{path}/noise", "doc_id", 2)
    pages_of = landed.select("doc_id", "page_idx")
    for odd in (0, 1):
        stream = streaming.delivered(pages_of.where(F.col("page_idx") % 2 == odd), f"{path}/in", "doc_id", 2)
        out = streaming.bypass_commits(noise, stream, path)
    return out.drop("epoch")


@query("SELECT event_id, 1::BIGINT AS n, count(*) OVER () AS n_numbers, count(*) OVER () AS last_number FROM events")
def stream_outbox(spark, sf_dir):
    return streaming.stream_outbox(spark, sf_dir)


@query("""WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM b)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n, arg_max(event_type, (ts, event_id)) AS event_type FROM s GROUP BY user_id, burst""")
def stream_sessions(spark, sf_dir):
    return streaming.stream_sessions(spark, sf_dir)


@query(f"WITH {SEG} SELECT pos AS current, (doc_id + pos)::INT AS total FROM seg WHERE pos % 3 > 0")
def stream_compile_progress(spark, sf_dir):
    """The same log as a stream of deliveries, as it grows."""
    path = streaming.scratch(spark)
    log = streaming.delivered(compile_log(spark, sf_dir), f"{path}/in", "pos", 3)
    streaming.land(tables.compile_progress(log), path)
    return spark.read.parquet(f"{path}/rows").select("current", "total")
