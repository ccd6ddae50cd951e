"""Benchmark decontamination on the positional index: every word of a document inside a benchmark window is hit.

Windows that stand in a document with one other word put in are reported beside as proximity matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, materialize, row_key, table
from .positional import aligned, anchor_terms, exact_matches, folded, phrases_with_anchors, postings, proximity_matches, term_counts, words_of

WINDOW = 10
#: A word in a text that isn't lower-cased.
WORD = r"[0-9A-Za-z\P{ASCII}]+"


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words): runs of `size` words of each item; all its words if it has fewer, nothing if it has none."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1)))
    return items.select("item_id", "w", at.alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("words"))


class Search:
    """The index of a corpus for the windows of a benchmark. Texts are split in each of the two passes: a written table of
    word arrays was tried, and took more of the executors' memory than it saved time."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 1):
        self.docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), row_key("doc_id", "text").alias("k"), "text")
        words = self.docs.select("d", "k", words_of(F.col("text")).alias("words"))
        self.windows = materialize(windows(benchmark, size).withColumn("text", folded(F.array_join("words", " "))))
        distinct = materialize(self.windows.groupBy("text").agg(F.min("words").alias("words")).withColumn("phrase", F.monotonically_increasing_id()))
        self.items = distinct.select("phrase", "text").join(self.windows.select("text", "item_id").distinct(), "text").select("phrase", "item_id")
        vocabulary = materialize(distinct.select(F.explode("words").alias("word")).select(F.lower("word").alias("term")).distinct())
        self.anchored = materialize(phrases_with_anchors(distinct.select("phrase", "words"), materialize(term_counts(words, vocabulary))))
        terms = materialize(anchor_terms(self.anchored))
        self.index = materialize(postings(words, terms, size - 1 + slop, size - 1 + slop, wide=F.col("rare")))
        self.met = materialize(aligned(self.index, self.anchored, slop))

    def phrases(self) -> DataFrame:
        return exact_matches(self.met)

    def proximity(self) -> DataFrame:
        return proximity_matches(self.met)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, k, n_words, n_hit, n_items, items_sha256, contaminated, n_near, n_near_items) for every row of docs.

    k tells rows apart. n_near counts the places where a window stands with one other word put in, n_near_items the
    items of such windows; contaminated doesn't depend on them. Null and wordless texts have no words and no hits.
    Repeated rows come out repeated with the same result; rows that share an id but not a text are searched apart; items
    without an id or words don't count. Texts of any length are searched whole; extra columns are ignored. An empty
    benchmark hits nothing; an empty table gives no rows."""
    search = Search(docs, benchmark, size)
    found, near = materialize(search.phrases()), materialize(search.proximity())
    end = F.col("start") + F.col("size")
    before = F.max(end).over(Window.partitionBy("d", "k").orderBy("start", "size", "phrase").rowsBetween(Window.unboundedPreceding, -1))
    covered = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    hit = found.withColumn("c", covered).groupBy("d", "k").agg(F.sum("c").cast("long").alias("n_hit"))
    listed = lambda rows: lookup(rows.select("d", "k", "phrase").distinct(), search.items, ["phrase"]).select("d", "k", F.col("item_id").cast("string").alias("item")).distinct()
    items = listed(found).groupBy("d", "k").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    places = near.select("d", "k", "start").distinct().groupBy("d", "k").agg(F.count("*").alias("n_near"))
    close = places.join(listed(near).groupBy("d", "k").agg(F.count("*").alias("n_near_items")), ["d", "k"])
    every = search.docs.select("doc_id", "d", "k", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(hit.join(items, ["d", "k"]), ["d", "k"], "left").join(close, ["d", "k"], "left").select(
        "doc_id", "k", "n_words", n("n_hit"), n("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), n("n_near"), n("n_near_items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without a hit, with all their columns, whatever their names.

    Null and wordless texts stay; repeated rows share their fate, and of rows that share an id each is judged by its own
    text. Proximity matches don't count. An empty benchmark keeps every row; an empty table gives no rows."""
    hit = materialize(Search(docs, benchmark, size, 0).phrases().select("d", "k").distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(0)).alias("d"), row_key("doc_id", "text").alias("k"))
    return packed.join(hit, ["d", "k"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM w, sizes WHERE len(w) >= size)),
m AS (SELECT DISTINCT doc_id, item_id, s, dw.size FROM dw JOIN win USING (phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
lw AS (SELECT doc_id, size, s, w[s:s + size] AS l FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 1)) AS s FROM w, sizes WHERE len(w) > size AND size > 1)),
nw AS (SELECT doc_id, s, array_to_string(l[1:i] || l[i + 2:size + 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size)) AS i FROM lw)),
n AS (SELECT DISTINCT doc_id, s, item_id FROM nw JOIN win USING (phrase)),
nn AS (SELECT doc_id, count(DISTINCT s) AS n_near, count(DISTINCT item_id) AS n_near_items FROM n GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0, false) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
