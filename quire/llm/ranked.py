"""Ranked lexical search by the three-phase uniform threshold algorithm (TPUT) over term-partitioned postings.

A posting's impact on a score is a whole number, so a document's score for an item is the sum of its impacts in the
lists of the item's terms. Phase 1 fetches the heads of all lists and looks up the documents of the best partial sums:
the k-th best of their scores is a lower bound. Phase 2 fetches from every list whatever reaches one threshold, the
same for all lists of an item: a share of the level up to which all lists together could hold the bound, where a list
counts with its head at most. What is in no fetched part can't be among the k best; what is in few parts mostly neither,
as each of the others adds less than the threshold. Phase 3 looks up the exact scores of the documents whose upper bound
still reaches the bound, or the k-th best partial sum if that is higher."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, fits, lookup, materialize, spread_join, table

#: Documents that an item gets at most.
TOP = 10
#: Terms are what stands between ASCII characters that are neither digits nor letters; A-Z only are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Postings that a head holds, for each document that an item gets.
HEAD = 10
#: The threshold is this part of the level. With 1 fewer postings are fetched, but one of them makes a candidate.
PART = 2
#: Rows of a batch that leaves a task.
ROWS = 50_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def _pairs(df: DataFrame, columns: list[str], schema: str, arrow: pa.Schema, rows_of) -> DataFrame:
    """rows_of(values of the columns, a number for the row that is unique in the table) in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                rows += rows_of(values, number)
                number += 1
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the different terms of each item (item_id, text); rows that share an id are one item."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))
    arrow = pa.schema([("item_id", _arrow_type(items, "item_id")), ("term", pa.string())])
    return _pairs(rows, ["item_id", "text"], f"item_id {kind}, term string", arrow, lambda v, _: [(v[0], t.decode()) for t in set(terms_of(v[1]))]).distinct()


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def document_terms(docs: DataFrame, vocabulary: DataFrame, limit: int | None = None) -> DataFrame:
    """(row, doc_id, n, t, tf): each document's own terms of vocabulary (term, t), and one row with a null t for itself.

    row tells rows of docs apart and n counts all terms of the text. Write the result: row isn't the same when it is
    worked out again. A vocabulary of up to `limit` (BROADCAST_ROWS) terms goes to every task; beyond that all terms
    leave the tasks, once for each document, and are joined with salted hot terms."""
    limit = BROADCAST_ROWS if limit is None else limit
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if fits(vocabulary, limit):
        known = {r.term.encode(): r.t for r in vocabulary.collect()}
        own = docs.sparkSession.sparkContext.broadcast(known)

        def rows_of(values: tuple, number: int) -> list[tuple]:
            of, words = own.value, terms_of(values[1])
            met = Counter([t for t in map(of.get, words) if t is not None])
            return [(number, values[0], len(words), None, 0), *((number, values[0], len(words), t, tf) for t, tf in met.items())]

        arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("t", pa.int64()), ("tf", pa.int64())])
        return _pairs(source, ["doc_id", "text"], "row long, doc_id long, n long, t long, tf long", arrow, rows_of)

    def every(values: tuple, number: int) -> list[tuple]:
        words = terms_of(values[1])
        return [(number, values[0], len(words), None, 0), *((number, values[0], len(words), t.decode(), tf) for t, tf in Counter(words).items())]

    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])
    found = materialize(_pairs(source, ["doc_id", "text"], "row long, doc_id long, n long, term string, tf long", arrow, every))
    met = spread_join(found.where("term IS NOT NULL"), vocabulary, ["term"], by=["row"]).select("row", "doc_id", "n", "t", "tf")
    return found.where("term IS NULL").select("row", "doc_id", "n", F.lit(None).cast("long").alias("t"), "tf").unionByName(met)


def impact(documents: int, terms: int) -> Column:
    """What tf occurrences of a term of weight w add to the score of a document of n terms; whole numbers."""
    return F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8L * (10L + (90L * n * {documents}L) div {max(1, terms)}L)))")


def kth(sums: DataFrame, k: int, of: str) -> DataFrame:
    """(item, kth): the k-th greatest value of each item; items of fewer values have none."""
    best = Window.partitionBy("item").orderBy(F.desc(of), "row")
    return sums.withColumn("place", F.row_number().over(best)).where(f"place <= {k}").where(f"place = {k}").select("item", F.col(of).alias("kth"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, limit: int | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of the highest score above 0 for each item (item_id, text).

    Equal scores stand by doc_id, null last, then in any order. Null and wordless texts hold no term and aren't counted
    as documents; items without an id or a term find nothing. Repeated rows, and rows that share an id, are documents of
    their own, each with its rank. Texts of any length are read whole; a term of any length counts. Other columns are
    ignored, whatever their names. Empty tables give no rows. Of lists and candidates nothing is cut off, and no list
    has to fit into one task: lists are sorted over all partitions by term and impact, so a long one spans several."""
    wanted = materialize(item_terms(items))
    vocabulary = materialize(wanted.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    index = materialize(document_terms(docs, vocabulary, limit))
    counted = index.where("t IS NULL AND n > 0").agg(F.count("*"), F.sum("n")).first()
    documents, terms = counted[0], counted[1] or 0
    df = index.where("t IS NOT NULL").groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = materialize(df.select("t", weight.alias("w")).where("w > 0"))
    numbers = materialize(wanted.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()))
    named = lookup(wanted.join(vocabulary, "term").select("item_id", "t"), weights, ["t"], ["item_id"], limit)
    asked = materialize(named.join(numbers, "item_id").select("item", "t"))

    # the lists: by term, then from the greatest impact down
    scored = lookup(index.where("t IS NOT NULL"), weights, ["t"], ["row"], limit).select("t", impact(documents, terms).alias("s"), "row").where("s > 0")
    lists = materialize(scored.repartitionByRange("t", F.desc("s"), "row").sortWithinPartitions("t", F.desc("s"), "row"))

    def exact(pairs: DataFrame) -> DataFrame:
        """pairs (item, row) with doc_id and score: all of a document's impacts in the lists of the item."""
        rows = materialize(pairs.select("row").distinct())
        scratch.append(rows)
        own = lookup(index.where("t IS NOT NULL"), rows, ["row"], ["t"], limit)
        impacts = lookup(own, weights, ["t"], ["row"], limit).select("row", "doc_id", "t", impact(documents, terms).alias("s"))
        return impacts.join(pairs.join(asked, "item"), ["row", "t"]).groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("s").alias("score"))

    # 1: heads, and a bound from the documents that they speak for
    scratch = []
    first = Window.partitionBy("t").orderBy(F.desc("s"), "row")
    heads = materialize(lists.withColumn("place", F.row_number().over(first)).where(f"place <= {k * HEAD}").select("t", "s", "row", "place"))
    partial = lookup(asked, heads, ["t"], ["item"], limit).groupBy("item", "row").agg(F.sum("s").alias("s"))
    promising = materialize(partial.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"), "row"))).where(f"place <= {k}").select("item", "row"))
    bounds = kth(exact(promising), k, "score").withColumnRenamed("kth", "low")

    # 2: the level num / den of each item; lists below the threshold num / cut aren't read and hold `rest` at most
    tops = lookup(asked, heads.where("place = 1").select("t", F.col("s").alias("top")), ["t"], ["item"], limit)
    rising = Window.partitionBy("item").orderBy("top", "t")
    levels = tops.join(bounds, "item", "left").select("item", "t", "top", F.coalesce("low", F.lit(0)).alias("low"))
    levels = levels.withColumn("below", F.coalesce(F.sum("top").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    levels = levels.withColumn("den", F.count("*").over(Window.partitionBy("item")) - F.row_number().over(rising) + 1).withColumn("num", F.col("low") - F.col("below"))
    level = levels.where("num <= top * den").groupBy("item").agg(F.min_by(F.struct("low", "num", (F.col("den") * PART).alias("cut")), F.struct("top", "t")).alias("l")).select("item", "l.*")
    ranked = materialize(tops.join(level, "item"))
    needed = materialize(ranked.where("top * cut >= num").select("item", "t", "num", "cut"))
    least = materialize(needed.groupBy("t").agg(F.min(F.expr("(num + cut - 1) div cut")).alias("least")))
    limits = ranked.groupBy("item").agg(F.first("low").alias("low"), F.first("num").alias("num"), F.first("cut").alias("cut"), F.count_if(F.expr("top * cut >= num")).alias("lists"), F.sum(F.when(F.expr("top * cut < num"), F.col("top")).otherwise(0)).alias("rest"))
    limits = materialize(limits)
    # a posting travels once, to its document; there it counts for every item that it reaches
    reached = lookup(lists, least, ["t"], ["row"], limit).where("s >= least").select("t", "s", "row").repartition("row")
    fetched = lookup(reached, needed, ["t"], ["row"], limit).where("s * cut >= num")
    sums = lookup(fetched.groupBy("item", "row").agg(F.sum("s").alias("s"), F.count("*").alias("seen")), limits, ["item"], ["row"], limit)
    reach = "(s + rest) * cut + (lists - seen) * num >= {} * cut"
    likely = materialize(sums.where(reach.format("low")).select("item", "row", "s", "seen"))
    bar = limits.join(kth(likely, k, "s"), "item", "left").withColumn("bar", F.greatest("low", F.coalesce("kth", F.lit(0))))
    candidates = materialize(lookup(likely, materialize(bar.drop("low", "kth")), ["item"], ["row"], limit).where(reach.format("bar")).select("item", "row"))

    # 3: exact scores
    found = exact(candidates).where("score > 0")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))).where(f"rank <= {k}")
    out = materialize(best.join(numbers, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    discard(wanted, vocabulary, index, weights, numbers, asked, lists, heads, promising, ranked, needed, least, limits, likely, candidates, *scratch)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM w WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM w) SEMI JOIN q USING (term) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), g),
s AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM p JOIN v USING (term) JOIN q USING (term), g GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
