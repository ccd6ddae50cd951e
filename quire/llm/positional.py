"""Positional inverted index on DataFrames: rare terms of phrases, their postings, and aligned matches.

Everything is built-in functions. A posting is (doc, position, term) with the words around it, and only terms that
some phrase needs are posted: for each phrase its rarest terms by count over the whole corpus. Two posting lists meet
on (doc, position - offset); what survives is compared with the phrase word by word, so matches are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fits, lookup, materialize, spread_join

#: What separates words: everything in ASCII but digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: What tells rows apart: the id with 0 for null, and row_key().
KEYS = ("d", "k")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text as written; null and wordless texts have none."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(F.length(cut) > 0, F.split(cut, NOT_WORD, -1)).otherwise(F.array().cast("array<string>"))


def folded(text: Column) -> Column:
    """Lower-cases A-Z only. Terms are looked up by lower(), which folds more and is quicker; matches are then held
    against this exact form, and lower() moves no word boundary."""
    return F.translate(text, UPPER, LOWER)


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n): occurrences in docs (KEYS, words) of the terms of vocabulary (term); terms that don't occur have 0.

    A vocabulary that may be broadcast leaves only its own terms to count; beyond that all terms are counted, map-side
    first, and a term's count meets the vocabulary, not each of its occurrences."""
    every = docs.select(F.explode("words").alias("word")).select(F.lower("word").alias("term"))
    if fits(vocabulary):
        every = every.join(F.broadcast(vocabulary), "term")
    found = every.groupBy("term").agg(F.count("*").alias("n"))
    return vocabulary.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchor_terms(anchored: DataFrame) -> DataFrame:
    """(term, rare): the terms to post; rare if some phrase has it as its rarest, so that the words around it are needed."""
    return anchored.select(F.col("t1").alias("term"), F.lit(True).alias("rare")).union(anchored.select("t2", F.lit(False))).groupBy("term").agg(F.max("rare").alias("rare"))


def phrases_with_anchors(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, size, text, o1, t1, o2, t2): the offsets and terms of the two rarest words of each phrase (phrase, words).

    Ties go to the smaller offset. A phrase of one word has o2 = o1."""
    terms = lookup(phrases.select("phrase", F.posexplode("words").alias("offset", "word")).withColumn("term", F.lower("word")), counts, ["term"], ["phrase", "offset"])
    ranked = terms.withColumn("k", F.row_number().over(Window.partitionBy("phrase").orderBy("n", "offset"))).where("k <= 2")
    both = ranked.groupBy("phrase").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("offset", "term")])
    return phrases.join(both, "phrase").select(
        "phrase", F.size("words").alias("size"), folded(F.array_join("words", " ")).alias("text"), F.col("offset1").alias("o1"), F.col("term1").alias("t1"),
        F.coalesce("offset2", "offset1").alias("o2"), F.coalesce("term2", "term1").alias("t2"),
    )


def postings(docs: DataFrame, terms: DataFrame, before: int, after: int, keys: tuple[str, ...] = KEYS, wide: Column | None = None) -> DataFrame:
    """The index: (keys, term, pos, ctx_from, ctx) for each occurrence of a term of `terms` (term) in docs (keys, words).

    ctx has the words from position ctx_from = max(0, pos - before) to pos + after; with `wide`, a condition on the
    columns of terms, only where it holds. Rows of docs with equal keys hold equal words; they may give their postings once.
    Terms that may not be broadcast are joined without the words around them."""
    wide = F.lit(True) if wide is None else wide
    if fits(terms):
        at = docs.select(*keys, "words", F.posexplode("words").alias("pos", "word")).withColumn("term", F.lower("word")).join(F.broadcast(terms), "term").withColumn("wide", wide)
    else:  # words meet the terms without their text; the places found go back to it, a document at a time
        every = docs.select(*keys, F.posexplode("words").alias("pos", "word")).select(*keys, "pos", F.lower("word").alias("term"))
        met = spread_join(every, terms, ["term"], by=[*keys, "pos"]).groupBy(*keys).agg(F.collect_set(F.struct("term", "pos", wide.alias("wide"))).alias("met"))
        at = docs.groupBy(*keys).agg(F.first("words").alias("words")).join(met, list(keys)).select(*keys, "words", F.explode("met").alias("m")).select(*keys, "words", "m.*")
    first = F.greatest(F.lit(0), F.col("pos") - before)
    ctx = F.slice("words", first + 1, F.col("pos") + after + 1 - first)
    return at.select(*keys, "term", "pos", first.alias("ctx_from"), F.when(F.col("wide"), ctx).alias("ctx"))


def aligned(index: DataFrame, anchored: DataFrame, slop: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, phrase, start, size, text, ctx_from, ctx): where the lists of a phrase's two rarest terms meet.

    start is the document position less the offset in the phrase. Both lists have to give the same start, or with
    slop, starts at most that many words apart (the rarest term's start counts). The lists are joined on their places,
    so no term's or document's list has to fit into one task, and without the words around them; those are looked up
    where the lists have met."""
    a = anchored.select("phrase", F.col("o1").alias("offset"), F.col("t1").alias("term"))
    b = anchored.select("phrase", F.col("o2").alias("offset"), F.col("t2").alias("term"))
    places = index.select(*keys, "term", "pos")
    start = (F.col("pos") - F.col("offset")).alias("start")
    first = lookup(places, a, ["term"], [*keys, "pos"]).select(*keys, "term", "pos", "phrase", start)
    second = lookup(places, b, ["term"], [*keys, "pos"]).select(*keys, "phrase", start)
    if slop:  # the rarest terms' side has fewer rows, so that is the one to shift
        first = first.withColumn("other", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)))
        second = second.withColumnRenamed("start", "other")
    both = first.join(second, [*keys, "phrase", "other" if slop else "start"], "left_semi").select(*first.drop("other").columns).distinct()
    met = lookup(materialize(both), anchored.select("phrase", "size", "text"), ["phrase"], [*keys, "start"])
    return index.where(F.col("ctx").isNotNull()).join(met, [*keys, "term", "pos"]).select(*keys, "phrase", "start", "size", "text", "ctx_from", "ctx")


def _here(begin: Column, size: Column) -> Column:
    """`size` words of the context from document position `begin` on; fewer where it ends."""
    return F.slice("ctx", F.greatest(F.lit(1), begin - F.col("ctx_from") + 1), size)


def exact_matches(met: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, phrase, start, size): where all words of a phrase stand consecutively; met: aligned().

    Where the two rarest terms' lists meet, the words around the rarest have to equal the phrase. The context has to
    reach as far as the phrase does on either side of that term."""
    same = folded(F.array_join(_here(F.col("start"), F.col("size")), " ")) == F.col("text")
    return met.where((F.col("start") >= F.col("ctx_from")) & same).select(*keys, "phrase", "start", "size").distinct()


def proximity_matches(met: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, phrase, start, size): where all words of a phrase stand in order with one other word put in between them.

    met is aligned() with a slop of 1. The word put in may stand before the rarest, so the phrase starts there or one
    place earlier, and every word but the one put in has to equal the phrase. The context has to reach one word further
    than the phrase does."""
    at = met.where("size > 1").withColumn("start", F.explode(F.array(F.col("start") - 1, F.col("start")))).where(F.col("start") >= F.col("ctx_from"))
    seen = at.withColumn("seen", F.split(folded(F.array_join(_here(F.col("start"), F.col("size") + 1), " ")), " ")).where(F.size("seen") == F.col("size") + 1)
    without = lambda i: F.array_join(F.concat(F.slice("seen", F.lit(1), i), F.slice("seen", i + 2, F.col("size") - i)), " ")
    return seen.where(F.exists(F.sequence(F.lit(1), F.col("size") - 1), lambda i: without(i) == F.col("text"))).select(*keys, "phrase", "start", "size").distinct()
