"""Segments to token-budgeted batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULT_TOKEN_LIMIT, MAX_SEGMENTS, token_limits
from ..functions.text import estimate_tokens, should_translate, thousands


def model_budget(models: DataFrame) -> DataFrame:
    """models (model) with token_limit: the catalogue's, else the default."""
    return models.join(F.broadcast(token_limits(models.sparkSession)), "model", "left").withColumn("token_limit", F.coalesce("token_limit", F.lit(DEFAULT_TOKEN_LIMIT)))


def translatable(segments: DataFrame) -> DataFrame:
    """Segments that are prose, with their tokens. Built-in predicates, so the filter goes below everything after it."""
    return segments.where(should_translate(F.col("text"))).withColumn("tokens", estimate_tokens(F.col("text")))


def batch_starts(tokens: str, budget: int, max_rows: int) -> Column:
    """Places in an array of token counts at which a batch starts.

    A row joins the batch if the sum stays within the budget and the count within max_rows; a row over the budget
    stands alone. Only starts are collected, so the fold appends once a batch and not once a row."""
    return F.expr(f"""aggregate({tokens},
      named_struct('starts', cast(array() AS array<int>), 'i', 0, 'n', 0, 't', 0L, 'shut', true),
      (a, x) -> CASE
        WHEN NOT a.shut AND x <= {budget} AND a.t + x <= {budget} AND a.n < {max_rows}
          THEN named_struct('starts', a.starts, 'i', a.i + 1, 'n', a.n + 1, 't', a.t + x, 'shut', false)
        ELSE named_struct('starts', concat(a.starts, array(a.i)), 'i', a.i + 1, 'n', 1, 't', cast(x AS bigint), 'shut', x > {budget}) END,
      a -> a.starts)""")


def batches(segments: DataFrame, key: str = "doc_id", order: str = "pos", budget: int = 0, max_rows: int = MAX_SEGMENTS) -> DataFrame:
    """(key, batch_no, segments, n_segments, estimated_tokens): batches of the prose of each document, in order.

    segments: (key, order, seg_id, text, page_idx). budget 0 means the default. One shuffle, on the key; the unit of
    memory is one document's segments, as each batch depends on the one before."""
    rows = translatable(segments).select(key, F.struct(F.col(order).alias("ord"), F.col("seg_id").alias("id"), "text", "page_idx", "tokens").alias("s"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("all"))
    listed = listed.withColumn("starts", batch_starts("transform(all, s -> s.tokens)", budget or DEFAULT_TOKEN_LIMIT, max_rows))
    # every row has a start; the outer form keeps Catalyst from checking that by a second fold
    cut = listed.select(key, "all", "starts", F.posexplode_outer("starts").alias("batch_no", "first"))
    size = F.coalesce(F.get("starts", F.col("batch_no") + 1), F.size("all")) - F.col("first")
    out = cut.select(key, "batch_no", F.slice("all", F.col("first") + 1, size).alias("segments"))
    return out.withColumn("n_segments", F.size("segments").cast("long")).withColumn("estimated_tokens", F.expr("aggregate(segments, 0L, (a, s) -> a + s.tokens)"))


def members(batched: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, batch_no, pos_in_batch, seg_id, page_idx, text, tokens): one row for each batched segment."""
    return batched.select(key, "batch_no", F.posexplode("segments").alias("pos_in_batch", "s")).select(key, "batch_no", "pos_in_batch", F.col("s.id").alias("seg_id"), "s.page_idx", "s.text", "s.tokens")


def batch_ids() -> Column:
    """The ids of a batch, in order."""
    return F.transform("segments", lambda s: s["id"])


def summary(batched: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_batches, n_segments, n_tokens, lines): a plan's totals and one line for each batch."""
    line = F.format_string("Batch %02d : %d segment(s), ~%s tokens", F.col("batch_no") + 1, F.col("n_segments"), thousands(F.col("estimated_tokens")))
    return batched.withColumn("line", line).groupBy(key).agg(
        F.count("*").alias("n_batches"), F.sum("n_segments").alias("n_segments"), F.sum("estimated_tokens").alias("n_tokens"), F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY batch_no)").alias("lines")
    )
