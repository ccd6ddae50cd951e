"""Document properties, page changes and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens


def complexity(n_segments: Column, pages: Column) -> Column:
    ratio = n_segments / F.greatest(F.lit(1), pages)
    return F.when(ratio < 15, "low").when(ratio <= 45, "medium").otherwise("high")


def status(done: Column, total: Column) -> Column:
    return F.when((total > 0) & (done >= total), "full").when(done > 0, "partial").otherwise("none")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(F.lit(0.0))


def document_properties(segments: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document of segments (key, seg_id, page_idx, text); done (key, seg_id, translated), distinct by segment."""
    joined = segments.join(done.select(key, "seg_id", "translated"), [key, "seg_id"], "left")
    totals = joined.groupBy(key).agg(
        F.coalesce(F.max("page_idx") + 1, F.lit(1)).alias("total_pages"), F.count("*").alias("total_segments"), F.count("translated").alias("done_segments"),
        F.sum(estimate_tokens(F.col("text"))).alias("input_tokens"), F.sum(F.when(F.col("translated").isNotNull(), estimate_tokens(F.col("translated"))).otherwise(0)).alias("output_tokens"),
    )
    return totals.withColumn("complexity", complexity(F.col("total_segments"), F.col("total_pages"))).withColumn("status", status(F.col("done_segments"), F.col("total_segments")))


def page_changes(members: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, batch_no, page_idx, page_changed) by the first segment of each batch; the first batch is a change."""
    first = members.groupBy(key, "batch_no").agg(F.min_by("page_idx", "pos_in_batch").alias("page_idx"))
    before = F.lag("page_idx").over(Window.partitionBy(key).orderBy("batch_no"))
    return first.withColumn("page_changed", before.isNull() | (before != F.col("page_idx")))


def progress(events: DataFrame, key: str, total: Column, order: list[str], ts: str = "ts") -> DataFrame:
    """events with done, percent, speed (rows a second since the first) and eta_mins, eta_secs."""
    w = Window.partitionBy(key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("done", F.count("*").over(run)).withColumn("total", total)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    elapsed = (micros - F.min(micros).over(run)) / 1e6
    out = out.withColumn("percent", percent(F.col("done"), F.col("total"))).withColumn("speed", F.col("done") / F.greatest(elapsed, F.lit(0.1)))
    left = F.greatest(F.lit(0), F.col("total") - F.col("done")) / F.greatest(F.col("speed"), F.lit(0.001))
    return out.withColumn("eta_mins", F.floor(left / 60).cast("long")).withColumn("eta_secs", F.floor(left - F.floor(left / 60) * 60).cast("long"))
