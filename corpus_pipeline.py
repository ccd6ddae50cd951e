"""Documents to a training mix: toxicity, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame. All but
the last return the columns of documents, whatever their names. Repeated rows are near-duplicates of each other, so one
stays, and null ids are the last choice; null texts are empty texts: one row without words stays, with its null. Texts
of any length are read whole. An empty table of documents gives an empty result; without labels nothing counts as toxic
and every rate is 1, and without a benchmark nothing is contaminated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, pii, simhash, toxicity
from quire.llm.common import scratch_dir, table

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity operator doesn't reject. The score is computed in the row, so nothing is joined."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that of the smallest doc_id (null last), then of the smallest key."""
    return simhash.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside any benchmark window."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every reported span replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the rate and the number of copies that bring the languages to their target shares; none goes."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), least=1.0)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_targets),
]

#: The stages learn, hash and fit what SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
