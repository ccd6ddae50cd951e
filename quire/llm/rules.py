"""Quality rules: base counts and thresholds, and a calibrated n-gram logistic regression for what passes them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import ngrams, stats
from .common import labelled_sample, map_texts, table

#: Labelled rows of each class that the regression learns from, at most.
SAMPLE = 1500
#: Documents below this calibrated probability of quality are dropped.
KEEP_AT = 0.5
#: Fixed thresholds of the calibrated probability, and the bands that they part.
THRESHOLDS = (0.2, KEEP_AT, 0.8)
BANDS = ("junk", "poor", "fair", "good")


def band(probability: float) -> str:
    return BANDS[sum(probability >= t for t in THRESHOLDS)]


def sample_vectors(sample: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Sparse n-gram vectors and labels of a bounded sample (doc_id, text, y), in a fixed order."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [ngrams.vector(t) for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"), "y": batch.column("y"),
            "ids": pa.array([r[0].astype(np.int16).tobytes() for r in rows], pa.binary()), "values": pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary()),
        }

    got = map_texts(sample, ["doc_id", "text", "y"], "doc_id long, y int, ids binary, values binary", run).toPandas()
    got = got.sort_values(["doc_id", "ids", "values"]).reset_index(drop=True)
    return [(np.frombuffer(a, np.int16).astype(np.int64), np.frombuffer(b, np.float32)) for a, b in zip(got["ids"], got["values"], strict=True)], got["y"].to_numpy().astype(np.int64)


class NgramQuality:
    """Probability that a text is of quality. With fewer than two classes to learn from it is the prior."""

    def __init__(self, vectors: list, y: np.ndarray):
        self.weights, self.scale, self.shift = np.zeros(ngrams.SIZE), 0.0, 0.0
        if len(set(y.tolist())) < 2:
            self.shift = 3.0 if not y.size or y[0] else -3.0
            return
        fold = np.arange(len(y)) % 5 == 0
        if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
            fold = np.zeros(len(y), bool)
        w, _ = ngrams.fit_softmax(ngrams.dense([vectors[i] for i in np.flatnonzero(~fold)]), y[~fold], 2)
        self.weights = (w[:, 1] - w[:, 0]).astype(np.float64)
        held = np.flatnonzero(fold if fold.any() else ~fold)
        self.scale, self.shift = ngrams.platt(np.array([vectors[i][1] @ self.weights[vectors[i][0]] for i in held]), y[held])

    def __call__(self, text: str) -> float:
        ids, values = ngrams.vector(text)
        z = self.scale * float(self.weights[ids] @ values) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> NgramQuality:
    return NgramQuality(*sample_vectors(labelled_sample(docs, labels, "quality", per_class)))


def apply_rules(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, per_class: int = SAMPLE) -> DataFrame:
    """Counts, base_failed, kept, probability and band for every row of docs (doc_id, text).

    A row is kept if it passes the base rules and its probability reaches keep_at; band says between which of the
    THRESHOLDS the probability lies. Whole texts are counted and scored, however long. Null texts have no words and fail. The regression learns from at most `per_class` labelled rows of each class,
    never from held-out ids; an empty or one-sided label table leaves the base rules alone to decide. Repeated rows
    come out repeated; extra columns are ignored; an empty table gives no rows."""
    model = train(docs, labels, per_class)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        score = shared.value
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            c = stats.base_counts(text)[2]
            failed, p = stats.base_failed(c), score(text)
            rows.append((c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], failed, not failed and p >= keep_at, p, band(p)))
        columns = list(zip(*rows, strict=True)) or [()] * 9
        return {"doc_id": batch.column("doc_id"), **{f"c{i}": list(x) for i, x in enumerate(columns)}}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double, band string"
    return map_texts(docs, ["doc_id", "text"], schema, run)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
