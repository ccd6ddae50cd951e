"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy traversal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats
from .common import held_out, labelled_sample, map_texts, table

#: Labelled rows of each class that the trees learn from, at most.
SAMPLE = 6000
CUT = 0.3
BINS, ROUNDS, DEPTH, RATE, LEAST, L2 = 48, 80, 4, 0.1, 8.0, 1.0


class BoostedTrees:
    """Binary classifier. Trees are complete: node k has children 2k+1 and 2k+2, and all trees share three arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        n, width = x.shape if x.size else (0, len(stats.FEATURES))
        inner = 2**depth - 1
        self.depth, self.bias = depth, 0.0
        self.feature = np.zeros((0, inner), np.int64)
        self.cut = np.zeros((0, inner))
        self.value = np.zeros((0, inner + 1))
        if not n or len(set(y.tolist())) < 2:
            self.bias = 3.0 if not n or y[0] else -3.0
            return
        share = float(y.mean())
        self.bias = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        raw = np.full(n, self.bias)
        trees = []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            trees.append(self._grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6), bins, depth, rate))
            self.feature, self.cut, self.value = (np.stack(z) for z in zip(*trees[-1:], strict=True))
            raw += self._sum(x)
        self.feature, self.cut, self.value = (np.stack(z) for z in zip(*trees, strict=True))

    @staticmethod
    def _grow(binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray, bins: int, depth: int, rate: float) -> tuple:
        inner, width = 2**depth - 1, binned.shape[1]
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            gains = np.full((many, width, bins), -np.inf)
            at = (node - first) * bins
            for f in range(width):
                if not len(edges[f]):
                    continue
                sg = np.bincount(at + binned[:, f], g, many * bins).reshape(many, bins)
                sh = np.bincount(at + binned[:, f], h, many * bins).reshape(many, bins)
                gl, hl = sg.cumsum(axis=1), sh.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = -np.inf
                gains[:, f, : len(edges[f])] = gain[:, : len(edges[f])]
            flat = gains.reshape(many, -1)
            best = flat.argmax(axis=1)
            for k in range(many):
                if flat[k, best[k]] > 1e-6:
                    f, b = divmod(int(best[k]), bins)
                    feature[first + k], cut[first + k] = f, edges[f][b]
            here = node
            thresholds = np.array([bins if np.isinf(c) else int(np.searchsorted(edges[f], c)) for f, c in zip(feature, cut, strict=True)])
            left = binned[np.arange(len(g)), feature[here]] <= thresholds[here]
            node = np.where(left, 2 * here + 1, 2 * here + 2)
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        return feature, cut, value

    def _sum(self, x: np.ndarray) -> np.ndarray:
        inner = 2**self.depth - 1
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return total

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self._sum(x), -30, 30)))


def _features(df: DataFrame, keep: list[str], types: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        rows = [np.asarray(stats.features(t or ""), np.float64).tobytes() for t in batch.column("text").to_pylist()]
        return {**{c: batch.column(c) for c in keep}, "x": pa.array(rows, pa.binary())}

    return map_texts(df, [*keep, "text"], f"{types}, x binary", run)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> BoostedTrees:
    """Trees learnt on at most `per_class` labelled rows of each class, never on held-out ids."""
    got = _features(labelled_sample(docs, labels, "quality", per_class), ["doc_id", "y"], "doc_id long, y int").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, len(stats.FEATURES))
    return BoostedTrees(x, got["y"].to_numpy().astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, per_class: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts are scored on zero statistics. Without labels of both classes every score is the prior.
    Whole texts are read, however long; of equal gains the first statistic splits. Repeated rows come out repeated; extra
    columns are ignored; an empty table gives no rows; a null id counts as the id ''."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array([stats.features(t or "") for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(stats.FEATURES))
        return {"doc_id": batch.column("doc_id"), "score": pa.array(shared.value(x))}

    scored = map_texts(docs, ["doc_id", "text"], "doc_id long, score double", run)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
