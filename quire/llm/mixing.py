"""Mixing sources to target weights by soft domain membership.

A classifier learnt from the labelled table gives each document its posterior over domains. Document rates r >= 0 then
minimise the squared distance between the expected tokens of each domain, sum(r * tokens * posterior), and its target,
by projected gradient steps with momentum. A step needs one distributed sum for each domain; a document's rate follows
from its posterior and the list of steps, so no state is kept by document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import ngrams
from .common import CLASSES, bounded_rows, map_texts, materialize, row_key, table
from .rules import sample_vectors

#: Target shares of the expected tokens. Domains that aren't listed keep their tokens.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
#: Labelled rows of each domain, and of all domains, that the classifier learns from, at most.
SAMPLE, SAMPLE_OF_ALL = 600, 6000
#: Posteriors are rounded to this many decimals, so that documents of one profile share a rate.
DECIMALS = 3
ROUNDS, CLOSE = 60, 1e-3
#: The steps end where PATIENCE of them don't bring the squared distance below this share of what it was.
PATIENCE, GAIN = 5, 0.9
#: The targets count as met if no domain misses its tokens by more than this share of the largest target.
MET = 0.01
WHOLE = 0.95


class DomainModel:
    """Posterior over the domains of the labelled rows; uniform if there are none.

    The regression learns on four fifths of the rows, and the rest calibrates how sharp its posteriors are."""

    def __init__(self, vectors: list, domains: list[str]):
        self.domains = sorted(set(domains)) or ["all"]
        self.weights, self.bias = np.zeros((ngrams.SIZE, len(self.domains)), np.float32), np.zeros(len(self.domains), np.float32)
        if len(self.domains) > 1:
            at = {d: i for i, d in enumerate(self.domains)}
            y = np.array([at[d] for d in domains])
            rest = np.arange(len(y)) % 5 == 0
            if len(set(y[~rest].tolist())) < len(self.domains):
                rest[:] = False
            w, b = ngrams.fit_softmax(ngrams.dense([vectors[i] for i in np.flatnonzero(~rest)]), y[~rest], len(self.domains), rounds=80)
            logits = [vectors[i][1] @ w[vectors[i][0]] + b for i in np.flatnonzero(rest)]
            sharp = ngrams.temperature(np.array(logits).reshape(-1, len(self.domains)), y[rest])
            self.weights, self.bias = w * np.float32(sharp), b * np.float32(sharp)

    def __call__(self, text: str) -> np.ndarray:
        ids, values = ngrams.vector(text)
        z = values @ self.weights[ids] + self.bias
        p = np.exp(z - z.max())
        p = np.round(p / p.sum(), DECIMALS)
        p[p.argmax()] += 1 - p.sum()
        return np.round(p, DECIMALS)


def train(docs: DataFrame, labels: DataFrame, domain: str = "lang", per_domain: int = SAMPLE) -> DomainModel:
    """Learns from rows of docs that the labelled table knows, at most `per_domain` of each domain, by id hash.

    Rows without a domain, and ids that stand with two, are left out. More than CLASSES domains are refused."""
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = docs.where(F.col(domain).isNotNull()).select("doc_id", F.col(domain).cast("string").alias("domain")).join(known, "doc_id").groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
    rows = materialize(rows.where("domain = other").select("doc_id", "domain"))
    names = sorted(r["domain"] for r in rows.select("domain").distinct().limit(CLASSES + 1).collect())
    if len(names) > CLASSES:
        raise ValueError(f"more than {CLASSES} domains to learn from")
    if not names:
        return DomainModel([], [])
    code = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col("domain")]
    sample = bounded_rows(docs, rows.select("doc_id", code.cast("int").alias("y")), max(2, min(per_domain, SAMPLE_OF_ALL // len(names))))
    vectors, y = sample_vectors(sample)
    return DomainModel(vectors, [names[i] for i in y])


def with_posteriors(docs: DataFrame, model: DomainModel, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns of docs, n_tokens (words between ASCII blanks) and posterior (array, in the order of model.domains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.select(*keep).schema.fields, StructField("n_tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))])

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        return {
            **{f"k{i}": batch.column(c) for i, c in enumerate(keep)}, "n_tokens": [len(t.encode("utf-8", "surrogatepass").split()) for t in texts],
            "posterior": [shared.value(t).astype(float).tolist() for t in texts],
        }

    return map_texts(docs, list(dict.fromkeys([*keep, text])), schema, run)


class Plan:
    """The steps that lead from rate 1 to the target tokens; rate() gives a document's rate from its posterior."""

    def __init__(self, scored: DataFrame, domains: list[str], targets: dict[str, float], rounds: int = ROUNDS, close: float | None = None, least: float = 0.0):
        """scored: (posterior, n_tokens). A domain that has tokens and a target of 0 gets rates of 0, as far as its
        documents belong to it alone; `met` says whether the targets were reached. No rate is below `least`.

        Steps end once every domain is within `close` of its tokens, as a share of the largest target: CLOSE, or with a
        bound MET, as the bound leaves no exact solution to go on to."""
        close = close if close is not None else MET if least else CLOSE
        self.domains, self.steps, self.least = domains, [], least
        profiles = materialize(scored.groupBy("posterior").agg(F.sum("n_tokens").alias("n")).where("n > 0"))
        now = np.array(self._totals(profiles))[: len(domains)]
        self.before = dict(zip(domains, now.tolist(), strict=True))
        weights = np.array([targets.get(d, np.nan) for d in domains], float)
        listed = ~np.isnan(weights) & (now > 0) & (np.nan_to_num(weights) > 0)
        goal = now.copy()
        goal[~np.isnan(weights) & ~listed] = 0
        if listed.any():
            shares = weights[listed] / weights[listed].sum()
            goal[listed] = shares * (now[listed] / shares).max()  # the smallest total that needs no rate below 1
        self.target = dict(zip(domains, goal.tolist(), strict=True))
        scale = np.where(now > 0, now, 1.0)
        ahead, losses = now, []
        for i in range(rounds):
            losses.append(float(((now - goal) ** 2 / scale).sum()))
            if np.abs(now - goal).max() <= close * max(1.0, goal.max()) or (i >= PATIENCE and losses[-1] > GAIN * losses[-1 - PATIENCE]):
                break
            self.steps.append((((ahead - goal) / scale).tolist(), i / (i + 3)))
            both = np.array(self._totals(profiles)).reshape(2, -1)
            now, ahead = both
        self.after = dict(zip(domains, now.tolist(), strict=True))
        self.met = bool(np.abs(now - goal).max() <= MET * max(1.0, goal.max()))

    def _state(self) -> Column:
        """The rate, and the point ahead of it from which the next step starts."""
        steps = F.array(*[F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(float(m)).alias("m")) for g, m in self.steps])
        move = lambda g: F.aggregate(F.zip_with(g, F.col("posterior"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

        def step(a: Column, s: Column) -> Column:
            new = F.greatest(F.lit(float(self.least)), a["ahead"] - move(s["g"]))
            return F.struct(new.alias("rate"), (new + s["m"] * (new - a["rate"])).alias("ahead"))

        return F.aggregate(steps, F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead")), step)

    def rate(self) -> Column:
        return self._state()["rate"] if self.steps else F.lit(1.0)

    def _totals(self, profiles: DataFrame) -> list[float]:
        """The tokens of each domain at the rates, and then at the points ahead of them."""
        start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
        rated = profiles.withColumn("s", self._state() if self.steps else start)
        parts = [F.sum(F.col("n") * F.col("s")[c] * F.col("posterior")[i]).alias(f"{c}{i}") for c in ("rate", "ahead") for i in range(len(self.domains))]
        return [float(x or 0) for x in rated.agg(*parts).first()]


def copies(rate: Column, key: Column) -> Column:
    """Whole copies with the rate as their mean; the fraction is drawn by a hash of the row.

    Soft membership leaves rates just under 1 in a domain that keeps all its tokens; from WHOLE on they count as 1."""
    drawn = F.floor(rate + F.pmod(key, F.lit(1_000_003)) / 1_000_003.0).cast("int")
    return F.when(rate >= WHOLE, F.greatest(drawn, F.lit(1))).otherwise(drawn)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang", least: float = 0.0) -> DataFrame:
    """docs with n_tokens, rate and copies; rows that get no copy go. Documents are scored once, into a written table.

    With least = 1 no row goes: what is rare is repeated, as far as that brings the shares to their targets.

    Null and empty texts have no tokens, don't sway the fit and get the rate of their posterior. Without labelled rows
    there is one domain and every rate is 1. Repeated rows get the same rate; an empty table gives no rows. Columns of
    docs named n_tokens, rate or copies are replaced; all others come through, whatever their names."""
    keep = [c for c in docs.columns if c not in ("n_tokens", "rate", "copies")]
    model = train(docs, labels, domain)
    plain = [f"c{i}" for i in range(len(keep))]  # whatever the columns are called
    named = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(keep, plain, strict=True)], row_key("doc_id", "text").alias("key"))
    scored = materialize(with_posteriors(named, model, [*plain, "key"], plain[keep.index("text")]))
    plan = Plan(scored.select("posterior", "n_tokens"), model.domains, targets or TARGETS, least=least)
    out = scored.withColumn("rate", plan.rate()).withColumn("copies", copies(F.col("rate"), F.col("key")))
    return out.where("copies > 0").select(*[F.col(p).alias(c) for c, p in zip(keep, plain, strict=True)], "n_tokens", "rate", "copies")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    scored = materialize(with_posteriors(docs.withColumn("key", row_key("doc_id", "text")), model, ["doc_id", "key"]))
    plan = Plan(scored, model.domains, TARGETS)
    names = F.array(*map(F.lit, model.domains))
    best = F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    out = scored.withColumn("rate", plan.rate())
    return out.select("doc_id", "n_tokens", best.alias("domain"), "posterior", "rate", copies(F.col("rate"), F.col("key")).alias("copies"), F.lit(plan.met).alias("targets_met"))
