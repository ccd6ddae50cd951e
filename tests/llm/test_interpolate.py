"""Deleted interpolation against plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import interpolate

random.seed(12)
END = "\n"


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def padded(text, order):
    return ["\t"] * (order - 1) + words_of(text)


def counts_of(texts, order):
    """[{n-gram: count} for each order], [{context: count} for each order]"""
    grams, contexts = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for t in texts:
        w = padded(t, order)
        for i in range(order - 1, len(w)):
            for k in range(order):
                grams[k][tuple(w[i - k : i + 1])] += 1
                contexts[k][tuple(w[i - k : i])] += 1
    return grams, contexts


def level(x):
    return x.bit_length()


def probability(weights, f, x, types):
    p = 1 / (types + 1)
    for k in range(len(f)):
        w = weights[k][level(x[k])] if k else weights[0][0]
        p = w * f[k] + (1 - w) * p
    return p


def slow_weights(fold, grams, contexts, order, types):
    weights = [[0.5] * interpolate.LEVELS for _ in range(order)]
    for w in weights[1:]:
        w[0] = 0
    events = []
    for t in fold:
        w = padded(t, order)
        for i in range(order - 1, len(w)):
            x = [contexts[k][tuple(w[i - k : i])] for k in range(order)]
            events.append((x, [grams[k][tuple(w[i - k : i + 1])] / x[k] if x[k] else 0.0 for k in range(order)]))
    for _ in range(interpolate.ROUNDS):
        won, tried = defaultdict(float), defaultdict(float)
        for x, f in events:
            below, p = 1 / (types + 1), []
            for k in range(order):
                w = weights[k][level(x[k]) if k else 0]
                below = w * f[k] + (1 - w) * below
                p.append(below)
            came = 1.0
            for k in reversed(range(order)):
                b = level(x[k]) if k else 0
                r = weights[k][b] * f[k] / p[k]
                won[k, b] += came * r
                tried[k, b] += came
                came *= 1 - r
        new = [[(won[k, b] + 0.5) / (tried[k, b] + 1) for b in range(interpolate.LEVELS)] for k in range(order)]
        for k in range(order):
            for b in range(1, interpolate.LEVELS):
                if not tried[k, b]:
                    new[k][b] = new[k][b - 1] if b > 1 else 0.5
            if k:
                new[k][0] = 0
        change = max(abs(a - b) for k in range(order) for a, b in list(zip(new[k], weights[k]))[: interpolate.LEVELS if k else 1])
        weights = new
        if change <= interpolate.SETTLED:
            break
    return weights


def slow_scores(rows, fold_of, order):
    train = [zlib.crc32(str("" if d is None else d).encode()) % 7 != 2 for d, _ in rows]
    learn = [t for (_, t), x in zip(rows, train) if x]
    grams, contexts = counts_of(learn, order)
    rest = counts_of([t for t in learn if not fold_of[t or ""]], order)
    n, v = sum(grams[0].values()), len(grams[0])
    weights = slow_weights([t for t in learn if fold_of[t or ""]], *rest, order, v)
    out = []
    for (d, text), x in zip(rows, train):
        w = padded(text, order)
        score = base = known = 0
        for i in range(order - 1, len(w)):
            c = [grams[k][tuple(w[i - k : i + 1])] for k in range(order)]
            xs = [contexts[k][tuple(w[i - k : i])] for k in range(order)]
            base += math.log10((c[0] + 1) / (n + v + 1))
            known += c[0] > 0
            score += math.log10(probability(weights, [a / b if b else 0 for a, b in zip(c, xs)], xs, v))
        out.append((d, not x, len(w) - order + 1, known, n, base, score))
    return out, weights


def corpus(n):
    words = [f"w{i}" for i in range(60)] + ["É", "ABC", "x\x1cy"]
    pick = lambda a: words[(a * 7 + random.choice([1, 2, 3, 30])) % len(words)]
    rows = []
    for i in range(n):
        t, a = [], random.randrange(60)
        for _ in range(random.randint(0, 40)):
            a = words.index(pick(a))
            t.append(words[a])
        rows.append((i, random.choice([" ", "\n", " \t "]).join(t) + random.choice(["", " "])))
    return rows + [(i + n, rows[7][1]) for i in range(20)] + [(3, rows[3][1])] * 2 + [(None, "w1 w2"), (None, None), (5, "another text of five"), (n + 50, " \t "), (n + 51, "never seen words only")]


@pytest.mark.parametrize("order,chunk,bucket", [(2, 6 << 20, 2_500_000), (2, 900, 100), (1, 900, 300), (3, 2000, 500)])
def test_scores_equal_the_loop(spark, monkeypatch, order, chunk, bucket):
    monkeypatch.setattr(interpolate, "CHUNK", chunk)
    monkeypatch.setattr(interpolate, "BUCKET", bucket)
    rows = corpus(250)
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, chunk string, n_tokens int, train boolean").repartition(3)
    hashed = spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "text string")
    fold_of = {r[0]: r[1] for r in hashed.select("text", interpolate.in_fold(F.col("text"))).collect()}
    assert 5 < sum(fold_of[t or ""] for _, t in rows) < 60
    want, weights = slow_scores(rows, fold_of, order)
    got = [tuple(r) for r in interpolate.score_texts(docs, interpolate.seventh() != 2, order).collect()]
    key = lambda r: (str(r[0]), r[2], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    if order == 2:  # words follow words here, so contexts help; and what a context leaves sums to one
        held = [r for r in want if r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held) and 0.2 < max(weights[1]) < 1
        grams, contexts = counts_of([t for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2], 2)
        n, v = sum(grams[0].values()), len(grams[0])
        for context in [*list(contexts[1])[:5], ("unseen",)]:
            x = contexts[1][context]
            each = [probability(weights, [grams[0][w] / n, grams[1][context + w] / x if x else 0], [n, x], v) for w in grams[0]]
            assert sum(each) + probability(weights, [0, 0], [n, x], v) == pytest.approx(1)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = interpolate.score_texts(docs, F.lit(False))
    assert sorted(tuple(r) for r in none.collect()) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    empty = interpolate.score_texts(docs.limit(0), F.lit(True))
    assert empty.count() == 0 and empty.columns == none.columns


def test_very_long_text(spark):
    """A text of 12 MB, beyond a chunk, whose every word counts."""
    long = "Some words GO on " * 750_000 + "last"
    docs = spark.createDataFrame([(1, long), (2, "some last"), (3, "go go")], "doc_id long, text string")
    got = {r.doc_id: r for r in interpolate.score_texts(docs, F.col("doc_id") == 1).collect()}
    assert got[1].n_tokens == got[1].n_known == got[1].train_tokens == 3_000_002 and not got[1].held_out
    n, v = 3_000_002, 6
    assert got[2].base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in (750_000, 1, 1)))
    assert got[3].n_known == 3 and got[1].base_score == pytest.approx(4 * 750_000 * math.log10(750_001 / (n + v + 1)) + 2 * math.log10(2 / (n + v + 1)))


def test_packing():
    v = np.array([0, 1, 255, 256, 2**63 + 5, 2**64 - 1], np.uint64)
    assert interpolate.unpacked(interpolate.packed(v)).tolist() == v.tolist()
    assert interpolate.level(np.array([0, 1, 2, 3, 4, 2**40])).tolist() == [0, 1, 2, 2, 3, 41]


def test_base_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(interpolate.BASE_SQL).fetchall())
    got = interpolate.lm_base(spark, "/root/testdata/sf0.001").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    assert sorted(tuple(r) for r in got.collect()) == want and want
