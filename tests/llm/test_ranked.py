"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quire.llm import ranked

random.seed(13)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_search(docs, items, k):
    """{item_id: [(doc_id, score)]} of rows (doc_id, text) and (item_id, text)."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = {}
    for i, words in asked.items():
        found = []
        for d, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        if found:
            out[i] = [(None if none else d, -s) for s, none, d in sorted(found)[:k]]
    return out


def collected(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.item_id, r["rank"])):
        out[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return dict(out)


def tables(n, vocabulary, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "Ünï", "x1"]
    text = lambda size: rng.choice([" ", ", ", "\x1c", "-"]).join(rng.choice(words[: rng.randint(1, len(words))]).upper() if rng.random() < 0.1 else rng.choice(words[: rng.randint(1, len(words))]) for _ in range(size))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n)]
    docs += [(i + n, docs[5][1]) for i in range(25)]  # copies: equal scores
    docs += [docs[3], docs[3], (None, docs[4][1]), (None, None), (7, "another text of id seven " + docs[9][1]), (8, ""), (9, " ,. ")]
    items = [(i, text(rng.randint(1, 25))) for i in range(12)] + [(12, docs[5][1]), (12, docs[5][1]), (13, None), (14, ""), (None, "w1 w2"), (1, "w0 w5"), (15, "unheard of")]
    return docs, items


@pytest.mark.parametrize("limit,k,seed", [(None, 10, 1), (3, 10, 2), (None, 1, 3), (None, 500, 4)])
def test_search_equals_all_scores(spark, limit, k, seed):
    docs, items = tables(150, 40, seed)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, row string, t int").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, term string")
    assert collected(ranked.search(d, i, k, limit)) == slow_search(docs, items, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.selectExpr("doc_id", "CAST(NULL AS string) AS text"), items)):
        got = ranked.search(d, i)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_very_long_text(spark):
    """A text of 12 MB and a term of 1 MB are read whole."""
    long = "filler words go on " * 600_000 + "needle " + "z" * 1_000_000
    docs = [(1, long), (2, "needle here"), (3, "nothing of it"), (4, "more of nothing")]
    items = [(1, "needle"), (2, "z" * 1_000_000), (3, "filler needle")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert collected(ranked.search(d, i)) == slow_search(docs, items, 10)


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = sorted(con.execute(ranked.ORACLE).fetchall())
    got = ranked.op13_ranked_search(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want and want
