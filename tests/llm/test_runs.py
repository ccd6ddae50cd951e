"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quire.llm import runs

random.seed(11)


def slow_runs(s, least, times):
    out = []
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(all(s[k] == s[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence():
    s = [random.randrange(random.randint(1, 5)) for _ in range(random.randint(0, 70))]
    if len(s) > 4 and random.random() < 0.7:
        a = random.randrange(len(s))
        p = random.randint(1, max(1, (len(s) - a) // 3))
        s[a:] = [s[a + i % p] for i in range(len(s) - a)]
    if s and random.random() < 0.4:
        s[random.randrange(len(s))] = 9
    return s


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (2, 2), (9, 4)])
def test_runs_equal_every_period_tried(least, times):
    seen = 0
    cases = [np.array(sequence(), np.int64) for _ in range(400)]
    maybe = runs.repeating(cases, least, times)
    for s, may in zip(cases, maybe):
        want = slow_runs(s.tolist(), least, times)
        assert [tuple(r) for r in zip(*(x.tolist() for x in runs.runs_of(s, least, times)))] == want
        assert may or not want  # what is left out holds no run
        seen += len(want)
    assert seen > 50


def test_orders_and_minima():
    for _ in range(100):
        s = np.array(sequence() or [1], np.int64)
        order, rank, _ = runs.suffix_order(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist()) and rank[order].tolist() == list(range(len(s)))
        i, j = sorted(random.choices(range(len(s)), k=2))
        want = next((h for h in range(len(s) - j) if s[i + h] != s[j + h]), len(s) - j)
        if i < j:
            assert runs.Extensions(s, order, rank)(np.array([i]), np.array([j])).tolist() == [want]
    v = np.random.default_rng(1).integers(0, 1000, 5000)
    low = np.random.default_rng(2).integers(0, 5000, 2000)
    high = np.minimum(4999, low + np.random.default_rng(3).integers(0, 3000, 2000))
    assert runs.Minima(v)(low, high).tolist() == [v[a : b + 1].min() for a, b in zip(low, high)]


def slow_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w, 24, 3)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *told, sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_operator_equals_the_loop_on_odd_rows(spark, tmp_path):
    # nulls, empty texts, repeated rows, other blanks than ASCII's, clashing names
    texts = [None, "", " \t\n ", "a", "a " * 80, "x y z " * 30 + "end", " a b \x1c c\x0b d ", "ä b " * 20]
    texts += [" ".join(f"w{x}" for x in sequence()) for _ in range(150)]
    data = [(i, t, "n", 7) for i, t in enumerate(texts)] + [(4, texts[4], None, None)] * 2 + [(None, texts[5], None, None), (None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_runs string, start int")
    got = sorted(map(str, map(tuple, runs.periodic_runs(docs, plant=True).collect())))
    assert got == sorted(str(slow_row(r[0], r[1])) for r in data)
    empty = runs.periodic_runs(docs.limit(0))
    assert empty.count() == 0 and empty.columns == runs.NAMES
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, map(tuple, runs.op11_periodic_runs(spark, str(tmp_path)).collect()))) == got


def test_very_long_text(spark):
    """12 MB: a period over the whole text, and a text without one."""
    n = 1_500_000
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 10_000_000, n).tolist()]
    docs = spark.createDataFrame([(1, "abc de fgh " * (n // 3)), (2, " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 0, n, 3)
    assert got[1].collapsed_sha256 == hashlib.sha256(b"abc de fgh").hexdigest()
    assert got[2].n_runs == 0 and got[2].collapsed_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()
