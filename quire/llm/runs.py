"""Periodic runs in word sequences, by the runs theorem.

A run's smallest period is the length of its Lyndon roots, and a Lyndon root of every run is the longest Lyndon word
that begins at its place under one of the two orders of the words. These longest Lyndon words end where the next smaller
(or, under the inverted order, next greater) value of the inverse suffix array stands. A root is extended to both sides
by longest common extensions: range minima over the common prefixes of neighbours in the suffix order. A document is one
row's work; Spark deals the documents out."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: A run has LEAST words and TIMES periods at least.
LEAST, TIMES = 24, 3
#: Values that one block of the range minima holds.
BLOCK = 32
#: Bytes of the documents that are looked through together, if there are several.
TOGETHER = 1 << 20


def numbered(texts: pa.Array) -> list[np.ndarray]:
    """The words of each text as numbers, the same for equal words of all texts; any order of the words would do."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    words = parts.flatten()
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # blanks at either end leave empty words
    ends = np.concatenate(([0], np.cumsum(real)))[np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]
    return np.split(ids[real], ends[:-1])


def repeating(texts: list[np.ndarray], least: int, times: int) -> list[bool]:
    """Whether a sequence may hold runs: two of its suffixes share as many words as every run's root repeats.

    A run of `least` words and `times` periods agrees with itself, a period on, for `least` less `least` / `times`
    words at least, if that is fewer than what is left of longer periods. All sequences are ranked in one order; their
    number goes before their words, so that suffixes of different ones never tie."""
    sizes = [len(t) for t in texts]
    if not sum(sizes):
        return [False] * len(texts)
    of = np.repeat(np.arange(len(texts)), sizes)
    words = np.concatenate(texts)
    same = least - least // times
    order, _, shared = suffix_order(of * (words.max() + 1) + words, 1 << (same.bit_length() - 1))
    out = np.zeros(len(texts), bool)
    out[of[order[shared]]] = True
    return out.tolist()


def suffix_order(s: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, shared): the suffix array of s, its inverse, and no place; a suffix that begins another stands before it.

    Suffixes are ranked by their first 1, 2, 4 ... words. A round sorts those again whose rank is still shared. With
    `most`, a power of two, suffixes are ranked by so many words only, and shared has the places where they still tie."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = s[order]
    starts = np.concatenate(([True], first[1:] != first[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))  # the place of the first of equal ones
    width = 1
    while True:
        shared = ~(starts & np.concatenate((starts[1:], [True])))
        at = np.flatnonzero(shared)
        if not at.size or width == most:
            return order, rank, at
        suffix = order[at]
        ahead = suffix + width
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = rank[suffix] * np.int64(n + 1) + then + 1
        by = np.argsort(key, kind="stable")
        order[at], key = suffix[by], key[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        starts[at[fresh]] = True
        # groups keep their places, so a rank is again the place of its group's first
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        width *= 2


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """At i > 0 the words that the suffixes at places i - 1 and i of the order have in common; each word is met at most twice."""
    n = len(s)
    word, before, place = s.tolist(), np.concatenate(([-1], order[:-1])).tolist(), rank.tolist()
    out, h = [0] * n, 0
    for i in range(n):
        at = place[i]
        j = before[at]
        if j < 0:
            h = 0
            continue
        most = n - max(i, j)
        while h < most and word[i + h] == word[j + h]:
            h += 1
        out[at] = h
        if h:
            h -= 1
    return np.array(out, np.int64)


class Minima:
    """Range minima in memory that grows with the values: minima from and to block borders, a sparse table over blocks."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        blocks = -(-n // BLOCK)
        self.values = np.concatenate((values, np.full(blocks * BLOCK - n, np.iinfo(np.int64).max)))
        grid = self.values.reshape(blocks, BLOCK)
        self.to = np.minimum.accumulate(grid, axis=1).ravel()
        self.since = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while 2 ** len(self.levels) <= blocks:
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value at each low..high, both included."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.since[low], self.to[high])
        wide = np.flatnonzero(b - a > 1)
        if wide.size:
            x, y = a[wide] + 1, b[wide]
            level = np.frexp((y - x).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                of = level == k
                i = wide[of]
                out[i] = np.minimum(out[i], np.minimum(self.levels[k][x[of]], self.levels[k][y[of] - 2**k]))
        same = np.flatnonzero(a == b)
        if same.size:
            left, right = low[same], high[same]
            least = self.values[left]
            for _ in range(BLOCK - 1):
                left = np.minimum(left + 1, right)
                np.minimum(least, self.values[left], out=least)
            out[same] = least
        return out


class Extensions:
    """Longest common extensions to the right between two places of s."""

    def __init__(self, s: np.ndarray, order: np.ndarray, rank: np.ndarray):
        self.n, self.rank = len(s), rank
        self.minima = Minima(common_prefixes(s, order, rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j > i on; 0 where j is the end."""
        out = np.zeros(len(i), np.int64)
        inside = j < self.n
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        out[inside] = self.minima(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one that holds a smaller value, or the end."""
    n = len(values)
    out, waiting = [n] * n, []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def runs_of(s: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of the runs of s with `least` words and `times` >= 2 periods, by start, then period."""
    n, none = len(s), (np.zeros(0, np.int64),) * 3
    if n < max(least, times) or times < 2:
        return none
    order, rank, _ = suffix_order(s)
    values = rank.tolist()
    at = np.arange(n)
    begin = np.concatenate((at, at))
    end = np.array(next_smaller(values) + next_smaller([-v for v in values]), np.int64)
    # a run's first root begins in its first period, so at least so many words have to agree behind the root
    need = np.maximum(least, times * (end - begin)) - 2 * (end - begin) + 1
    kept = np.flatnonzero(end + need <= n)
    for i in range(8):  # most places differ within a few words; extensions are built where some don't
        begin, end, need = begin[kept], end[kept], need[kept]
        kept = np.flatnonzero((need <= i) | (s[np.minimum(begin + i, n - 1)] == s[np.minimum(end + i, n - 1)]))
    begin, end, need = begin[kept], end[kept], need[kept]
    if not begin.size:
        return none
    ahead = Extensions(s, order, rank)(begin, end)
    kept = np.flatnonzero(ahead >= need)
    begin, end, ahead = begin[kept], end[kept], ahead[kept]
    period = end - begin
    if not kept.size:
        return none
    # roots of one run share its period and its end; the first of them stands for it
    stop = end + ahead
    by = np.lexsort((begin, period, stop))
    first = np.concatenate(([True], (stop[by][1:] != stop[by][:-1]) | (period[by][1:] != period[by][:-1])))
    begin, period, stop = begin[by][first], period[by][first], stop[by][first]
    mirrored = s[::-1].copy()
    left = Extensions(mirrored, *suffix_order(mirrored)[:2])  # words that agree before begin and before begin + period
    back = np.zeros(len(begin), np.int64)
    inner = np.flatnonzero(begin > 0)
    back[inner] = left(n - begin[inner] - period[inner], n - begin[inner])
    start = begin - back
    length = stop - start
    whole = length >= np.maximum(least, times * period)
    start, length, period = start[whole], length[whole], period[whole]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places of the words that a document of n words is made of where the contract makes it periodic, else None.

    A null id has no decimal form, so its words stay as they are."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def report(words: list[bytes], starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text and its runs."""
    best = None
    lines = []
    for run in zip(starts.tolist(), lengths.tolist(), periods.tolist(), strict=True):
        lines.append("%d,%d,%d\n" % run)
        if best is None or run[1] * best[2] > best[1] * run[2]:  # by start, then period, so ties keep the first
            best = run
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, starts + periods, 1)
    np.add.at(dropped, starts + lengths, -1)
    if lines:
        words = [words[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(lines), *told, sha("".join(lines).encode()), sha(b" ".join(words))


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, plant: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): its runs of `least` words and `times` periods at least, and the text
    without their repetitions.

    start, length, period and exponent_milli tell of the run of the greatest exponent (ties: smallest start, then
    period) and are null without a run. A word goes if some run holds it after that run's first period. Words are parted
    by ASCII blanks. Null, empty and blank texts have no words; texts of any length are searched whole, in memory that
    grows with their words; repeated rows come out repeated; null ids stay null; other columns are ignored, whatever
    their names; an empty table gives no rows. plant first makes the documents periodic that the contract of the query
    names."""

    none = (np.zeros(0, np.int64),) * 3

    def answered(ids: list[int | None], texts: pa.Array) -> list[tuple]:
        numbers = numbered(texts)
        places = [planted(k, len(t)) if plant else None for k, t in zip(ids, numbers, strict=True)]
        numbers = [t if at is None else t[at] for t, at in zip(numbers, places, strict=True)]
        out = []
        for k, text, t, at, may in zip(ids, texts.to_pylist(), numbers, places, repeating(numbers, least, times), strict=True):
            words = (text or "").encode().split()
            if at is not None:
                words = [words[i] for i in at.tolist()]
            out.append((k, *report(words, *(runs_of(t, least, times) if may else none))))
        return out

    def run(batch: pa.RecordBatch) -> dict:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        rows, begin, size = [], 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1):
            size += n
            if size >= TOGETHER or i == len(ids):
                rows += answered(ids[begin:i], texts.slice(begin, i - begin))
                begin, size = i, 0
        return dict(zip(NAMES, zip(*rows, strict=True), strict=True)) if rows else {name: [] for name in NAMES}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), ["doc_id", "text"], SCHEMA, run)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
