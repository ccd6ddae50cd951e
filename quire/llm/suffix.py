"""Suffix-array dedup of byte strings that start in two or more places.

A suffix array of the whole corpus, built column by column, needs as many rounds as the longest document has bytes,
each over all that is built so far. So the construction runs on segments instead: every 200-byte window is assigned to
its minimizer (the leftmost smallest hash of its 40-byte substrings), and equal windows have equal minimizers at the
same offset. The consecutive windows of one minimizer form a segment. Segments with a minimizer of their own hold no
repeat; equal segments are repeats as a whole; the different segments of one minimizer are sorted by the column-wise
construction: one symbol of each segment is inserted a round, which updates the collection's Burrows-Wheeler
transform. The order of the suffixes follows from the finished transform, and neighbours that share 200 bytes are
repeats. Blocks of segments are bounded, and nothing is left out: a minimizer with more different segments than a
block holds has its windows compared by hash across blocks instead."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hot_keys, materialize, row_key, spread_join, table

LENGTH = 200
GRAM = 40
#: Different segments of one minimizer in one block of the column-wise construction, at most.
BLOCK = 20_000
#: A block is built once it holds so many; small blocks stay in the processor's cache.
ENOUGH = 500
#: Places of a minimizer in its windows that are filtered together before the construction.
STEP = 16

_MULT = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0x5851F42D4C957F2D)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SYMBOLS = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of each substring of `gram` bytes, by doubling: a hash of 2n bytes comes from two of n."""
    have, size, done, done_size = _SYMBOLS[raw], 1, None, 0
    left = gram
    while left:
        if left & 1:
            if done is None:
                done, done_size = have, size
            else:
                n = raw.size - done_size - size + 1
                done = _mix(done[:n] * _TURN + have[done_size : done_size + n])
                done_size += size
        left >>= 1
        if left:
            n = raw.size - 2 * size + 1
            have = _mix(have[:n] * _TURN + have[size : size + n])
            size *= 2
    return done


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, place of the minimizer, its hash) of the segments of one text, in order."""
    data = np.frombuffer(raw, np.uint8)
    n = data.size - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = _gram_hashes(data, gram)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(hashes.size, dtype=np.uint64)
    w = length - gram + 1
    rows = -(-keys.size // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max)
    padded[: keys.size] = keys
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(low)) + 1))
    return starts, np.diff(np.append(starts, n)), low[starts], hashes[low[starts]]


def _segment_rows(length: int, gram: int):
    import xxhash

    schema = pa.schema([("d", pa.int64()), ("k", pa.int64()), ("s0", pa.int32()), ("n", pa.int16()), ("off", pa.int16()), ("anchor", pa.int64()), ("seg", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for d, k, text in zip(batch.column("d").to_pylist(), batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                s0, n, at, anchor = segments(raw, length, gram)
                if not s0.size:
                    continue
                # the seed holds the offset of the minimizer, so that equal hashes mean equally placed windows
                h = xxhash.xxh3_64_intdigest
                seg = np.fromiter((h(raw[a : a + c + length - 1], p - a) for a, c, p in zip(s0.tolist(), n.tolist(), at.tolist(), strict=True)), np.uint64, s0.size)
                for column, x in zip(out, (np.full(s0.size, d), np.full(s0.size, k), s0, n, at - s0, anchor.view(np.int64), seg.view(np.int64)), strict=True):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), type=f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run, "d long, k long, s0 int, n short, off short, anchor long, seg long"


def transform_order(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, order): where each string starts in their concatenation, and the sorted order of all suffixes, as
    places in it, ends of strings (which sort first) included.

    Column by column from the right: a round inserts one symbol of each string that has one left, at the rank that
    the transform built so far gives its suffix."""
    m = len(parts)
    sizes = np.fromiter(map(len, parts), np.int64, m)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    used = np.zeros(256, bool)
    inside = np.ones(raw.size, bool)
    inside[starts + sizes] = False
    used[raw[inside]] = True
    dense = np.cumsum(used)  # 0 stays for the ends
    symbol = dense.astype(np.uint8 if dense[-1] < 256 else np.uint16)[raw]
    symbol[~inside] = 0
    place = starts + sizes  # where the suffix inserted last starts
    bwt = np.where(sizes > 0, symbol[np.maximum(place - 1, 0)], 0).astype(symbol.dtype)
    at = np.arange(m)  # its rank
    live = np.flatnonzero(sizes > 0)
    count = np.arange(symbol.size, dtype=np.int32)
    while live.size:
        rank = np.empty(bwt.size, np.int32)
        rank[np.argsort(bwt, kind="stable")] = count[: bwt.size]
        at[live] = live.size + rank[at[live]]  # the other m - live.size strings are complete and have end marks
        place[live] -= 1
        before = np.where(place[live] > starts[live], symbol[np.maximum(place[live] - 1, 0)], 0)
        kept = np.ones(bwt.size + live.size, bool)
        kept[at[live]] = False
        grown = np.empty(kept.size, symbol.dtype)
        grown[kept] = bwt
        grown[at[live]] = before
        bwt = grown
        live = live[before > 0]
    # the finished transform: the rank of each suffix's left neighbour, followed from the ends of the strings
    follow = np.empty(bwt.size, np.int64)
    follow[np.argsort(bwt, kind="stable")] = np.arange(bwt.size)
    ends = int((bwt == 0).sum())
    order = np.empty(bwt.size, np.int64)
    at, place = np.arange(m), starts + sizes
    live = np.arange(m)
    while live.size:
        order[at[live]] = place[live]
        live = live[place[live] > starts[live]]
        at[live] = m - ends + follow[at[live]]
        place[live] -= 1
    return starts, order


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string a mask over its windows of `length` bytes: the window starts elsewhere in these strings too."""
    starts, order = transform_order(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    buffer = np.frombuffer(b"\0".join(parts) + b"\0" * (length + 1), np.uint8)
    room = np.zeros(int(sizes.sum()) + len(parts), np.int64)
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        room[a : a + n] = np.arange(n, 0, -1)
    order = order[room[order] >= length]
    views = np.lib.stride_tricks.sliding_window_view(buffer, length)
    same = np.zeros(max(0, order.size - 1), bool)
    for i in range(0, same.size, 50_000):
        a, b = order[i : i + 50_000][: same.size - i], order[i + 1 : i + 50_001]
        close = (buffer[a] == buffer[b]) & (buffer[a + length - 1] == buffer[b + length - 1]) & (buffer[a + length // 2] == buffer[b + length // 2])
        at = np.flatnonzero(close)
        same[i + at] = (views[a[at]] == views[b[at]]).all(axis=1)
    flagged = np.zeros(room.size, bool)
    flagged[order[1:][same]] = True
    flagged[order[:-1][same]] = True
    return [flagged[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def shared_parts(group: list[tuple[int, int, bytes]], length: int = LENGTH) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, int]]]:
    """What of one minimizer's segments (key, offset of the minimizer, bytes) can hold a repeat, and what surely does.

    The windows of a segment are taken in steps of STEP places relative to the minimizer. All windows of a step share
    a core of length - STEP + 1 bytes, so two equal windows lie in segments with equal cores in that step. Parts
    without a partner are left out, and of equal parts one stands for all. Gives the parts left to sort (index into
    group, first window, bytes) and the windows already known to repeat (key, from, before)."""
    core = length - STEP + 1

    def steps(off: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(step, first window, last window) of a segment with n windows."""
        for j in range((off - n + 1) // STEP, off // STEP + 1):
            yield j, max(0, off - STEP * j - STEP + 1), min(n - 1, off - STEP * j)

    def alone(items: list[tuple[int, bytes]]) -> set[tuple[int, bytes]]:
        seen: dict[tuple[int, bytes], int] = {}
        for off, x in items:
            for j, _, _ in steps(off, len(x) - length + 1):
                c = (j, x[off - STEP * j : off - STEP * j + core])
                seen[c] = seen.get(c, 0) + 1
        return {c for c, k in seen.items() if k == 1}

    single = alone([(off, x) for _, off, x in group])
    parts: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for i, (_, off, x) in enumerate(group):
        first = last = None
        for j, lo, hi in sorted(steps(off, len(x) - length + 1), key=lambda s: s[1]):
            if (j, x[off - STEP * j : off - STEP * j + core]) in single:
                if first is not None:
                    parts.setdefault((off - first, x[first : last + length]), []).append((i, first))
                first = None
            else:
                first, last = lo if first is None else first, hi
        if first is not None:
            parts.setdefault((off - first, x[first : last + length]), []).append((i, first))
    known = [(group[i][0], first, first + len(x) - length + 1) for (_, x), owners in parts.items() if len(owners) > 1 for i, first in owners]
    single = alone(list(parts))
    left = []
    for (off, x), owners in parts.items():
        if any((j, x[off - STEP * j : off - STEP * j + core]) not in single for j, _, _ in steps(off, len(x) - length + 1)):
            left += [(i, first, x) for i, first in owners[:1]]
    return left, known


_VERDICT = "anchor long, seg long, ranges array<struct<a:int,b:int>>"


def _sorted_blocks(length: int, block: int):
    """Rows (anchor, seg, off, bytes), sorted by anchor, to the repeated windows of their segments."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def batch(rows: list[tuple[int, int, list]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

    def judged(keys: list[tuple[int, int, int]], parts: list[bytes]) -> list[tuple[int, int, list]]:
        rows = [(a, s, [{"a": first + x, "b": first + y} for x, y in _runs(mask)]) for (a, s, first), mask in zip(keys, repeated_windows(parts, length), strict=True)]
        return [r for r in rows if r[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a block ends only where the anchor changes."""
        keys: list[tuple[int, int, int]] = []
        parts: list[bytes] = []
        rows: list[tuple[int, int, list]] = []
        group: list[tuple[int, int, bytes]] = []
        anchor = None

        def close() -> None:
            nonlocal keys, parts, rows
            left, known = shared_parts(group, length)
            rows.extend((anchor, s, [{"a": a, "b": b}]) for s, a, b in known)
            for i, first, x in left:
                keys.append((anchor, group[i][0], first))
                parts.append(x)
            group.clear()

        for record in batches:
            for a, s, off, x in zip(*(record.column(c).to_pylist() for c in ("anchor", "seg", "off", "bytes")), strict=True):
                if a != anchor:
                    if group:
                        close()
                    anchor = a
                    if len(parts) >= ENOUGH or len(rows) >= block:
                        yield batch(rows + (judged(keys, parts) if parts else []))
                        keys, parts, rows = [], [], []
                group.append((s, off, x))
        if group:
            close()
        yield batch(rows + (judged(keys, parts) if parts else []))

    return run


def _window_hashes(length: int):
    """(anchor, seg, i, w): a 128-bit hash of each window of a segment, for minimizers that no block holds."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("i", pa.int32()), ("w", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, s, x in zip(batch.column("anchor").to_pylist(), batch.column("seg").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                n = len(x) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([s] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([hashlib.blake2b(x[i : i + length], digest_size=16).digest() for i in range(n)], pa.binary())], schema=schema)

    return run


def _cut(length: int):
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("big", pa.bool_()), ("off", pa.int16()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, needs in zip(batch.column("t").to_pylist(), batch.column("needs").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(x["anchor"], x["seg"], x["big"], x["off"], raw[x["s0"] : x["s0"] + x["n"] + length - 1]) for x in needs]
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + 20_000]], type=f.type) for j, f in enumerate(schema)], schema=schema)

    return run


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(d, k, a, b): runs of repeated windows, from the first start to before b, of rows (d, k, t).

    Segments are the same if minimizer and segment hash are, 128 bits together. Both joins that bring verdicts to the
    segments salt the minimizers and segments of which there are many."""
    run, schema = _segment_rows(length, gram)
    every = materialize(rows.select("d", "k", "t").mapInArrow(run, schema))
    shared = materialize(every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("n > 1").select("anchor", "n", (F.col("lo") != F.col("hi")).alias("varied")))
    met = materialize(spread_join(every, shared.drop("n"), ["anchor"], hot_keys(shared, ["anchor"], every.count())))
    discard(every, shared)
    distinct = materialize(met.groupBy("anchor", "seg", "varied").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "s0", "n", "off")).alias("rep")))
    whole = distinct.where("n > 1").select("anchor", "seg", F.expr("array(named_struct('a', 0, 'b', int(rep.n)))").alias("ranges"))
    varied = distinct.where("varied").select("anchor", "seg", "rep.*")
    big = materialize(varied.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > block).select("anchor", F.lit(True).alias("big")))
    needs = varied.join(big, "anchor", "left").groupBy("d", "k").agg(F.collect_list(F.struct("anchor", "seg", F.coalesce("big", F.lit(False)).alias("big"), "s0", "n", "off")).alias("needs"))
    cut = materialize(rows.join(needs, ["d", "k"]).select("t", "needs").mapInArrow(_cut(length), "anchor long, seg long, big boolean, off short, bytes binary").dropDuplicates(["anchor", "seg"]))
    parts = max(1, -(-cut.count() // (2 * block)))
    few = cut.where("NOT big").select("anchor", "seg", "off", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "seg").mapInArrow(_sorted_blocks(length, block), _VERDICT)
    windows = materialize(cut.where("big").select("anchor", "seg", "bytes").mapInArrow(_window_hashes(length), "anchor long, seg long, i int, w binary"))
    twice = windows.groupBy("w").agg(F.min(F.struct("anchor", "seg", "i")).alias("x"), F.max(F.struct("anchor", "seg", "i")).alias("y")).where("x != y").select("w")
    many = windows.join(twice, "w", "left_semi").select("anchor", "seg", F.array(F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b"))).alias("ranges"))
    verdicts = materialize(few.unionByName(many).unionByName(whole).select("anchor", "seg", F.explode("ranges").alias("r")).select("anchor", "seg", "r.a", "r.b").distinct())
    discard(cut, windows, big)
    told = spread_join(met, verdicts, ["anchor", "seg"], hot_keys(distinct.select("anchor", "seg", "n"), ["anchor", "seg"], met.count()))
    return told.select("d", "k", (F.col("s0") + F.col("a")).alias("a"), (F.col("s0") + F.col("b")).alias("b"))


def _removed(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                kept, pos, n_spans, end = [], 0, 0, -1
                for s in spans or ():
                    a, b = s["a"], s["b"] + length - 1
                    if a > end:
                        n_spans += 1
                        kept.append(raw[pos:a])
                    end = pos = max(end, b)
                kept.append(raw[pos:])
                left = b"".join(kept)
                rows.append((doc_id, len(raw), len(raw) - len(left), n_spans, left))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], type=f.type) for j, f in enumerate(schema)], schema=schema)

    return run


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs (doc_id, text); kept has the remaining bytes.

    A byte goes if it lies in a string of `length` bytes that also starts elsewhere in the input, in the same row or
    another; of several occurrences none stays. Null texts are empty. Repeated rows are repeats of each other. Matches
    never cross rows, and texts shorter than `length` bytes stay. A text of any length is cut into segments whole; rows
    that share an id but not a text are apart; extra columns are ignored. An empty table gives no rows."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), row_key("doc_id", "text").alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    found = materialize(repeats(rows, length, gram, block).groupBy("d", "k").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")))
    out = rows.join(found, ["d", "k"], "left").select("doc_id", "t", "spans")
    return out.mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM h WHERE length(h) >= 400)),
r AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS p FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pb FROM s),
t AS (SELECT doc_id, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN head IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id)
"""
