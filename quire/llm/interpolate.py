"""Language-model scores by deleted interpolation of n-grams.

Maximum-likelihood estimates of every order are mixed, from the longest down to the uniform one, by weights that depend
on how often the context was seen. A part of the training documents is deleted from the counts, and expectation-
maximisation finds the weights under which the remaining counts predict that part best. Scores then use all training
counts.

Documents are packed into chunks of some hundred thousand tokens. A chunk sends each of its different n-grams once, as a
64-bit hash, to the bucket that counts it, and gets the counts back in the same order; so a frequent n-gram costs a
bucket one entry for each chunk, no task holds more than a bucket or a chunk, and texts are read once."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Words of the longest n-grams.
ORDER = 2
#: One training text in FOLD, by its hash, is deleted from the counts from which the weights are learnt.
FOLD = 16
#: Bytes of text in a chunk, unless one text has more, and n-grams, counted once for each chunk, in a bucket.
CHUNK, BUCKET = 2 << 20, 2_500_000
#: Rows of a batch that a worker gets.
ROWS = 1_000
#: The weights are settled when none changes by more than SETTLED from one round to the next, or after ROUNDS.
ROUNDS, SETTLED = 30, 1e-3
#: Context frequencies are parted at the powers of two; 0 is apart.
LEVELS = 65
#: Hashes of what stands before and after each text.
PAD, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sizes, hashes): the words of all texts as codes, the words of each text, and a code's 64-bit hash.

    A-Z are lower-cased, words parted by ASCII blanks; null texts have none. Frequent words have small codes."""
    import xxhash

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = parts.flatten()
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # blanks at either end leave empty words
    ends = np.concatenate(([0], np.cumsum(real)))[np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]
    ids = ids[real]
    by = np.argsort(-np.bincount(ids, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(by))
    return rank[ids], np.diff(ends, prepend=0), hashes[by]


def let_go() -> None:
    """Gives memory that Arrow and the C library keep for later back, as workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """Texts come to the workers so many at a time, for what is written meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def planes(values: np.ndarray) -> bytes:
    """64-bit values as eight planes of bytes, so that what is small or alike compresses."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(planes(values), 1)


def unpacked(data: bytes) -> np.ndarray:
    return unplaned(zlib.decompress(data))


CHUNKS = "chunk long, fold boolean, doc_ids array<long>, train binary, sizes binary, hashes binary, codes binary, train_tokens long"
_CHUNKS = pa.schema([("chunk", pa.int64()), ("fold", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("codes", pa.binary()), ("train_tokens", pa.int64())])


def chunks(docs: DataFrame) -> DataFrame:
    """CHUNKS of docs (doc_id, text, train, fold): texts of the fold in chunks of their own. Write the result: chunks are
    numbered by the task that makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        waiting: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def full(fold: bool) -> pa.RecordBatch:
            nonlocal number
            ids, texts, train = (pa.concat_arrays(x) for x in zip(*waiting[fold], strict=True))
            codes, sizes, hashes = encoded(texts)
            of = train.to_numpy(zero_copy_only=False).astype(np.uint8)
            row = (number, fold, ids.to_pylist(), of.tobytes(), packed(sizes), hashes.tobytes(), packed(codes), int(((sizes + 1) * of).sum()))
            number += 1
            waiting[fold], size[fold] = [], 0
            del texts, codes
            let_go()
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, _CHUNKS, strict=True)], schema=_CHUNKS)

        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // CHUNK, append=-1)) + 1  # slices of about a chunk
            for begin, end in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                piece = batch.slice(begin, end - begin)
                for fold in (False, True):
                    part = piece.filter(pc.equal(piece.column("fold"), fold))
                    if part.num_rows:
                        waiting[fold].append([part.column(c) for c in ("doc_id", "text", "train")])
                        size[fold] += int(pc.sum(pc.fill_null(pc.binary_length(part.column("text")), 0)).as_py()) + part.num_rows
                    if size[fold] >= CHUNK:
                        yield full(fold)
            del batch, piece, part  # else they stay while the next batch is read
        for fold in (False, True):
            if waiting[fold]:
                yield full(fold)

    return docs.select("doc_id", "text", "train", "fold").mapInArrow(run, CHUNKS)


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of an n-gram from those of its context and its last word."""
    x = before * np.uint64(0xBF58476D1CE4E5B9) + word
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


class Grams:
    """The n-grams of a chunk: keys has each one once, in order; a key's two lowest bits are its order less one."""

    def __init__(self, sizes: np.ndarray, hashes: np.ndarray, codes: np.ndarray, train: np.ndarray, order: int):
        sizes = sizes.astype(np.int64)
        self.order, spans = order, sizes + order  # pads, words and the end
        starts = np.cumsum(spans) - spans
        self.ends = starts + spans
        word = np.full(int(spans.sum()), PAD, np.uint64)
        at = np.arange(len(codes)) + np.repeat(starts + order - 1 - (np.cumsum(sizes) - sizes), sizes)
        word[at] = hashes[codes.astype(np.int64)]
        word[self.ends - 1] = END
        self.tokens = np.ones(len(word), bool)
        for i in range(order - 1):
            self.tokens[starts + i] = False
        seen = self.tokens.copy()  # the last pad is the context of the first word
        if order > 1:
            seen[starts + order - 2] = True
        gram, every = word, []
        self.used = []
        for k in range(order):
            if k:
                gram = np.concatenate((word[:1], _mixed(gram[:-1], word[1:])))
            self.used.append(np.flatnonzero(self.tokens if k == order - 1 else seen))
            every.append((gram[self.used[-1]] << np.uint64(2)) | np.uint64(k))
        self.keys, inverse = np.unique(np.concatenate(every), return_inverse=True)
        self.inverse = inverse.ravel()
        counted = np.repeat(train, spans).astype(np.float64)
        self.counts = np.bincount(self.inverse, np.concatenate([counted[u] for u in self.used]), len(self.keys)).astype(np.uint64)

    def seen(self, counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(of n-grams, of contexts): for each order, and each token, how often its n-gram and its context were counted."""
        cuts = np.cumsum([len(u) for u in self.used])[:-1]
        at = np.flatnonzero(self.tokens)
        full = []
        for used, c in zip(self.used, np.split(counts.astype(np.int64)[self.inverse], cuts), strict=True):
            full.append(np.zeros(len(self.tokens), np.int64))
            full[-1][used] = c
        return [f[at] for f in full], [f[at - 1] for f in full[:-1]]


def grams(row, order: int) -> Grams:
    return Grams(unpacked(row.sizes), np.frombuffer(row.hashes, np.uint64), unpacked(row.codes), np.frombuffer(row.train, np.uint8), order)


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


_INPUT = ["chunk", "fold", "train", "sizes", "hashes", "codes"]


def cells(made: DataFrame, order: int, n: int) -> DataFrame:
    """(bucket, chunk, fold, keys, counts): the different n-grams of each chunk of `made`, dealt to n buckets by their keys."""
    arrow = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("fold", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = next(batch.slice(i, 1).to_pandas().itertuples())
                g = grams(row, order)
                bucket = _buckets(g.keys, n)
                starts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
                rows = [(int(bucket[a]), row.chunk, row.fold, planes(np.diff(g.keys[a:b], prepend=np.uint64(0))), planes(g.counts[a:b])) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True)]
                out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                del g, bucket, rows, row
                let_go()
                yield out

    return made.select(*_INPUT).mapInArrow(run, "bucket int, chunk long, fold boolean, keys binary, counts binary")


COUNTED = "bucket int, chunk long, fold boolean, counts binary, rest binary, types long"


def counted(dealt: DataFrame) -> DataFrame:
    """COUNTED: for each cell the counts of its keys over all chunks, and for one of the fold those without the fold.

    One more row of each bucket, with a null chunk, has the number of different words that it counts."""
    pad = (PAD << np.uint64(2),)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unplaned(x), dtype=np.uint64) for x in pdf["keys"]]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        inverse = inverse.ravel()
        own = np.concatenate([unplaned(x) for x in pdf["counts"]]).astype(np.float64)
        fold = np.repeat(pdf["fold"].to_numpy(bool), [len(k) for k in keys])
        total = np.bincount(inverse, own, len(distinct)).astype(np.uint64)
        rest = total - np.bincount(inverse, own * fold, len(distinct)).astype(np.uint64)
        types = int(((distinct & np.uint64(3)) == 0)[total > 0].sum() - np.isin(pad, distinct[total > 0]).sum())
        bucket = int(pdf["bucket"].iloc[0])
        rows = [(bucket, c, f, packed(total[i]), packed(rest[i]) if f else None, None) for c, f, i in zip(pdf["chunk"], pdf["fold"], np.split(inverse, cuts), strict=True)]
        out = pd.DataFrame([*rows, (bucket, None, False, None, None, types)], columns=["bucket", "chunk", "fold", "counts", "rest", "types"])
        del keys, distinct, inverse, own, fold, total, rest, rows
        let_go()
        return out.astype({"chunk": "Int64", "types": "Int64"})

    return dealt.groupBy("bucket").applyInPandas(run, COUNTED)


def level(x: np.ndarray) -> np.ndarray:
    """0 for 0, and the length of a whole number in bits."""
    return np.frexp(x.astype(np.float64))[1]


def learnt(events: DataFrame, order: int, tokens: int, types: int) -> list[np.ndarray]:
    """weights[k - 1][level of the context's count]: that of order k against all lower ones.

    events (c1, x2, c2, ..., n) has the counts of n-grams and contexts of the deleted tokens in the rest, and how often
    they stand. A round is one aggregation by levels; at most LEVELS ** (order - 1) rows of sums go to the driver."""
    weights = [np.full(LEVELS, 0.5) for _ in range(order)]
    for w in weights[1:]:
        w[0] = 0  # an unseen context tells nothing
    levels = [F.when(F.col(f"x{k}") > 0, F.length(F.bin(f"x{k}"))).otherwise(0).alias(f"b{k}") for k in range(2, order + 1)]
    estimates = [(F.col("c1") / F.lit(float(max(1, tokens)))).alias("f1"), *[F.when(F.col(f"x{k}") > 0, F.col(f"c{k}") / F.col(f"x{k}")).otherwise(0.0).alias(f"f{k}") for k in range(2, order + 1)]]
    rows = events.select("n", *levels, *estimates)
    for _ in range(ROUNDS):
        weight = [F.lit(float(weights[0][0])), *[F.element_at(F.array(*map(F.lit, w.tolist())), F.col(f"b{k}") + 1) for k, w in enumerate(weights[1:], 2)]]
        step, below = rows, F.lit(1.0 / (types + 1))
        for k in range(1, order + 1):  # probability and share of each order, from the lowest
            step = step.withColumn(f"p{k}", weight[k - 1] * F.col(f"f{k}") + (1 - weight[k - 1]) * below)
            step = step.withColumn(f"r{k}", weight[k - 1] * F.col(f"f{k}") / F.col(f"p{k}"))
            below = F.col(f"p{k}")
        came, sums = F.col("n").cast("double"), []
        for k in range(order, 0, -1):
            sums += [F.sum(came * F.col(f"r{k}")).alias(f"won{k}"), F.sum(came).alias(f"came{k}")]
            came = came * (1 - F.col(f"r{k}"))
        found = step.groupBy(*[f"b{k}" for k in range(2, order + 1)]).agg(*sums).toPandas()
        change = 0.0
        for k in range(1, order + 1):
            at = found[f"b{k}"].to_numpy(np.int64) if k > 1 else np.zeros(len(found), np.int64)
            won, tried = (np.bincount(at, found[c].fillna(0).to_numpy(np.float64), LEVELS) for c in (f"won{k}", f"came{k}"))
            new = (won + 0.5) / (tried + 1)  # never 1, so that every text has a probability
            for b in range(1, LEVELS):
                if not tried[b]:
                    new[b] = new[b - 1] if b > 1 else 0.5
            if k > 1:
                new[0] = 0
            change = max(change, float(np.abs(new - weights[k - 1])[:1 if k == 1 else LEVELS].max()))
            weights[k - 1] = new
        if change <= SETTLED:
            break
    return weights


def _joined(made: DataFrame, counts: DataFrame):
    return made.groupBy("chunk").cogroup(counts.where("chunk IS NOT NULL").groupBy("chunk"))


def _aligned(row, counts: pd.DataFrame, column: str, order: int) -> tuple[Grams, np.ndarray]:
    g = grams(row, order)
    return g, np.concatenate([unpacked(x) for x in counts.sort_values("bucket")[column]])


def deleted_events(made: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(c1, x2, c2, ..., n) of the tokens of the fold: how often their n-grams and contexts stand in the rest."""
    names = ["c1", *[f"{s}{k}" for k in range(2, order + 1) for s in "xc"]]

    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk) or not len(answers):
            return pd.DataFrame({c: np.array([], np.int64) for c in [*names, "n"]})
        g, found = _aligned(next(chunk.itertuples()), answers, "rest", order)
        c, x = g.seen(found)
        columns = [c[0], *[v for k in range(1, order) for v in (x[k - 1], c[k])]]
        return pd.DataFrame(dict(zip(names, columns, strict=True))).groupby(names, sort=False).size().rename("n").reset_index()

    each = _joined(made.where("fold").select(*_INPUT), counts.where("fold")).applyInPandas(run, ", ".join(f"{c} long" for c in [*names, "n"]))
    return each.groupBy(*names).agg(F.sum("n").alias("n"))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(made: DataFrame, counts: DataFrame, weights: list[np.ndarray], order: int, tokens: int, types: int) -> DataFrame:
    """SCORES of the documents of all chunks."""

    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = next(chunk.itertuples())
        g, found = _aligned(row, answers, "counts", order)
        c, x = g.seen(found)
        p = np.full(len(c[0]), 1.0 / (types + 1))
        for k in range(order):
            context = x[k - 1] if k else np.full(len(p), tokens)
            w = weights[k][level(context)] if k else weights[0][0] * (tokens > 0)
            p = w * c[k] / np.maximum(context, 1) + (1 - w) * p
        sizes = unpacked(row.sizes).astype(np.int64) + 1
        starts = np.cumsum(sizes) - sizes
        added = lambda v: np.add.reduceat(v, starts)
        base = np.log10((c[0] + 1) / (tokens + types + 1))
        ids = pd.array([None if d is None or d != d else int(d) for d in row.doc_ids], dtype="Int64")
        del g, found
        let_go()
        return pd.DataFrame({"doc_id": ids, "held_out": np.frombuffer(row.train, np.uint8) == 0, "n_tokens": sizes, "n_known": added((c[0] > 0).astype(np.int64)), "base_score": added(base), "score": added(np.log10(p))})

    return _joined(made.select("doc_ids", *_INPUT), counts).applyInPandas(run, SCORES)


def in_fold(text: Column, fold: int = FOLD) -> Column:
    """Whether a text is of the deleted part; copies of a text share the answer, so none predicts its copy."""
    return F.pmod(F.xxhash64(text), F.lit(fold)) == 0


def score_texts(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs (doc_id, text).

    train says, from the columns of docs, which rows the model learns from; held_out are the others. score is the log10
    probability of the text and its end under n-grams of up to `order` (4 at most) words, base_score that under add-one
    word counts. Null, empty and blank texts have one token, the end. Repeated rows count as often as they stand, and
    come out repeated; null ids stay null; texts of any length are read whole, and other columns, whatever their names,
    are ignored. Without a training row every score is that of the uniform distribution over no words, 0. An empty table
    gives no rows. N-grams are told apart by 62 bits of hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), train.alias("train"))
    with small_batches(docs.sparkSession):
        made = materialize(chunks(rows.withColumn("fold", F.col("train") & in_fold(F.col("text")))))
        sums = made.agg(F.sum("train_tokens"), F.sum(F.when(F.col("fold"), F.col("train_tokens")).otherwise(0)), F.sum(F.size("doc_ids")), F.sum(F.length("codes"))).first()
        tokens, deleted = sums[0] or 0, sums[1] or 0
        # a coded word takes one to two bytes
        n = max(16, -(-(sums[3] or 0) * order // BUCKET))
        counts = materialize(counted(cells(made, order, n)))
        types = counts.agg(F.sum("types")).first()[0] or 0
        events = materialize(deleted_events(made, counts, order))
        weights = learnt(events, order, tokens - deleted, types)
        out = materialize(scores(made, counts, weights, order, tokens, types))
    discard(made, counts, events)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def seventh(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), seventh() != 2)


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op12: all columns but the model's score."""
    return op12_lm_scoring(spark, sf_dir).withColumn("base_score", F.round("base_score", 6)).drop("score")


BASE_SQL = r"""
WITH RECURSIVE bits AS (SELECT 0 AS b, n AS c, n AS i FROM range(256) t(n) UNION ALL SELECT b + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i FROM bits WHERE b < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE b = 8),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, coalesce(text, '') AS text FROM documents),
crc AS (SELECT id, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT DISTINCT id FROM d) UNION ALL
        SELECT id, k + 1, xor(t[xor(c, ascii(substr(id, k + 1, 1))::BIGINT) % 256 + 1], c // 256) FROM crc, tab WHERE k < length(id)),
h AS (SELECT id, xor(c, 4294967295) % 7 = 2 AS held_out FROM crc WHERE k = length(id)),
w AS (SELECT row_number() OVER () AS r, doc_id, held_out, list_append(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), chr(10)) AS w FROM d JOIN h USING (id)),
t AS (SELECT r, held_out, w, count(*) AS n FROM (SELECT r, held_out, unnest(w) AS w FROM w) GROUP BY ALL),
c AS (SELECT w, sum(n)::BIGINT AS c FROM t WHERE NOT held_out GROUP BY w),
g AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT r, sum(n)::BIGINT AS n_tokens, coalesce(sum(n) FILTER (c > 0), 0)::BIGINT AS n_known, sum(n * log10((coalesce(c, 0) + 1) / (SELECT n + v + 1 FROM g))) AS base FROM t LEFT JOIN c USING (w) GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM g) AS train_tokens, round(base, 6) AS base_score FROM w JOIN s USING (r)
"""
