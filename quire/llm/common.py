"""Shared helpers: table access, scratch tables, bounded broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Sides of a join are broadcast up to this many rows; larger ones are shuffled.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than one in HOT_KEYS of all rows, and more than HOT_ROWS.
HOT_KEYS, HOT_ROWS = 10_000, 1_000
#: Classes that a classifier may have, and bins of hashes by which its labelled rows are chosen.
CLASSES, BINS = 1_000, 1_024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is set, a local session (tests) gets one of this machine;
    a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quire"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes a table in the shared scratch folder and reads it back."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing will read again; what was made from them has to be written itself."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hot_keys(counts: DataFrame, on: list[str], total: int) -> DataFrame:
    """(on, __salts) of the keys of counts (on, n) that hold more than a HOT_KEYS-th of `total` rows, and HOT_ROWS at least.

    There are HOT_KEYS at most whatever the data, so the result may be broadcast."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    return F.broadcast(counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") * 4 / limit).cast("int").alias("__salts")))


def spread_join(many: DataFrame, few: DataFrame, on: list[str], hot: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """many.join(few, on) in which no key of `many` has to fit into one task.

    The rows of a hot key are dealt to salts by the hash of `by` (all columns), and the key's rows of `few` go to every
    salt. Hot keys come from hot_keys(), or are counted here by an aggregation that combines map-side."""
    if hot is None:
        counts = materialize(many.groupBy(*on).agg(F.count("*").alias("n")))
        hot = hot_keys(counts, on, counts.agg(F.sum("n")).first()[0] or 0)
    dealt = many.join(hot, on, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(by or many.columns)), F.col("__salts"))).cast("int")).drop("__salts")
    every = few.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(every, [*on, "__salt"]).drop("__salt")


def fits(few: DataFrame, limit: int | None = None) -> bool:
    """Whether a side has at most `limit` (BROADCAST_ROWS) rows, counted now, so that it may be broadcast."""
    limit = BROADCAST_ROWS if limit is None else limit
    return few.limit(limit + 1).count() <= limit


def lookup(many: DataFrame, few: DataFrame, on: list[str], by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """many.join(few, on): `few` is broadcast if it fits(); else hot keys of `many` are salted by the columns `by`."""
    return many.join(F.broadcast(few), on) if fits(few, limit) else spread_join(many, few, on, by=by)


def row_key(doc_id: str, text: str) -> Column:
    """Rows that share an id but not a text stay apart; exact repeats of a row share the key."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no classifier learns from: crc32 of the id as text, modulo 5, is 0. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of labelled training rows: at most `per_class` rows of each label, those of the smallest id hash.

    A written table, as training reads it more than once. Held-out ids, null ids and null labels are left out; of several
    labels of an id the largest counts. Repeated rows are one row; rows that share an id but not a text count apart."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return bounded_rows(docs, known, per_class)


def least_hashes(rows: DataFrame, per_class: int, by: list[str]) -> DataFrame:
    """rows (y, by; distinct) of the smallest hashes of each class y: all of a class of `per_class` or fewer, else whole
    BINS of hashes up to `per_class` rows.

    Only counts by class and bin go to the driver, BINS for each of at most CLASSES classes; rows are never ranked or
    gathered. The result may be broadcast."""
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).limit(CLASSES + 1).collect()}
    if len(sizes) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes to learn from")
    if not sizes:
        return rows
    of_class = lambda values: F.create_map(*[F.lit(x) for y, v in values.items() for x in (y, v)])[F.col("y")]
    share = F.xxhash64(*by) / F.lit(2.0**64) + 0.5
    # bins are so narrow that about a quarter of them is kept
    binned = rows.withColumn("__bin", F.floor(share * of_class({y: float(n) for y, n in sizes.items()}) * BINS / (4 * per_class + 100)).cast("long"))
    cuts = {y: BINS for y in sizes}
    seen: dict = {}
    counts = binned.where(F.col("__bin") < BINS).groupBy("y", "__bin").agg(F.count("*").alias("n")).collect()
    for y, k, n in sorted(map(tuple, counts)):
        seen[y] = seen.get(y, 0) + n
        if seen[y] > per_class:
            cuts[y] = min(cuts[y], k)
    whole = {y: n <= per_class for y, n in sizes.items()}
    return binned.where(of_class(whole) | (F.col("__bin") < of_class(cuts))).drop("__bin")


def bounded_rows(docs: DataFrame, known: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, y) of the rows of docs whose id `known` (doc_id, y; distinct ids) has: `per_class` of each class at most.

    Ids are chosen first, by their hash, and then rows, as an id may stand on any number of them. A written table;
    repeated rows are one row, null texts are empty."""
    ids = least_hashes(known, per_class, ["doc_id"])
    met = materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").withColumn("key", row_key("doc_id", "text")))
    keys = least_hashes(met.select("doc_id", "key", "y").distinct(), per_class, ["doc_id", "key"]).select("doc_id", "key")
    return materialize(met.join(F.broadcast(keys), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("y").alias("y")).drop("key"))


#: Bytes of a batch that a task works on at a time.
TOGETHER = 4 << 20


def pieces(batch: pa.RecordBatch, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` (TOGETHER) bytes, a row at least: batches grow with the rows of a file, up to
    what Arrow sends at once, and what is made of their texts grows with them."""
    rows = max(1, (size or TOGETHER) * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_texts(df: DataFrame, columns: list[str], schema: str | StructType, fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Runs fn on pieces() of Arrow batches of the named columns; fn returns the output columns by name, in order."""
    from pyspark.sql.types import _parse_datatype_string

    target = pa_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=t.type) for x, t in zip(out.values(), target, strict=True)], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def pa_schema(struct) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of (u, v) edges: root is the smallest node reachable.

    Alternating large-star and small-star rounds; every round is two aggregations that combine map-side and two
    joins with salted hubs, so no component is gathered in one task. Loops, repeated edges and both directions are
    fine. The tables of a round are deleted once the next one is written."""
    e = materialize(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = state(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        larger = spread_join(both.where("v > u"), low.select("u", "m"), ["u"], hot_keys(low, ["u"], 2 * before[0]))
        large = materialize(larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        joined = spread_join(large, least.select("u", "m"), ["u"], hot_keys(least, ["u"], before[0])).where("v != m")
        done, e = e, materialize(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(done, low, large, least)
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def local_forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root (an index) of each of n items after joining the index pairs, which come in blocks."""
    root = np.arange(n)
    for a, b in pairs:
        ra, rb = root[a], root[b]
        keep = ra != rb
        if not keep.any():
            continue
        links = np.unique(np.minimum(ra, rb)[keep] * np.int64(n) + np.maximum(ra, rb)[keep])
        lo, hi = links // n, links % n
        parent = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        table_ = np.arange(n)
        for x in list(parent):
            table_[x] = find(x)
        root = table_[root]
    return root
