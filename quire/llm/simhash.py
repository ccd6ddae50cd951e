"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are dealt by the population counts of their two halves. Two fingerprints within the radius have counts
that differ by no more than the radius in sum, so a tile meets only the tiles within that distance; all other tile
pairs are skipped. Inside a tile pair the counts of the four quarters skip sub-tiles by the same rule, and what is
left is compared in full with exclusive-or and bit counts. Nothing is approximated."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, hot_keys, local_forest, map_texts, materialize, row_key, spread_join, table

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints for which one salt is added; the fullest tile holds about a hundredth of them. Each salt sends
#: every fingerprint to its neighbour tiles once more, so tiles are made as large as a task easily holds.
PER_SALT = 4_000_000
#: Salts of one neighbour tile that one group reads; a group has 21 neighbours at most.
SALTS_A_GROUP = 8


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text: a bit is 1 if it is set in over half of the shingle hashes; no words: 0."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower and split know ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; null texts count as empty."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(t or "", shingle, seed) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))}

    return map_texts(source, ["doc_id", "text"], "doc_id long, fp long", run)


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.astype("<u8").view("<u2").reshape(-1, 4)).astype(np.int16)


def matches(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (into a, into b) at `radius` or fewer differing bits."""
    qa, qb = _quarters(a), _quarters(b)
    tiles, member = np.unique(qa, axis=0, return_inverse=True)
    order = np.argsort(member.ravel(), kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(member.ravel(), minlength=len(tiles)))))
    for k, tile in enumerate(tiles):
        near = np.flatnonzero(np.abs(qb - tile).sum(axis=1) <= radius)
        if not near.size:
            continue
        rows, other = order[bounds[k] : bounds[k + 1]], b[near]
        step = max(1, 1_000_000 // near.size)
        for i in range(0, rows.size, step):
            part = rows[i : i + step]
            x, y = np.nonzero(np.bitwise_count(a[part][:, None] ^ other[None, :]) <= radius)
            if x.size:
                yield part[x], near[y]


def _compare(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = [np.asarray(x, dtype=np.int64) for x in pdf["fps"][pdf["role"] == 0]]
        others = [np.asarray(x, dtype=np.int64) for x in pdf["fps"][pdf["role"] == 1]]
        empty = pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
        if not mine or not others:
            return empty
        a, b = np.concatenate(mine).view(np.uint64), np.concatenate(others).view(np.uint64)
        every, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
        at_a, at_b = inverse[: a.size], inverse[a.size :]
        root = local_forest(every.size, ((at_a[x], at_b[y]) for x, y in matches(a, b, radius)))
        linked = np.flatnonzero(root != np.arange(every.size))
        signed = every.view(np.int64)
        return pd.DataFrame({"u": signed[linked], "v": signed[root[linked]]})

    return run


def links(fps: DataFrame, radius: int = RADIUS, per_salt: int = PER_SALT) -> DataFrame:
    """(u, v): edges between distinct fingerprints that connect whatever lies within the radius.

    A group of close fingerprints gives a spanning forest, not all its pairs."""
    distinct = materialize(fps.select("fp").distinct())
    n_salts = max(1, math.ceil(distinct.count() / per_salt))
    n_blocks = math.ceil(n_salts / SALTS_A_GROUP)
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    tiles = materialize(
        distinct.select("fp", high.cast("int").alias("hi"), low.cast("int").alias("lo"), F.pmod(F.xxhash64("fp"), F.lit(n_salts)).cast("int").alias("salt"))
        .groupBy("hi", "lo", "salt").agg(F.collect_list("fp").alias("fps"))
    )
    near = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius and (x > 0 or x == 0 and y >= 0)]
    own = tiles.select(F.lit(0).alias("role"), "hi", "lo", "salt", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "fps")
    met = (
        tiles.withColumn("d", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in near])))
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
        .where("d.x != 0 or d.y != 0 or to <= salt")
        .select(F.lit(1).alias("role"), (F.col("hi") - F.col("d.x")).alias("hi"), (F.col("lo") - F.col("d.y")).alias("lo"), F.col("to").alias("salt"), F.floor(F.col("salt") / SALTS_A_GROUP).cast("int").alias("block"), "fps")
        .where("hi between 0 and 32 and lo between 0 and 32")
    )
    return own.unionByName(met).groupBy("hi", "lo", "salt", "block").applyInPandas(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    Fingerprints at `radius` or fewer differing bits are linked; component_id is the smallest id reachable. Null and
    empty texts have fingerprint 0 and are linked like any other. Repeated rows come out repeated; null ids belong to
    the component of their text, and component_id is null only if no id of the component is known. A text's length
    doesn't matter: its shingles are counted in blocks. Other columns, whatever their names, are ignored. An empty
    table gives no rows."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, seed))
    component = connected_components(materialize(links(fps, radius)))
    sized = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    nodes = materialize(sized.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep", "n"))
    lowest = materialize(nodes.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    named = spread_join(nodes.select("fp", "root"), lowest.drop("n"), ["root"], hot_keys(lowest, ["root"], nodes.count())).select("fp", "component_id")
    return spread_join(fps, named, ["fp"], hot_keys(nodes, ["fp"], fps.count())).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row of docs (doc_id, text, ...) of each component, with all its columns, whatever their names.

    It is the row of the smallest id (null last) and, of rows that share that, of the smallest text hash; of rows equal
    in id and text the one of the smallest hash over all columns. Null and wordless texts are one component. Only (id,
    key, fingerprint) is grouped, so a component never has to fit into one task. An empty table gives no rows."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), "text")

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(t or "", shingle, seed) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "fp": pa.array(fps.view(np.int64))}

    fps = materialize(map_texts(keyed, ["doc_id", "key", "text"], "doc_id long, key long, fp long", run))
    component = connected_components(materialize(links(fps, radius))).withColumnRenamed("node", "fp")
    rows = fps.groupBy("doc_id", "key").agg(F.first("fp").alias("fp"), F.count("*").alias("n"))  # equal rows have equal fingerprints
    lowest = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("first"))
    first = lowest.join(component, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = materialize(first.select("first.doc_id", "first.key", (F.col("first.n") > 1).alias("repeated")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id0"), row_key("doc_id", "text").alias("key0"))
    chosen = packed.join(kept, F.col("id0").eqNullSafe(F.col("doc_id")) & (F.col("key0") == F.col("key")))
    single = chosen.select("row")
    if kept.where("repeated").limit(1).count():  # only rows that stand repeated are shuffled whole
        one = chosen.where("repeated").groupBy("id0", "key0").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        single = chosen.where("NOT repeated").select("row").unionByName(one.select("row"))
    return single.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
