"""An outbox: what lands gets gap-free sequence numbers, and readers go on from an offset of their own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists, numbered, read_text, write_text

#: How monotonically_increasing_id() is made: the partition above so many bits, the row below.
BITS = 33


def _range(spark: SparkSession, path: str, epoch: int) -> tuple[int, int]:
    """(first, last) sequence number of an epoch that is written whole; last is first - 1 if it is empty."""
    told = read_text(spark, f"{path}/ranges/{epoch}")
    if told:
        return tuple(json.loads(told))
    first = last_number(spark, path, epoch) + 1
    n = spark.read.parquet(f"{path}/events/epoch={epoch}").count()
    write_text(spark, f"{path}/ranges/{epoch}", json.dumps([first, first + n - 1]))
    return first, first + n - 1


def last_number(spark: SparkSession, path: str, before: int | None = None) -> int:
    """The last number given, or that before an epoch; 0 if there is none."""
    epochs = [e for e in numbered(spark, f"{path}/events", "epoch") if before is None or e < before]
    return _range(spark, path, epochs[-1])[1] if epochs else 0


def number(batch: DataFrame, path: str, epoch: int) -> None:
    """Writes a micro-batch with seq, numbers without a gap after those of earlier epochs.

    Rows are written first and then counted by the task that wrote them, so nothing is gathered or sorted in one task;
    only those counts reach the driver. An epoch that is there already is left alone, as readers may have seen it."""
    spark = batch.sparkSession
    if exists(spark, f"{path}/events/epoch={epoch}/_SUCCESS"):
        return
    staged = f"{path}/staged/epoch={epoch}"
    batch.withColumn("__at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged).withColumn("__part", F.shiftright("__at", BITS))
    at, offsets = last_number(spark, path, epoch) + 1, []
    for part, n in sorted(map(tuple, rows.groupBy("__part").agg(F.count("*")).collect())):
        offsets.append((part, at))
        at += n
    first = F.broadcast(spark.createDataFrame(offsets, "__part long, __first long"))
    out = rows.join(first, "__part").withColumn("seq", F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << BITS) - 1)))
    out.drop("__part", "__at", "__first").write.mode("overwrite").parquet(f"{path}/events/epoch={epoch}")
    _range(spark, path, epoch)


def publish(stream: DataFrame, path: str, mode: str = "append", wait: bool = True):
    """Numbers each micro-batch of a stream; returns the query."""
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, epoch: number(batch, path, epoch)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


def events(spark: SparkSession, path: str, after: int = 0, upto: int | None = None) -> DataFrame | None:
    """Rows with after < seq <= upto; only epochs that hold some are read. None if there are none."""
    upto = last_number(spark, path) if upto is None else upto
    wanted = [e for e in numbered(spark, f"{path}/events", "epoch") for first, last in [_range(spark, path, e)] if first <= last and last > after and first <= upto]
    if not wanted:
        return None
    rows = spark.read.option("basePath", f"{path}/events").parquet(*(f"{path}/events/epoch={e}" for e in wanted))
    return rows.where((F.col("seq") > after) & (F.col("seq") <= upto))


class Reader:
    """A reader by name, who gets each event once as long as it commits what it has read."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.file = spark, path, f"{path}/readers/{name}"

    @property
    def offset(self) -> int:
        return int(read_text(self.spark, self.file) or 0)

    def poll(self) -> tuple[DataFrame | None, int]:
        """(events since the last commit, the number to commit once they are dealt with)."""
        last = last_number(self.spark, self.path)
        return events(self.spark, self.path, self.offset, last), last

    def commit(self, last: int) -> None:
        write_text(self.spark, self.file, str(last))
