"""A ledger of replies: what a transformer has answered is committed from inside the task, so that it is paid for once.

An entry is known by the content of its batch: prompt, model and segments. Each attempt of a task writes files of its
own, a few entries in each, and closes them as it goes; so what a lost executor or a cancelled run has had answered is
found again by the next attempt or run, and nothing is written twice to one file. Files are written by temporary name and
move, through the file system that the folder's address names."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "id string, items array<struct<id:string,translated:string>>, attempts int, model string"
#: Name of a file: what tells an attempt apart, a number in the attempt, segments answered.
_NAME = re.compile(r"(\w+)-(\d+)-n(\d+)\.json$")


def content_id(segments: Column, system: str, model: str) -> Column:
    """Names a batch by what is asked and of whom; equal batches of different documents share it."""
    return F.sha2(F.concat_ws("\x00", F.lit(system), F.lit(model), F.to_json(segments)), 256)


def _store(path: str):
    """(file system, folder) of an address, in a task or on the driver."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class Writer:
    """Commits entries of one attempt of a task to the folder of its partition, `every` to a file."""

    def __init__(self, path: str, partition: int, every: int = 4):
        self.store, self.folder = _store(f"{path}/p{partition}")
        self.name, self.every, self.entries, self.number = uuid.uuid4().hex, every, [], 0
        self.store.create_dir(self.folder, recursive=True)

    def add(self, entry: dict) -> None:
        self.entries.append(entry)
        if len(self.entries) >= self.every:
            self.commit()

    def commit(self) -> None:
        if not self.entries:
            return
        answered = sum(len(e["items"]) for e in self.entries)
        name = f"{self.folder}/{self.name}-{self.number}-n{answered}.json"
        hidden = f"{self.folder}/_{self.name}-{self.number}"  # readers skip names that start so
        with self.store.open_output_stream(hidden) as f:
            f.write("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in self.entries).encode())
        self.store.move(hidden, name)
        self.entries, self.number = [], self.number + 1


def earlier(path: str, partition: int) -> dict[str, dict]:
    """Entries that other attempts of a task have committed, by id."""
    from pyarrow import fs

    store, folder = _store(f"{path}/p{partition}")
    found = {}
    for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if _NAME.search(info.path) and not info.base_name.startswith("_"):
            with store.open_input_stream(info.path) as f:
                found |= {entry["id"]: entry for entry in map(json.loads, f.read().decode().split("\n")[:-1])}
    return found


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """ENTRY of all runs under a folder, one row for each id."""
    schema = StructType.fromDDL(ENTRY)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).where("id IS NOT NULL")
    return rows.groupBy("id").agg(F.first(F.struct("items", "attempts", "model")).alias("e")).select("id", "e.*")


def answered(spark: SparkSession, path: str) -> int:
    """Segments that the files of a folder answer, by their names alone; for progress while tasks run.

    A segment that two attempts were asked for counts twice."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return 0
    total, files = 0, store.listFiles(where, True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if (at := _NAME.search(name)) and not name.startswith("_"):
            total += int(at[3])
    return total
