"""Small files and folders in the store that Spark writes to, from the driver."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def store(spark: SparkSession, path: str):
    """(file system, path) as the store's own objects."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = store(spark, path)
    return fs.exists(where)


def clear(spark: SparkSession, path: str) -> bool:
    """Deletes a work folder, wherever Spark keeps it."""
    fs, where = store(spark, path)
    return fs.delete(where, True)


def move(spark: SparkSession, old: str, new: str) -> bool:
    fs, where = store(spark, old)
    return fs.rename(where, store(spark, new)[1])


def names(spark: SparkSession, path: str) -> list[str]:
    fs, where = store(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers N of the folders name=N that Spark has written whole."""
    found = (re.fullmatch(rf"{name}=(\d+)", n) for n in names(spark, path))
    return sorted(int(m[1]) for m in found if m and exists(spark, f"{path}/{m[0]}/_SUCCESS"))


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """False if the file is there and mustn't be overwritten."""
    from py4j.protocol import Py4JJavaError

    fs, where = store(spark, path)
    try:
        out = fs.create(where, overwrite)
    except Py4JJavaError as e:
        if not overwrite and fs.exists(where):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = store(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
