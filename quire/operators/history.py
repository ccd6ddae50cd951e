"""Recent files and look-ups with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, path_key

KEPT = 20


def recent(opened: DataFrame, kept: int = KEPT) -> DataFrame:
    """(rank, name, path): the files opened last, one row for each normalized path; opened (path, ts).

    A top-k: only `kept` rows leave each task."""
    last = opened.withColumn("path", path_key(F.col("path"))).groupBy("path").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "path").limit(kept)
    return last.select(F.row_number().over(Window.orderBy(F.desc("ts"), "path")).alias("rank"), base_name(F.col("path")).alias("name"), "path")


def existing(files: DataFrame, listing: DataFrame) -> DataFrame:
    """files (path, ...) that the listing (path) has."""
    return files.join(listing.select("path").distinct(), "path", "left_semi")


def localized(keys: DataFrame, texts: DataFrame, fallback: str = "en") -> DataFrame:
    """keys (locale, key) with text: that of the locale, else of the fallback locale, else the key; texts (locale, key, text)."""
    own = keys.join(texts.withColumnRenamed("text", "own"), ["locale", "key"], "left")
    other = texts.where(F.col("locale") == fallback).select("key", F.col("text").alias("other"))
    return own.join(other, "key", "left").withColumn("text", F.coalesce("own", "other", "key")).select("locale", "key", "text")


def setting(settings: Column, section: str, key: str, default: str) -> Column:
    """A value of a two-level map, or the default."""
    return F.coalesce(F.try_element_at(F.try_element_at(settings, F.lit(section)), F.lit(key)), F.lit(default))


def provider_ready(provider: Column, key: Column) -> Column:
    """A provider is ready with a key; local models need none."""
    return (F.trim(F.coalesce(key, F.lit(""))) != "") | F.contains(F.lower(provider), F.lit("ollama"))
