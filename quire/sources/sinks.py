"""Sinks: rendered documents as tables, text or printed files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped, strip_tags


def write_text(docs: DataFrame, path: str, key: str = "doc_id", html: str = "html", mode: str = "overwrite") -> None:
    """One folder for each document with its page as UTF-8 text; for exports of few documents."""
    docs.select(key, F.col(html).alias("value")).write.mode(mode).partitionBy(key).option("lineSep", "\n").text(path)


def _listed(rows: DataFrame, key: str, order: str, item: Column, between: str) -> DataFrame:
    """(key, body): the items of each document in order, joined."""
    each = rows.select(key, F.col(order).alias("__n"), item.alias("__item"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__item"))), lambda x: x["__item"]), between).alias("body"))


def bilingual_json(rows: DataFrame, key: str = "doc_id", order: str = "seg_no") -> DataFrame:
    """(key, json): one array for each document of rows (key, order, seg_id, page_idx, text, translated); null
    translations are left out."""
    item = F.to_json(F.struct(F.col("seg_id").alias("id"), F.col("page_idx").alias("page"), F.col("text").alias("source"), F.col("translated").alias("target")))
    return _listed(rows, key, order, item, ",\n").select(key, F.concat(F.lit("["), "body", F.lit("]")).alias("json"))


def bilingual_tmx(rows: DataFrame, source_language: str, target_language: str, key: str = "doc_id", order: str = "seg_no") -> DataFrame:
    """(key, tmx): a translation memory for each document of the same rows, without tags; what isn't translated is left out.

    Characters that XML doesn't allow are dropped."""
    plain = lambda c: escaped(F.regexp_replace(strip_tags(F.col(c)), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""))
    variant = lambda language, c: F.concat(F.lit(f'<tuv xml:lang="{language}"><seg>'), plain(c), F.lit("</seg></tuv>"))
    unit = F.concat(F.lit('<tu tuid="'), "seg_id", F.lit('">'), variant(source_language, "text"), variant(target_language, "translated"), F.lit("</tu>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4">\n<header srclang="{source_language}" datatype="plaintext" segtype="block" adminlang="en" o-tmf="none" creationtool="quire" creationtoolversion="1"/>\n<body>\n'
    return _listed(rows.where("translated IS NOT NULL"), key, order, unit, "\n").select(key, F.concat(F.lit(head), "body", F.lit("\n</body>\n</tmx>\n")).alias("tmx"))


def print_documents(docs: DataFrame, command: list[str], key: str = "doc_id", html: str = "html", timeout: float | None = None) -> DataFrame:
    """(key, content, error): runs an external printer on each page inside the tasks; {in} and {out} stand for its files."""
    import os
    import subprocess
    import tempfile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, page in zip(pdf[key], pdf[html], strict=True):
                with tempfile.TemporaryDirectory() as d:
                    source, out = os.path.join(d, "page.html"), os.path.join(d, "page.pdf")
                    with open(source, "w", encoding="utf-8") as f:
                        f.write(page or "")
                    try:
                        done = subprocess.run([c.replace("{in}", source).replace("{out}", out) for c in command], cwd=d, capture_output=True, timeout=timeout)
                        made = done.returncode == 0 and os.path.exists(out)
                        rows.append((k, open(out, "rb").read() if made else None, None if made else f"exit {done.returncode}"))
                    except (OSError, subprocess.TimeoutExpired) as e:
                        rows.append((k, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[key, "content", "error"])

    return docs.select(key, html).mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, content binary, error string")
