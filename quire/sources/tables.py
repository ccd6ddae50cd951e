"""Sources: documents as lines and words, settings, PDF headers, compile logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, page_size_text, pdf_date
from .pdf import structures

LINES_A_PAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame, lines_a_page: int = LINES_A_PAGE) -> DataFrame:
    """Plain text as segments: (doc_id, pos, text, page_idx, seg_id), one for each line."""
    at = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return at.select("doc_id", "pos", "text", F.expr(f"pos div {lines_a_page}").cast("int").alias("page_idx"), F.concat(F.lit("g-"), F.col("pos").cast("string")).alias("seg_id"))


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word): words between blanks, in order from 0."""
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("pos", "word"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): one row for each file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def pdf_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_mb, version, linearized) from the first 1024 bytes of PDF files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.format_number(F.col("length") / 1048576, 2).alias("size_mb"), *header_fields(F.substring("content", 1, 1024)))


def header_fields(head: Column) -> list[Column]:
    text = F.decode(head, "ISO-8859-1")
    return [F.nullif(F.regexp_extract(text, r"%PDF-(\d\.\d)", 1), F.lit("")).alias("version"), F.contains(text, F.lit("/Linearized")).alias("linearized")]


def is_pdf(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".pdf"))


def compile_progress(log: DataFrame, line: str = "value") -> DataFrame:
    """(current, total) of the lines that report Working: n/m."""
    mark = r"Working:\s*(\d+)/(\d+)"
    return log.where(F.col(line).rlike(mark)).select(F.regexp_extract(line, mark, 1).cast("int").alias("current"), F.regexp_extract(line, mark, 2).cast("int").alias("total"))


def pending(docs: DataFrame, compiled: DataFrame, key: str = "path") -> DataFrame:
    """Documents without a compiled artifact that isn't empty."""
    return docs.join(compiled.where(F.length("html") > 0), key, "left_anti")


def compile_documents(files: DataFrame, command: list[str], timeout: float | None = None) -> DataFrame:
    """(path, html, error): runs an external compiler on each binary row (path, content) inside the tasks.

    The command gets the input and output names in place of {in} and {out}. A failed, missing or timed-out command
    gives a null html and an error."""
    import os
    import subprocess
    import tempfile

    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with tempfile.TemporaryDirectory() as d:
                    source, out = os.path.join(d, "in.pdf"), os.path.join(d, "out.html")
                    with open(source, "wb") as f:
                        f.write(content)
                    try:
                        done = subprocess.run([c.replace("{in}", source).replace("{out}", out) for c in command], cwd=d, capture_output=True, timeout=timeout)
                        html = open(out, encoding="utf-8").read() if done.returncode == 0 and os.path.exists(out) else None
                        rows.append((path, html, None if html else f"exit {done.returncode}"))
                    except (OSError, subprocess.TimeoutExpired) as e:
                        rows.append((path, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "html", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, html string, error string")


#: Text properties of a document's info, the entry that holds them, and what stands for nothing.
INFO = {"title": ("Title", "Unknown"), "subject": ("Subject", "Unknown"), "creator": ("Creator", "Unknown"), "author": ("Author", "Unknown"), "producer": ("Producer", "Unknown"), "keywords": ("Keywords", "None"), "created_date": ("CreationDate", "Unknown"), "mod_date": ("ModDate", "Unknown")}


def scanned_structure(content: Column) -> dict[str, Column]:
    """What the plain objects of a PDF say, found by built-in expressions on its bytes; null where they say nothing.

    Objects inside compressed streams and inherited boxes aren't seen; pdf_structure() reads those."""
    text = F.decode(content, "ISO-8859-1")
    number = r"\s*(-?[0-9.]+)"
    box = rf"/MediaBox\s*\[{number}{number}{number}{number}"
    side = lambda a, b: F.regexp_extract(text, box, b).try_cast("double") - F.regexp_extract(text, box, a).try_cast("double")
    plain = lambda raw: F.regexp_replace(raw, r"\\([()\\])", "$1")
    info = {name: plain(F.nullif(F.regexp_extract(text, rf"/{entry}\s*\(((?:\\.|[^\\()])*+)\)", 1), F.lit(""))) for name, (entry, _) in INFO.items()}
    pages = F.regexp_count(text, F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    return {"pages": F.when(pages > 0, pages), "width_pt": side(1, 3), "height_pt": side(2, 4), "tagged": F.when(text.rlike("/MarkInfo|/StructTreeRoot"), True), **info}


def pdf_properties(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(path, file_size, pdf_version, linearized, tagged, page_size, pages_count, title ... mod_date) of rows (path, content).

    From the first 1024 bytes and the plain objects; parsed, a frame of pdf_structure(), goes before where it knows more.
    Nothing known gives Unknown (None for keywords), a version that isn't told is 1.4, an untitled document with an info
    is called by its file."""
    head = header_fields(F.substring("content", 1, 1024))
    seen = scanned_structure(F.col("content"))
    rows = files.select("path", F.length("content").alias("size"), *head, *[c.alias(n) for n, c in seen.items()])
    if parsed is not None:
        known = parsed.select("path", *[F.col(n).alias(f"__{n}") for n in seen])
        rows = rows.join(known, "path", "left").select("path", "size", "version", "linearized", *[F.coalesce(f"__{n}", n).alias(n) for n in seen])
    size = F.when(F.col("width_pt").isNotNull(), page_size_text(F.col("width_pt"), F.col("height_pt"))).otherwise("Unknown")
    any_info = F.coalesce(*[F.col(n) for n in INFO]).isNotNull()
    stem = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")
    told = {n: F.coalesce(n, F.lit(nothing)) for n, (_, nothing) in INFO.items()} | {"title": F.coalesce("title", F.when(any_info, stem), F.lit("Unknown")), "created_date": pdf_date(F.col("created_date")), "mod_date": pdf_date(F.col("mod_date"))}
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    return rows.select(
        "path", F.concat(F.format_number(F.col("size") / 1048576, 2), F.lit(" MB")).alias("file_size"), F.concat(F.lit("PDF-"), F.coalesce("version", F.lit("1.4"))).alias("pdf_version"), yes(F.col("linearized")).alias("linearized"),
        yes(F.col("tagged")).alias("tagged"), size.alias("page_size"), F.coalesce("pages", F.lit(0)).alias("pages_count"), *[c.alias(n) for n, c in told.items()],
    )


def pdf_structure(files: DataFrame) -> DataFrame:
    """(path, pages, width_pt, height_pt, tagged, title ... mod_date, error) of binary rows (path, content).

    From the page tree, with boxes that pages inherit, and the info, objects in compressed streams included. A file that
    can't be read has nulls, and error says why."""
    return structures(files, {name: entry for name, (entry, _) in INFO.items()})
