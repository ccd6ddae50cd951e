"""The engine in one object, and a command line: python -m quire.api IN OUT -l LANGUAGE -m MODEL -k KEY."""

from __future__ import annotations

import argparse
import contextlib
import importlib
import re
import shlex
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conf import DEFAULT_TOKEN_LIMIT, LANGUAGES, MODEL_TOKEN_LIMITS, EngineConf, Settings, engine_conf
from .functions.text import page_size_css
from .operators import assemble, batching, layout, ledger, metrics, pages, translate
from .operators.ledger import exists
from .operators.providers import ROUTES, ChatCompletions, Providers, key_of, route_of
from .operators.translate import Translator
from .sources.sinks import print_documents
from .sources.tables import compile_documents, html_files, is_pdf, pdf_properties, pdf_structure, pending


class Engine:
    """Laid-out documents (key, html) to translated ones. Steps are DataFrames, so each can be written and resumed.

    on_status gets the name of each step. on_progress gets the segments done and in all, while replies come in and once
    more when they are assembled; it runs on a thread of its own meanwhile. cancelled is asked inside the tasks before
    each attempt. Without a transformer each model goes to its provider's service, or all to conf.base_url."""

    def __init__(
        self, translator: Translator | None = None, conf: EngineConf | None = None, key: str = "doc_id", on_status: Callable[[str], None] = lambda message: None,
        on_progress: Callable[[int, int], None] = lambda done, total: None, cancelled: Callable[[], bool] = lambda: False,
    ):
        self.conf, self.key, self.on_status, self.on_progress, self.cancelled = conf or EngineConf(), key, on_status, on_progress, cancelled
        c = self.conf
        self.translator = translator or (
            ChatCompletions(c.base_url, c.temperature, key=c.keys.get("", ""), calls=c.calls, pace=c.pace) if c.base_url else Providers(c.keys, c.temperature, routes=tuple(replace(r, calls=c.calls, pace=c.pace) for r in ROUTES))
        )

    def laid(self, docs: DataFrame) -> DataFrame:
        """The documents parsed, one row for each; segments and pages come from it. Write it to parse once."""
        return layout.laid(docs, self.key, threshold=self.conf.threshold_px, word_space=self.conf.word_space_px)

    def segments(self, docs: DataFrame) -> DataFrame:
        return layout.segments(docs, self.key, threshold=self.conf.threshold_px, word_space=self.conf.word_space_px)

    def batches(self, segments: DataFrame, done: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
        """Batches of what is still to do: on the target pages (key, page_idx) if given, without what is done (key, seg_id)."""
        if done is not None:
            segments = assemble.remaining(segments, done, self.key)
        if targets is not None:
            segments = pages.on_pages(segments, targets, self.key)
        limit = self.conf.token_limit or MODEL_TOKEN_LIMITS.get(self.conf.model, DEFAULT_TOKEN_LIMIT)
        return batching.batches(segments, self.key, "seg_no", limit, self.conf.max_segments)

    def replies(self, batched: DataFrame, with_context: bool = False, ledger: str = "", run: str = "") -> DataFrame:
        """One row for each batch, failed ones with an error. Write it: without a ledger, reading it twice would ask twice."""
        return translate.translate_batches(batched, self.translator, self.conf, self.key, with_context, cancelled=self.cancelled, ledger=ledger, run=run)

    @contextlib.contextmanager
    def watched(self, spark: SparkSession, folder: str, before: int, total: int, seconds: float = 0.25) -> Iterator[None]:
        """Tells on_progress whenever more segments are answered in the files of a ledger's folder."""
        ended, told = threading.Event(), before

        def look() -> None:
            nonlocal told
            while not ended.wait(seconds):
                done = min(total, before + ledger.answered(spark, folder))
                if done > told:
                    told = done
                    self.on_progress(done, total)

        watcher = threading.Thread(target=look, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            ended.set()
            watcher.join()

    def assemble(self, segments: DataFrame, replies: DataFrame) -> DataFrame:
        return assemble.assemble(segments, assemble.last_items(assemble.items(replies, self.key), self.key), self.key)

    def render(self, docs: DataFrame, assembled: DataFrame, sizes: DataFrame | None = None, bilingual: bool = False, laid: DataFrame | None = None) -> DataFrame:
        """(key, html): the documents with their translations in place; bilingual keeps the originals as titles."""
        found = self.laid(docs) if laid is None else laid
        return assemble.render(layout.wrapped_of(found, self.key, assembled, bilingual), self.key, sizes)

    def instrument(self, docs: DataFrame) -> DataFrame:
        """(key, html): the documents with addressable segments and every page waiting; nothing is translated yet."""
        return assemble.render(layout.wrapped_of(self.laid(docs), self.key), self.key, waiting=True)

    def properties(self, segments: DataFrame, assembled: DataFrame) -> DataFrame:
        return metrics.document_properties(segments, assembled.where("status IN ('ok', 'duplicate')"), self.key)

    def translate(self, docs: DataFrame, work: str, with_context: bool = False, sizes: DataFrame | None = None, resume: bool = False) -> DataFrame:
        """(key, html) of docs, with the steps as tables under the folder `work`; replies lie under the target language.

        Each answer is committed to a ledger as it comes, so a task that is tried again doesn't ask twice. With resume,
        segments that earlier replies in the same language have translated aren't asked for again, and neither are
        batches that an earlier run was answered before it broke off. `work` has to be a folder that driver and tasks share."""
        spark = docs.sparkSession
        here = f"{work}/{re.sub('[^A-Za-z]+', '-', self.conf.target_language).lower()}"

        def step(path: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
            self.on_status(path.rpartition("/")[2])
            df.write.mode(mode).parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        laid = step(f"{work}/laid", self.laid(docs))
        segments = step(f"{work}/segments", layout.segments_of(laid, self.key))
        done = None
        if resume and exists(spark, f"{here}/replies"):
            done = assemble.last_items(assemble.items(spark.read.parquet(f"{here}/replies"), self.key), self.key)
        batched = step(f"{here}/batches", self.batches(segments, done))
        total, pending = segments.count(), batched.agg(F.sum("n_segments")).first()[0] or 0
        run = uuid.uuid4().hex
        books = f"{here}/ledger" if resume else f"{here}/ledger/fresh-{run}"
        with self.watched(spark, f"{books}/run-{run}", total - pending, total):
            replies = step(f"{here}/replies", self.replies(batched, with_context, books, run), "append" if resume else "overwrite")
        assembled = step(f"{here}/assembled", self.assemble(segments, replies))
        counted = assembled.agg(F.count_if(F.col("status") != "missing"), F.count("*")).first()
        self.on_progress(int(counted[0]), int(counted[1]))
        return self.render(docs, assembled, sizes, laid=laid)

    def translate_files(self, files: DataFrame, work: str, compiler: list[str], printer: list[str] | None = None, with_context: bool = False, timeout: float | None = None, resume: bool = False) -> DataFrame:
        """(path, html) of PDF files (path, content), or with a printer (path, content, error); key has to be path.

        Files that `work` holds compiled already aren't compiled again. Page sizes come from the files."""
        spark = files.sparkSession
        files = files.where(is_pdf(F.col("path"))).select("path", "content")
        compiled = f"{work}/compiled"
        todo = pending(files, spark.read.parquet(compiled)) if exists(spark, compiled) else files
        self.on_status("compiled")
        compile_documents(todo, compiler, timeout).where("html IS NOT NULL").write.mode("append").parquet(compiled)
        docs = spark.read.parquet(compiled).select("path", "html").join(files.select("path"), "path", "left_semi")
        sizes = pdf_properties(files, pdf_structure(files)).select("path", page_size_css(F.col("page_size")).alias("size_css"))
        pages = self.translate(docs, work, with_context, sizes, resume)
        return print_documents(pages, printer, "path", timeout=timeout) if printer else pages


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input", help="positioned HTML or PDF files, as a path that Spark reads")
    parser.add_argument("output", help="folder for the tables")
    parser.add_argument("-l", "--language", help="language code or name")
    parser.add_argument("-m", "--model", default=EngineConf.model)
    parser.add_argument("-k", "--key", default="", help="key of the service; else the model's environment variable")
    parser.add_argument("-t", "--temperature", type=float)
    parser.add_argument("--settings", help="a settings file; options given here win")
    parser.add_argument("--base-url", help="a service of the usual chat form")
    parser.add_argument("--translator", help="module:callable that makes the transformer, instead of a service")
    parser.add_argument("--compiler", help="command with {in} and {out} that turns a PDF into positioned HTML")
    parser.add_argument("--printer", help="command with {in} and {out} that prints a page")
    parser.add_argument("--context", action="store_true", help="give each batch the last translations before it")
    parser.add_argument("--resume", action="store_true", help="don't ask again for what earlier runs have translated")
    a = parser.parse_args(args)
    given = {"model": a.model, "target_language": a.language and LANGUAGES.get(a.language, a.language), "temperature": a.temperature, "base_url": a.base_url, "keys": {"": a.key} if a.key else None}
    given = {k: v for k, v in given.items() if v is not None}
    conf = engine_conf(Settings(a.settings), **given) if a.settings else EngineConf(**given)
    translator = None
    if a.translator:
        module, _, name = a.translator.partition(":")
        translator = getattr(importlib.import_module(module), name)()
    elif not conf.base_url and route_of(conf.model) is None:
        parser.error(f"no service is known for model {conf.model}: give --base-url or --translator")
    elif not conf.base_url and key_of(conf.model, conf.keys) is None:
        parser.error(f"no key for {route_of(conf.model).provider}: give -k, a settings file with keys or its environment variable, or --base-url or --translator")
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(translator, conf, key="path", on_status=print, on_progress=lambda done, total: print(f"{done} of {total} segments"))
    work = f"{a.output}/work"
    if a.compiler:
        files = spark.read.format("binaryFile").load(a.input)
        out = engine.translate_files(files, work, shlex.split(a.compiler), shlex.split(a.printer) if a.printer else None, a.context, resume=a.resume)
        out.write.mode("overwrite").parquet(f"{a.output}/{'pdf' if a.printer else 'html'}")
    else:
        engine.translate(html_files(spark, a.input), work, a.context, resume=a.resume).write.mode("overwrite").parquet(f"{a.output}/html")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
