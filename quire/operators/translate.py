"""Batches through a text transformer: prompts, replies, retries within one provider."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import PROVIDERS, RETRY_DELAYS, EngineConf
from ..functions.text import RATE_LIMIT
from . import ledger as ledgers
from .providers import ChatCompletions, Providers, Route, key_of, route_of  # noqa: F401
from .replies import ITEMS, items_of, parse_reply, read_reply  # noqa: F401

FAILED = "[TRANSLATION FAILED] "


class Translator(Protocol):
    """Anything that turns (system prompt, user message, model) into a reply. It may raise."""

    def __call__(self, system: str, message: str, model: str) -> str: ...


class Echo:
    """A deterministic transformer for tests: answers every segment with a mark before its text."""

    def __init__(self, mark: str = "[x] "):
        self.mark = mark

    def __call__(self, system: str, message: str, model: str) -> str:
        payload = message.rpartition(CONTEXT_TAIL)[2]
        return json.dumps([{"id": s["id"], "translated": self.mark + s["text"]} for s in json.loads(payload)], ensure_ascii=False)


def system_prompt(language: str, glossary: str = "") -> str:
    """What the transformer is asked for: prose in the target language, tags kept, one JSON item for each segment."""
    rules = [
        f"Translate each text into {language}, in a formal and natural register.",
        "Join words that line ends or hyphens have split. Keep numbers, formulas, citations, acronyms and names.",
        "Keep tags such as <b>, <i>, <sup>, <fs_N> and <color_HEX> around the words they mark; never translate, drop or repeat them.",
        'The input is a JSON array of {"id", "text"}. Answer with nothing but a JSON array of {"id", "translated"}: same ids, same length, same order.',
    ]
    if glossary and glossary.strip():
        rules.append(f"Follow this glossary:\n{glossary.strip()}")
    return "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))


def system_prompt_column(language: Column, glossary: Column | None = None) -> Column:
    mark = "\x01"
    base = F.replace(F.lit(system_prompt(mark)), F.lit(mark), language)
    if glossary is None:
        return base
    return F.when(F.trim(F.coalesce(glossary, F.lit(""))) != "", F.concat(base, F.lit("\n5. Follow this glossary:\n"), F.trim(glossary))).otherwise(base)


def segments_json(segments: Column) -> Column:
    """A JSON array of {"id", "text"} with ", " and ": " between its parts."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")
    item = lambda s: F.concat(F.lit('{"id": '), quoted(s["id"]), F.lit(', "text": '), quoted(s["text"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(segments, item), ", "), F.lit("]"))


#: The lines around the context of a message.
CONTEXT_HEAD = "[PREVIOUS CONTEXT — do NOT translate, use for consistency only]\n[PREVIOUS CONTEXT — BEGIN]\n"
CONTEXT_TAIL = "\n[PREVIOUS CONTEXT — END]\n\n[SEGMENTS TO TRANSLATE]\n"


def user_message(segments: Column, context: Column) -> Column:
    """The batch as JSON, after the context if there is one."""
    return F.concat(F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(CONTEXT_HEAD), context, F.lit(CONTEXT_TAIL))).otherwise(""), segments_json(segments))


def catalogue() -> Column:
    """The providers as an array of structs; fixed and small, so that a look-up needs no join."""
    one = lambda name, prefix, models: F.struct(F.lit(name).alias("provider"), F.lit(prefix).alias("prefix"), F.array(*map(F.lit, models)).cast("array<string>").alias("models"))
    return F.array(*(one(p[0], p[1], p[3]) for p in PROVIDERS))


def provider_at(place: Column) -> Column:
    """The provider at a place of the catalogue, from 0, as a struct."""
    return F.get(catalogue(), place)


def provider_of(models: DataFrame) -> DataFrame:
    """models (model) with provider, prefix and models: the first of the catalogue whose prefix the model has, else null."""
    found = models.withColumn("__p", F.get(F.filter(catalogue(), lambda p: F.startswith(F.col("model"), p["prefix"])), F.lit(0)))
    return found.select(*(found[c] for c in models.columns), *(F.col("__p")[c].alias(c) for c in ("provider", "prefix", "models")))


def qualified(model: Column, prefix: Column) -> Column:
    return F.when(F.startswith(model, prefix), model).otherwise(F.concat(prefix, model))


def fallback(models: DataFrame) -> DataFrame:
    """models (model, has_key) with fallback_model: the next model of the same provider, its first if the model isn't
    listed; null without a provider, a next model or a key."""
    at = provider_of(models)
    full = F.transform("models", lambda m: qualified(m, F.col("prefix")))
    return at.withColumn("fallback_model", F.when(F.col("has_key") & F.col("prefix").isNotNull(), F.get(full, F.array_position(full, F.col("model")).cast("int")))).drop("provider", "prefix", "models")


def retry_delay(attempt: Column) -> Column:
    """Seconds to wait after an attempt, from 0."""
    return F.element_at(F.array(*map(F.lit, RETRY_DELAYS)), F.least(attempt, F.lit(len(RETRY_DELAYS) - 1)) + 1) * (attempt + 1)


def next_model(model: str, keys: dict, key: str = "") -> str | None:
    """fallback() for one model, inside a task."""
    for provider, prefix, listed in ((p[0], p[1], p[3]) for p in PROVIDERS):
        if model.startswith(prefix):
            full = [m if m.startswith(prefix) else prefix + m for m in listed]
            rest = full[full.index(model) + 1 :] if model in full else full
            return rest[0] if rest and (keys.get(provider) or key) else None
    return None


def call(translator: Translator, system: str, message: str, conf: EngineConf, sleep: Callable[[float], None] = time.sleep, cancelled: Callable[[], bool] = lambda: False) -> tuple[list[dict] | None, int, str, str]:
    """(items, attempts, model, error). From the third attempt on the provider's next model is tried, step by step.

    After each failure the attempt's delay is waited; cancelled() is asked before and after. An error that means that the
    rate is limited says so."""
    model, error = conf.model, ""
    for attempt in range(conf.max_retries):
        if cancelled():
            return None, attempt, model, "cancelled"
        if attempt >= 2:
            model = next_model(model, conf.keys, conf.keys.get("", "")) or model
        try:
            items = read_reply(translator(system, message, model))
            if items is not None:
                return items, attempt + 1, model, ""
            error = "reply without a list"
        except Exception as e:  # a transformer may raise anything; the row reports it
            error = f"{type(e).__name__}: {e}"
        if any(x in error.lower() for x in RATE_LIMIT):
            error = f"rate limited: {error}"
        if attempt + 1 < conf.max_retries:
            sleep(RETRY_DELAYS[min(attempt, len(RETRY_DELAYS) - 1)] * (attempt + 1))
            if cancelled():
                return None, attempt + 1, model, "cancelled"
    return None, conf.max_retries, model, error


RESULT = f"batch_no int, items {ITEMS}, attempts int, model string, error string"


def translate_batches(
    batched: DataFrame, translator: Translator, conf: EngineConf | None = None, key: str = "doc_id", with_context: bool = False, sleep: Callable[[float], None] = time.sleep, cancelled: Callable[[], bool] = lambda: False,
    ledger: str = "", run: str = "",
) -> DataFrame:
    """(key, batch_no, items, attempts, model, error) of batches (key, batch_no, segments).

    Without context every batch is independent, and conf.calls of them are asked for at a time in each task. With context
    a document's batches run one after another in one task, each with the last translations before it; documents run in
    parallel. Write the result before using it twice. cancelled() is asked inside the tasks before each attempt, so it
    has to look at something that they see, such as a file in a shared folder; batches that come after it say "cancelled"
    in their error.

    ledger is a folder that driver and tasks share. Each answer is committed to it from inside the task, under its
    content, into the folder of this `run`. What any run has committed isn't asked for again, be it after a lost
    executor, in a later run or for a copy in another document; attempts is 0 there. Failed batches aren't committed.
    Attempts of a task that run at the same time may ask for the same batch."""
    conf = conf or EngineConf()
    system = system_prompt(conf.target_language, conf.glossary)
    key_type = batched.schema[key].dataType.simpleString()
    rows = batched.select(key, "batch_no", F.transform("segments", lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"))).alias("segments"))
    rows = rows.withColumn("id", ledgers.content_id(F.col("segments"), system, conf.model) if ledger else F.lit(None).cast("string"))
    own = f"{ledger}/run-{run or uuid.uuid4().hex}" if ledger else ""
    if ledger:
        rows = rows.join(ledgers.entries(batched.sparkSession, ledger).select("id", F.struct("items", "model").alias("known")), "id", "left")
        # equal batches meet in one task; a fixed number, as calls take long however small their rows are
        rows = rows.repartition(conf.tasks or batched.sparkSession.sparkContext.defaultParallelism, "id")
    else:
        rows = rows.withColumn("known", F.lit(None).cast(f"struct<items:{ITEMS},model:string>"))

    def message(segments, context: list[str]) -> str:
        head = CONTEXT_HEAD + "\n".join(context) + CONTEXT_TAIL if context else ""
        return head + json.dumps([{"id": s["id"], "text": s["text"]} for s in segments], ensure_ascii=False)

    class Asked:
        """What one task asks for: first of the ledger, then of the transformer."""

        def __init__(self):
            part = TaskContext.get().partitionId()
            self.known = ledgers.earlier(own, part) if own else {}
            self.writer = ledgers.Writer(own, part, conf.commit_every) if own else None
            self.lock, self.locks = threading.Lock(), {}

        def __call__(self, k, batch_no, segments, name, known, context: list[str]) -> tuple:
            with self.lock:  # of equal batches the first one asks
                turn = self.locks.setdefault(name, threading.Lock()) if own else threading.Lock()
            with turn:
                return self.answer(k, batch_no, segments, name, known, context)

        def answer(self, k, batch_no, segments, name, known, context: list[str]) -> tuple:
            if known is None or known["items"] is None:
                known = self.known.get(name)
            if known is not None:
                return k, int(batch_no), [dict(i) for i in known["items"]], 0, known["model"], None
            found, attempts, model, error = call(translator, system, message(segments, context), conf, sleep, cancelled)
            items = items_of(found)
            if self.writer and items is not None:
                with self.lock:
                    entry = {"id": name, "items": items, "attempts": attempts, "model": model}
                    self.known[name] = entry
                    self.writer.add(entry)
            return k, int(batch_no), items, attempts, model, error or None

        def close(self) -> None:
            if self.writer:
                self.writer.commit()

    names = [key, "batch_no", "items", "attempts", "model", "error"]
    fields = [key, "batch_no", "segments", "id", "known"]

    def independent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = Asked()
        try:
            with ThreadPoolExecutor(max(1, conf.calls)) as pool:
                for pdf in batches:
                    yield pd.DataFrame(list(pool.map(lambda r: asked(*r, []), pdf[fields].itertuples(index=False))), columns=names)
        finally:
            asked.close()

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        context: list[str] = []
        asked, out = Asked(), []
        try:
            for row in pdf.sort_values("batch_no")[fields].itertuples(index=False):
                out.append(asked(*row, context))
                context += [i["translated"] for i in out[-1][2] or () if i["id"] and i["translated"] and str(i["translated"]).strip()]
                context = context[-conf.context_size :] if conf.context_size else []
        finally:
            asked.close()
        return pd.DataFrame(out, columns=names)

    schema = f"`{key}` {key_type}, {RESULT}"
    return rows.groupBy(key).applyInPandas(in_order, schema) if with_context else rows.mapInPandas(independent, schema)


def translate_text(translator: Translator, text: str, conf: EngineConf | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """One text; with a mark in front if it fails."""
    items = call(translator, system_prompt((conf or EngineConf()).target_language), json.dumps([{"id": "g-0", "text": text}], ensure_ascii=False), conf or EngineConf(), sleep)[0]
    return next((i["translated"] for i in items or () if isinstance(i, dict) and i.get("translated")), FAILED + text)


def context_of(rows: DataFrame, key: str, order: list[str], text: str, size: int) -> DataFrame:
    """rows with context: the last `size` texts before a row, joined by line ends; null if there are none."""
    from pyspark.sql import Window

    if size <= 0:
        return rows.withColumn("context", F.lit(None).cast("string"))
    before = F.collect_list(text).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-size, -1))
    return rows.withColumn("context", F.when(F.size(before) > 0, F.array_join(before, "\n")))
