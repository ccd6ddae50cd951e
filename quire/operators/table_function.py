"""The transformer as a table function of SQL: translate(TABLE(batches) PARTITION BY key ORDER BY batch_no)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..conf import EngineConf
from .replies import items_of
from .translate import CONTEXT_HEAD, CONTEXT_TAIL, RESULT, Translator, call, system_prompt


def register(spark: SparkSession, translator: Translator, conf: EngineConf | None = None, key: str = "doc_id", key_type: str = "bigint", with_context: bool = False, name: str = "translate", sleep: Callable[[float], None] = time.sleep):
    """Registers name(TABLE(t) PARTITION BY key ORDER BY batch_no) over batches (key, batch_no, segments), as
    translate_batches() takes and gives them.

    A partition is one document, whose batches come in order; with context each is asked for with the last translations
    before it. Without PARTITION BY every batch has to stand for itself. Partitions run in parallel."""
    conf = conf or EngineConf()
    system = system_prompt(conf.target_language, conf.glossary)

    class Translate:
        def __init__(self):
            self.context: list[str] = []

        def eval(self, row):
            head = CONTEXT_HEAD + "\n".join(self.context) + CONTEXT_TAIL if self.context else ""
            message = head + json.dumps([{"id": s["id"], "text": s["text"]} for s in row["segments"]], ensure_ascii=False)
            found, attempts, model, error = call(translator, system, message, conf, sleep)
            items = items_of(found)
            if with_context and conf.context_size:
                self.context += [i["translated"] for i in items or () if i["id"] and i["translated"] and i["translated"].strip()]
                self.context = self.context[-conf.context_size :]
            yield row[key], int(row["batch_no"]), None if items is None else [(i["id"], i["translated"]) for i in items], attempts, model, error or None

    made = udtf(Translate, returnType=f"`{key}` {key_type}, {RESULT}")
    spark.udtf.register(name, made)
    return made


def translate_table(batched: DataFrame, translator: Translator, conf: EngineConf | None = None, key: str = "doc_id", with_context: bool = False, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """translate_batches() by the table function: one partition for each document."""
    spark, name = batched.sparkSession, f"translate_{uuid.uuid4().hex}"
    register(spark, translator, conf, key, batched.schema[key].dataType.simpleString(), with_context, name, sleep)
    batched.createOrReplaceTempView(f"batches_of_{name}")
    return spark.sql(f"SELECT * FROM {name}(TABLE(batches_of_{name}) PARTITION BY `{key}` ORDER BY batch_no)")
