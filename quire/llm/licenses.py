"""License scans on the positional index: a file's rarest licence words are looked up in the postings of the templates.

A key phrase can only stand in a file that holds all its words, so the file's words of the highest IDF that lead to it
are the phrase's own two. Both are posted, in files that hold such a word only; their lists are intersected with the
template postings by relative position, and where they meet the key phrase is verified word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_key, table
from .positional import aligned, anchor_terms, folded, phrases_with_anchors, postings, words_of

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates: label, wordings of real notices, and the key phrases of which one has to stand in a file word by word.
#: A key phrase names the version where the label does; each makes a template with the first wording that holds it.
NOTICES = (
    ("gpl-3", (
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
        "licensed under the gnu general public license gpl version 3", "licensed under the gnu general public license v3", "licensed under the gnu general public license v 3", "licensed under the gnu general public license 3 0", "under the terms of version 3 of the gnu general public license",
        "licensed under the gnu gpl version 3", "licensed under the gnu gpl v3", "spdx license identifier gpl 3 0", "licensed under the gpl version 3", "licensed under the gpl v3", "licensed under the gplv3",
    ), (
        "gnu general public license version 3", "gnu general public license as published by the free software foundation either version 3", "gnu general public license as published by the free software foundation version 3",
        "gnu general public license gpl version 3", "gnu general public license v3", "gnu general public license v 3", "gnu general public license 3 0", "version 3 of the gnu general public license",
        "gnu gpl version 3", "gnu gpl v3", "gpl 3 0", "gpl version 3", "gpl v3", "gplv3",
    )),
    ("lgpl", (
        "licensed under the gnu lesser general public license", "under the terms of the gnu library general public license as published by the free software foundation", "licensed under the gnu lgpl",
        "spdx license identifier lgpl 2 1", "spdx license identifier lgpl 2 0", "spdx license identifier lgpl 3 0", "licensed under the lgpl version", "licensed under the lgpl v2", "licensed under the lgpl v3", "licensed under the lgplv2", "licensed under the lgplv3",
    ), ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl 2 1", "lgpl 2 0", "lgpl 3 0", "lgpl version", "lgpl v2", "lgpl v3", "lgplv2", "lgplv3")),
    ("agpl", (
        "licensed under the gnu affero general public license", "licensed under the gnu agpl", "spdx license identifier agpl 3 0", "licensed under the agpl version", "licensed under the agpl v3", "licensed under the agplv3",
    ), ("gnu affero general public license", "gnu agpl", "agpl 3 0", "agpl version", "agpl v3", "agplv3")),
    ("apache-2", (
        "licensed under the apache license version 2 0", "licensed under the apache license 2 0", "licensed under the apache license v2 0", "licensed under the apache license v 2 0", "licensed under the apache 2 0 license", "licensed under the apache 2 license",
        "you may obtain a copy of the license at http www apache org licenses license 2 0", "licensed under apache 2 0", "spdx license identifier apache 2 0",
    ), ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license v 2 0", "apache 2 0 license", "apache 2 license", "apache org licenses license 2 0", "under apache 2 0", "identifier apache 2 0")),
    *((label, (
        f"licensed under {short}", f"licensed under a creative commons {long[0]} international license", *(f"licensed under creative commons {name}" for name in long[1:]), f"to view a copy of this license visit http creativecommons org licenses {short[3:]}",
    ), (short, *(f"creative commons {name}" for name in long), f"creativecommons org licenses {short[3:]}")) for label, short, long in (
        ("cc-by-4", "cc by 4 0", ("attribution 4 0",)),
        ("cc-by-sa-4", "cc by sa 4 0", ("attribution sharealike 4 0", "attribution share alike 4 0")),
        ("cc-by-nc-4", "cc by nc 4 0", ("attribution noncommercial 4 0", "attribution non commercial 4 0")),
        ("cc-by-nd-4", "cc by nd 4 0", ("attribution noderivatives 4 0", "attribution noderivs 4 0", "attribution no derivatives 4 0", "attribution no derivs 4 0")),
    )),
    ("mit", (
        "released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of the software", "spdx license identifier mit", "licensed under mit", "released under mit", "this software is mit licensed",
    ), ("mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person obtaining a copy of the software", "license identifier mit", "licensed under mit", "released under mit", "mit licensed")),
    ("bsd", (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "use of this source code is governed by a bsd style license",
        "released under the bsd license", "released under the bsd 2 clause license", "released under the bsd 3 clause license", "released under the 2 clause bsd license", "released under the 3 clause bsd license",
    ), ("redistribution and use in source and binary forms", "bsd style license", "bsd license", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd")),
    ("mpl-2", (
        "subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "licensed under the mozilla public license 2 0", "licensed under the mozilla public license v2 0", "licensed under the mozilla public license mpl version 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "licensed under the mpl version 2 0", "licensed under the mpl v2", "licensed under the mplv2",
    ), ("mozilla public license v 2 0", "mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mozilla public license mpl version 2 0", "mpl 2 0", "mpl version 2 0", "mpl v2", "mplv2")),
    ("unlicense", (
        "this is free and unencumbered software released into the public domain", "released under the unlicense", "for more information please refer to http unlicense org", "spdx license identifier unlicense",
    ), ("free and unencumbered software", "the unlicense", "unlicense org", "identifier unlicense")),
)
#: The GPL's notices of both versions read alike.
_GPL_2 = ("gpl-2", *(tuple(t.replace("version 3", "version 2").replace("v3", "v2").replace("v 3", "v 2").replace(" 3 0", " 2 0") for t in ts) for ts in NOTICES[0][1:]))
#: Templates: label, wording, key phrase.
TEMPLATES = tuple((label, next(t for t in texts if f" {key} " in f" {t} "), key) for label, texts, keys in (*NOTICES, _GPL_2) for key in keys)
#: Words around a posted word: no template reaches further.
REACH = max(len(text.split()) for _, text, _ in TEMPLATES)


def phrase_table(spark: SparkSession) -> DataFrame:
    """(phrase, words, label, base, template, shift): key phrases, the words of their templates, and their offset in them.

    Literals, so that no Python worker makes them."""
    rows = [(key, label, True, key, 0) for key, label in BASE.items()]
    rows += [(key, label, False, text, len(f" {text} ".split(f" {key} ")[0].split())) for label, text, key in TEMPLATES]
    values = ", ".join(f"({i}L, '{key}', '{label}', {str(base).lower()}, '{text}', {shift})" for i, (key, label, base, text, shift) in enumerate(rows))
    return spark.sql(f"SELECT phrase, split(key, ' ') AS words, label, base, split(template, ' ') AS template, shift FROM VALUES {values} AS t(phrase, key, label, base, template, shift)")


def holds(text: Column, terms: list[str]) -> Column:
    """The distinct terms that a text holds as words; case doesn't count here."""
    return F.array_intersect(words_of(F.lower(text)), F.array(*map(F.lit, terms)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, k, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    A base place is where a base phrase's words stand consecutively. A template counts if its key phrase stands word
    by word; score is the best share of a template's words that stand at their positions relative to it, 0 without a
    key phrase. Null texts are empty; without base places first_word and last_word are null. Repeated rows come out
    repeated; rows that share an id are scanned apart; texts of any length are scanned whole; ties in IDF go to the
    phrase's earlier word; extra columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), row_key("doc_id", "text").alias("k"), "text")
    phrases = phrase_table(spark)
    terms = sorted({w for key in [*BASE, *(t[2] for t in TEMPLATES)] for w in key.split()})
    files = materialize(rows.select("doc_id", "d", "k", words_of(F.lower("text")).alias("w")).select("doc_id", "d", "k", F.size("w").cast("long").alias("n_words"), F.array_intersect("w", F.array(*map(F.lit, terms))).alias("terms")))
    found = files.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    known = spark.sql("SELECT explode(split('" + " ".join(terms) + "', ' ')) AS term")
    counts = materialize(known.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")))  # the documents of each term, over all rows
    anchored = materialize(phrases_with_anchors(phrases.select("phrase", "words"), counts))
    rare = sorted(r[0] for r in anchored.select("t1").distinct().collect())  # at most one for each key phrase
    posted = materialize(anchor_terms(anchored))
    held = rows.where(F.size(holds(F.col("text"), rare)) > 0).select("d", "k", words_of(F.col("text")).alias("words"))
    index = materialize(postings(held, posted, REACH, REACH, wide=F.col("rare")))
    met = aligned(index, anchored).join(F.broadcast(phrases.select("phrase", "label", "base", "template", "shift")), "phrase")
    placed = met.withColumn("at", F.col("start") - F.col("ctx_from")).where("at >= 0").withColumn("seen", F.transform("ctx", lambda w: folded(w)))
    verified = placed.where(F.array_join(F.slice("seen", F.col("at") + 1, F.col("size")), " ") == F.col("text")).dropDuplicates(["d", "k", "phrase", "start"])
    same = F.size(F.filter(F.transform("template", lambda w, i: F.get(F.col("seen"), F.col("at") - F.col("shift") + i) == w), lambda x: x))
    shared = verified.withColumn("share", F.when(F.col("base"), F.lit(0.0)).otherwise(same / F.size("template")))
    found = (
        shared.groupBy("d", "k").agg(
            F.sum(F.col("base").cast("long")).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
        )
    )
    return files.drop("terms").join(found, ["d", "k"], "left").select(
        "doc_id", "d", "k", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("d", "k")
