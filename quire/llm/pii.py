"""Personal data: regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation weighs them.

Candidates are found in the row by built-in expressions. The votes are counted over the whole corpus into a table of
vote patterns, whose size doesn't depend on the corpus; expectation-maximisation on that table estimates how reliable
each labeler is, and its posteriors train the span classifier, a table of log-odds by kind and feature. Spans of the
base rules are always reported."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .spans import digits, joined, luhn, places

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser shapes that only the vote can confirm.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?\(at\)\x20?|\x20?\[at\]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20-][0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?+",
}
#: Words that speak for a kind if they stand close before a span.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel|write to|escrib", "ip": r"\bip\b|host|server|address|login|from", "card": "card|visa|mastercard|amex|karte|carte|tarjeta|credit",
    "phone": "phone|tel|call|mobile|fax|anruf|rufen|appel|llam|cell", "ssn": "ssn|social security", "iban": "iban|konto|account|cuenta|compte", "name": "name|signed|dear|by|von|de",
}
#: Top-level domains, card prefixes and country codes that the gazetteers know.
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|ch|at|it|nl|us"
CARD_PREFIX = "^(4|5[1-5]|2[2-7]|3[47]|6)"
COUNTRY = "^(1|20|27|30|31|32|33|34|36|39|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
REACH = 40
CUT = 0.5
LABELERS = ("regex", "gazetteer", "context")
#: P(vote 1 | no personal data), P(vote 1 | personal data) of each labeler before anything is seen.
START = ((0.1, 0.95), (0.4, 0.7), (0.2, 0.6))

_CANDIDATE = "array<struct<rank:int,start:int,end:int,kind:string,base:boolean,regex:int,gazetteer:int,context:int,size:int,s:string>>"
_IP_OK = "forall(split(x.s, '[.]'), p -> double(p) <= 255)"
_N = f"length({digits('x.s')})"
#: SQL over a match x: passes the base rule; regex vote; gazetteer vote. Votes are 1, 0 or -1 (abstains).
RULES = {
    "email": ("true", "1", f"CASE WHEN lower(x.s) RLIKE '[.]({DOMAINS})$' THEN 1 ELSE 0 END"),
    "ip": (_IP_OK, f"CASE WHEN {_IP_OK} THEN 1 ELSE 0 END", "CASE WHEN x.s RLIKE '^(0|255|127)[.]' THEN 0 ELSE 1 END"),
    "card": (f"({_N} BETWEEN 13 AND 19 AND {luhn('x.s')})", f"CASE WHEN {_N} BETWEEN 13 AND 19 AND {luhn('x.s')} THEN 1 ELSE 0 END", f"CASE WHEN {digits('x.s')} RLIKE '{CARD_PREFIX}' THEN 1 ELSE 0 END"),
    "phone": (f"({_N} BETWEEN 9 AND 15)", f"CASE WHEN {_N} BETWEEN 9 AND 15 THEN 1 ELSE 0 END", f"CASE WHEN {digits('x.s')} RLIKE '{COUNTRY}' THEN 1 ELSE 0 END"),
}
#: Regex and gazetteer votes on the looser shapes. A labeler that would say the same of all candidates abstains.
#: The account number of an IBAN with its first four characters last, letters as 10 to 35, modulo 97.
_IBAN = "regexp_replace(x.s, ' ', '')"
_MOD_97 = f"""aggregate(transform(split(concat(substring({_IBAN}, 5), substring({_IBAN}, 1, 4)), ''), c -> CASE WHEN c = '' THEN -1 WHEN c RLIKE '[0-9]' THEN int(c) ELSE ascii(c) - 55 END),
  0, (a, v) -> CASE WHEN v < 0 THEN a WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END)"""
LOOSE_RULES = {
    "email": ("-1", f"CASE WHEN lower(x.s) RLIKE '({DOMAINS})$' THEN 1 ELSE 0 END"), "phone": ("CASE WHEN x.s LIKE '(%' THEN 1 ELSE 0 END", "-1"), "ssn": ("CASE WHEN x.s RLIKE '^(000|666|9)|-00-|-0000$' THEN 0 ELSE 1 END", "-1"),
    "iban": (f"CASE WHEN length(regexp_replace(x.s, ' ', '')) BETWEEN 15 AND 34 AND {_MOD_97} = 1 THEN 1 ELSE 0 END", "CASE WHEN x.s RLIKE '^(AT|BE|CH|DE|ES|FR|GB|IT|NL|PL|SE)' THEN 1 ELSE 0 END"), "name": (r"CASE WHEN x.s RLIKE '\\x20.+\\x20' THEN 1 ELSE 0 END", "1"),
}


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `found`: every candidate span with its votes, by kind and start."""
    empty = f"cast(array() AS {_CANDIDATE})"
    t = f"coalesce({text}, '')"
    out = docs.withColumn("__t", F.expr(t))
    guard = {"email": "contains(__t, '@') OR contains(__t, '(at)') OR contains(__t, '[at]')", "ip": "__d", "card": "__d", "phone": "__d AND contains(__t, '+')"}
    out = out.withColumn("__d", F.col("__t").rlike("[0-9]"))
    parts = []
    for kind, regex in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        col = f"__m_{kind}"
        out = out.withColumn(col, F.when(F.expr(guard[kind]), places("__t", regex)))
        parts.append(_votes(col, kind, *RULES[kind]))
    loose_guard = {"email": "contains(__t, 'at)') OR contains(__t, 'at]')", "phone": "__d", "ssn": "__d", "iban": "__d", "name": r"__t RLIKE '(Mr|Mrs|Ms|Dr|Herr|Frau|Señora?|Monsieur|Madame)\\.? '"}
    for kind, regex in LOOSE.items():
        col = f"__l_{kind}"
        out = out.withColumn(col, F.when(F.expr(loose_guard[kind]), places("__t", regex)))
        parts.append(_votes(col, kind, "false", *LOOSE_RULES[kind]))
    alone = "x.base OR NOT (substring(__t, x.start, least(1, x.start)) RLIKE '[A-Za-z0-9]' OR substring(__t, x.end + 1, 1) RLIKE '[A-Za-z0-9]')"
    every = "array_sort(filter(concat(" + ", ".join(f"coalesce({p}, {empty})" for p in parts) + f"), x -> {alone}))"
    made = [c for c in out.columns if c.startswith("__")]
    return out.withColumn("found", F.expr(every)).drop(*made)


def _votes(col: str, kind: str, base: str, regex: str, gazetteer: str) -> str:
    context = CONTEXT[kind].replace("\\", "\\\\")
    return f"""transform({col}, x -> named_struct('rank', {KINDS.index(kind)}, 'start', x.start, 'end', x.end, 'kind', '{kind}', 'base', {base},
      'regex', {regex}, 'gazetteer', {gazetteer},
      'context', CASE WHEN lower(substring(__t, greatest(1, x.start + 1 - {REACH}), least(x.start, {REACH}))) RLIKE '{context}' THEN 1 ELSE 0 END,
      'size', least(9, length(x.s) div 4), 's', x.s))"""


class SpanModel:
    """Labeler reliabilities by expectation-maximisation, and the classifier's log-odds by kind and feature."""

    def __init__(self, patterns: list[tuple[str, int, int, int, int, int]], rounds: int = 50):
        """patterns: (kind, regex, gazetteer, context, size, n) over the corpus."""
        self.reliability: dict[str, tuple[float, float, float]] = {}
        self.odds: dict[str, float] = {}
        by_kind = defaultdict(list)
        for kind, *votes, size, n in patterns:
            by_kind[kind].append((tuple(votes), size, n))
        for kind, rows in by_kind.items():
            total = sum(n for _, _, n in rows)
            prior, hit = 0.5, [list(x) for x in START]
            post = []
            for _ in range(rounds):
                post = []
                for votes, _, _ in rows:
                    z = math.log(prior / (1 - prior))
                    for v, (h0, h1) in zip(votes, hit, strict=True):
                        if v >= 0:
                            z += math.log(h1 / h0) if v else math.log((1 - h1) / (1 - h0))
                    post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                prior = min(0.99, max(0.01, (sum(p * r[2] for p, r in zip(post, rows, strict=True)) + 1) / (total + 2)))
                for j in range(len(LABELERS)):
                    for c in (0, 1):
                        seen = [((p if c else 1 - p) * r[2], r[0][j]) for p, r in zip(post, rows, strict=True) if r[0][j] >= 0]
                        hit[j][c] = min(0.98, max(0.02, (sum(w for w, v in seen if v) + 10 * START[j][c]) / (sum(w for w, _ in seen) + 10)))
            self.reliability[kind] = tuple(round((h1 + 1 - h0) / 2, 4) for h0, h1 in hit)
            good, bad = defaultdict(float), defaultdict(float)
            for p, (votes, size, n) in zip(post, rows, strict=True):
                for name, v in (*zip(LABELERS, votes, strict=True), ("size", size)):
                    good[name, v] += p * n
                    bad[name, v] += (1 - p) * n
            g, b = sum(p * r[2] for p, r in zip(post, rows, strict=True)), sum((1 - p) * r[2] for p, r in zip(post, rows, strict=True))
            self.odds[kind] = math.log((g + 1) / (b + 1))
            for name, v in good:
                self.odds[f"{kind}|{name}|{v}"] = math.log((good[name, v] + 1) / (g + 2)) - math.log((bad[name, v] + 1) / (b + 2))

    def keeps(self) -> str:
        """SQL over a candidate x: the classifier reports it."""
        if not self.odds:
            return "false"
        table_ = "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in sorted(self.odds.items())) + ")"
        terms = [f"coalesce({table_}[x.kind], -9D)"] + [f"coalesce({table_}[concat(x.kind, '|{name}|', x.{name})], 0D)" for name in (*LABELERS, "size")]
        return f"({' + '.join(terms)} >= {math.log(CUT / (1 - CUT))!r}D)"


def train(found: DataFrame) -> SpanModel:
    """From a frame with the column `found` of candidates(); all of its candidates count."""
    rows = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.regex", "x.gazetteer", "x.context", "x.size").agg(F.count("*").alias("n")).orderBy("kind", "regex", "gazetteer", "context", "size").collect()
    return SpanModel([tuple(r) for r in rows])


def with_spans(found: DataFrame, model: SpanModel) -> DataFrame:
    """found with `base` and `spans`: base spans, and those with what the classifier adds beside them."""
    out = found.withColumn("base", F.expr("filter(found, x -> x.base)"))
    added = f"filter(found, x -> NOT x.base AND {model.keeps()} AND NOT exists(base, b -> b.start < x.end AND x.start < b.end))"
    return out.withColumn("spans", F.expr(f"array_sort(concat(base, {added}))"))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of docs (doc_id, text); arrays of structs by kind, then start.

    Null texts are empty. Whole texts are searched, however long; spans of one kind never overlap, spans of two kinds
    may, and base spans win over added ones. Extra columns are ignored. Repeated rows come out repeated; an empty table gives no rows and trains on nothing."""
    found = materialize(candidates(docs.select("doc_id", "text")).select("doc_id", "found"))
    return with_spans(found, train(found)).select("doc_id", "base", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every reported span of `text` replaced by its kind in angle brackets; null texts stay null.

    Other columns, whatever their names, come through as they are. Of overlapping spans the first is replaced and the
    rest of the others goes with it; of spans with one start the shortest is first. Repeated rows come out repeated; an
    empty table gives no rows. Candidates are found once, into a written table."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = materialize(candidates(packed).drop("text")).withColumn("text", F.col("row.text"))
    out = with_spans(found, train(found))
    ordered = "array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"
    cut = f"""aggregate({ordered}, named_struct('pos', 0, 'out', cast(array() AS array<string>)),
      (a, x) -> CASE WHEN x.start < a.pos THEN named_struct('pos', greatest(a.pos, x.end), 'out', a.out)
        ELSE named_struct('pos', x.end, 'out', concat(a.out, array(substring(text, a.pos + 1, x.start - a.pos), concat('<', upper(x.kind), '>')))) END,
      a -> concat(array_join(a.out, ''), substring(text, a.pos + 1)))"""
    out = out.withColumn("text", F.when(F.size("spans") > 0, F.expr(cut)).otherwise(F.col("text")))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
