"""Secret scans: base rules, and weak parts that count only where complementary parts stand close together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_key, table
from .spans import joined, places

#: Kinds in the order in which spans are listed at the same start; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Weak parts. None is reported by itself.
IDENTIFIER = r"(?i:(?<![a-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@+-]{3,}+|(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,15}+(?![A-Z0-9])"
VALUE = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{16,}+={0,2}+"
    r"|(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?=[a-z]*+[0-9])(?=[0-9]*+[a-z])[a-z0-9]{16,}+(?![A-Za-z0-9])"
    r"|(?<![0-9a-f])(?=[a-f]{0,22}[0-9])[0-9a-f]{16,23}+(?![0-9a-zA-Z])"
)
ENDPOINT = r"(?<![A-Za-z0-9])(?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]++"
#: Code points from the end of one part of a credential to the start of the next, at most.
SCOPE = 200

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _kind(col: str, kind: str, keep: str = "true") -> str:
    return f"transform(filter({col}, x -> {keep}), x -> named_struct('start', x.start, 'rank', {KINDS.index(kind)}, 'end', x.end, 'kind', '{kind}'))"


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, d, k, base, weak): arrays of structs (start, rank, end, kind) in order, for every row of docs (doc_id, text)."""
    out = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), row_key("doc_id", "text").alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    lower = F.lower("t")
    out = out.withColumn("word", lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("apikey") | lower.contains("api_key"))
    out = out.withColumn("digit", F.col("t").rlike("[0-9]")).withColumn("long_hex", F.col("t").rlike(r"[0-9a-f]{16}"))
    guards = {
        "assign": (F.col("word"), ASSIGN, 1), "access": (F.col("t").contains("AKIA"), ACCESS, 0), "hex": (F.col("long_hex"), HEX, 0),
        "identifier": (F.col("t").rlike("(?i)user|login|account|client_?id|access_?key|A[KSIR][IDO]A"), IDENTIFIER, 0), "value": (F.col("digit"), VALUE, 0), "endpoint": (F.col("t").contains("://"), ENDPOINT, 0),
    }
    for kind, (when, regex, group) in guards.items():
        out = out.withColumn(f"m_{kind}", F.when(when, places("t", regex, group)).otherwise(F.expr("cast(array() AS array<struct<start:int,end:int,s:string,g:string>>)")))
    base = f"array_sort(concat({_kind('m_assign', 'assign', 'length(x.g) >= 6')}, {_kind('m_access', 'access')}, {_kind('m_hex', 'hex')}))"
    weak = f"array_sort(concat({_kind('m_assign', 'value', 'length(x.g) < 6')}, {_kind('m_identifier', 'identifier')}, {_kind('m_value', 'value')}, {_kind('m_endpoint', 'endpoint')}))"
    return out.select("doc_id", "d", "k", F.expr(base).alias("base"), F.expr(weak).alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(d, k, start, rank, end, kind): weak parts that complete a credential.

    An interval join on buckets of the place: a weak value needs an identifier and a weak endpoint or identifier
    needs a value or base secret within `scope` code points; an endpoint also needs an identifier or value beside it.
    The gap counts, from the end of one part to the start of the other, so a long part links to what comes right after
    it: parts behind meet by their start and parts in front by their end. A bucket of one row holds a bounded number
    of parts, so no key is hot."""
    every = found.select("d", "k", F.explode(F.concat("base", "weak")).alias("x")).select("d", "k", "x.*").distinct()
    role = F.when(F.col("kind") == "identifier", "id").when(F.col("kind") == "access", "id").when(F.col("kind") == "endpoint", "at").otherwise("secret")
    every = every.withColumn("role", role)
    bucket = lambda place: F.floor(F.col(place) / scope)
    at = lambda behind, b: F.struct(F.lit(behind).alias("behind"), b.alias("b"))
    left = every.where(F.col("rank") >= 3).withColumn("at", F.explode(F.array(at(True, bucket("end")), at(True, bucket("end") + 1), at(False, bucket("start") - 1), at(False, bucket("start")))))
    other = every.withColumn("at", F.explode(F.array(at(True, bucket("start")), at(False, bucket("end"))))).select("d", "k", "at.*", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("role").alias("role2"))
    left = left.select("d", "k", "start", "rank", "end", "kind", "role", "at.*")
    gap = F.when(F.col("behind"), F.col("start2") - F.col("end")).otherwise(F.col("start") - F.col("end2"))
    apart = (F.col("role") != F.col("role2")) & gap.between(0, scope)
    met = left.join(other, ["d", "k", "behind", "b"]).where(apart).groupBy("d", "k", "start", "rank", "end", "kind", "role").agg(F.collect_set("role2").alias("roles"))
    enough = F.when(F.col("role") == "secret", F.array_contains("roles", "id")).when(F.col("role") == "id", F.array_contains("roles", "secret")).otherwise(F.array_contains("roles", "secret") & F.array_contains("roles", "id"))
    return met.where(enough).select("d", "k", "start", "rank", "end", "kind")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans) for every row of docs (doc_id, text); arrays of structs by start, then kind.

    Base spans always stay; linked weak parts are added where they don't overlap one. Null texts are empty. Whole texts
    are searched, however long; spans of one start are listed by kind. Rows that share an id but not a text are linked
    apart; repeated rows come out repeated; extra columns are ignored; an empty table gives no rows."""
    found = materialize(parts(docs))
    more = linked(found, scope).groupBy("d", "k").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("more"))
    clear = F.expr("filter(more, x -> NOT exists(base, y -> y.start < x.end AND x.start < y.end))")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", clear)))
    return found.drop("weak").join(more, ["d", "k"], "left").select("doc_id", "base", spans.alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
