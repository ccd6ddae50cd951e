"""Regular-expression matches with their places, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "array<struct<start:int,end:int,s:string,g:string>>"


def _quoted(regex: str) -> str:
    return "r'" + regex.replace("'", "\\x27") + "'"


def places(text: str, regex: str, group: int = 0) -> Column:
    """array<struct<start, end, s, g>> of the leftmost non-overlapping matches in a column; g is the given group.

    Places count code points, end exclusive. What lies between matches comes from split(), so a regex mustn't match
    the empty string. Groups have to repeat possessively: backtracking ones recurse once per round."""
    q = _quoted(regex)
    return F.expr(f"""
      aggregate(
        arrays_zip(split({text}, {q}, -1), regexp_extract_all({text}, {q}, 0), regexp_extract_all({text}, {q}, {group})),
        named_struct('pos', 0, 'out', cast(array() AS {PLACE})),
        (a, x) -> named_struct(
          'pos', a.pos + length(x['0']) + coalesce(length(x['1']), 0),
          'out', CASE WHEN x['1'] IS NULL THEN a.out ELSE concat(a.out, array(named_struct(
            'start', a.pos + length(x['0']), 'end', a.pos + length(x['0']) + length(x['1']), 's', x['1'], 'g', x['2']))) END),
        a -> a.out)""")


def digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def luhn(s: str) -> str:
    """SQL: the digits of s pass the Luhn check."""
    return f"""(aggregate(transform(split(reverse({digits(s)}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN int(c) WHEN int(c) < 5 THEN 2 * int(c) ELSE 2 * int(c) - 9 END),
      0, (a, v) -> a + coalesce(v, 0)) % 10 = 0)"""


def joined(spans: Column) -> Column:
    """kind:start:end of an ordered array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
