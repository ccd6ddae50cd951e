"""Scalar functions on segment text, as Catalyst expressions. Whitespace and digits are Unicode, lengths code points."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def noise_reason(text: Column) -> Column:
    """Why a text isn't prose: empty, numeric, bracket or symbol; null for prose. Null texts count as empty.

    None of the reasons allows a letter, so one look for a letter settles most texts; only the others are stripped."""
    t = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(text.rlike(r"\p{L}"), F.lit(None).cast("string")).when(F.length(t) == 0, "empty")
        .when(t.rlike(r"(?U)^[\d\s,.\-+]+$") | t.rlike(r"(?U)^[\d\p{No}]+$"), "numeric")
        .when(t.rlike(r"(?U)^(\[\d+\]|\(\d+\))$"), "bracket")
        .when((F.length(t) == 1) & ~t.rlike(r"^\p{L}$"), "symbol")
    )


def should_translate(text: Column) -> Column:
    return noise_reason(text).isNull()


def estimate_tokens(text: Column) -> Column:
    """0 for nothing; ideographs beyond three tenths: length / 1.5; else length / 4 plus 30 %, at least 1. Integers only."""
    t = F.coalesce(text, F.lit(""))
    n, cjk = F.length(t), F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return F.when(n == 0, 0).when(cjk * 10 > n * 3, F.floor(n * 2 / 3)).otherwise(F.greatest(F.lit(1), F.floor(n * 13 / 40))).cast("int")


#: Symbols that converters get wrong, and what they stand for.
REPAIRS = dict(zip("ðÞ¼þ", "()=+", strict=True))


def repair_symbols(text: Column) -> Column:
    # replace only looks for its character, where translate takes a text apart
    for bad, good in REPAIRS.items():
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode normal form C, in Arrow batches: there is no built-in for it. ASCII is in that form and isn't sent."""
    return F.coalesce(F.pandas_udf(_nfc, StringType())(F.when(F.octet_length(text) > F.length(text), text)), text)


def color_tag(text: Column, color: Column) -> Column:
    """Wraps non-blank text into a colour tag; no colour, no tag."""
    return F.when(color.isNotNull() & text.rlike(r"(?U)\S"), F.concat(F.lit("<color_"), color, F.lit(">"), text, F.lit("</color_"), color, F.lit(">"))).otherwise(text)


def color_html(text: Column) -> Column:
    """Colour tags of six hex digits as styled spans. The forms of the tags are fixed."""
    return F.regexp_replace(text, r"(?s)<color_([0-9a-fA-F]{6})>(.*?)</color(?:_\w+)?>", '<span style="color: #$1;">$2</span>')


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def translated_html(text: Column) -> Column:
    """A translation as HTML: colour tags become styled spans, plain <b> <i> <sup> <sub> stay, anything else is text."""
    safe = F.regexp_replace(escaped(text), r"&lt;(/?(?:b|i|sup|sub|color_[0-9a-fA-F]{6})|/color(?:_\w+)?)&gt;", "<$1>")
    return F.when(F.contains(text, F.lit("<")), color_html(safe)).otherwise(escaped(text))


def strip_tags(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]*>", "")).otherwise(text)


def pdf_date(raw: Column) -> Column:
    """D:YYYYMMDDhhmmss... as YYYY-MM-DD hh:mm:ss; what starts otherwise comes back without D:; nothing is Unknown."""
    t = F.regexp_replace(raw, "^D:", "")
    shaped = F.regexp_replace(t, r"(?s)^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*$", "$1-$2-$3 $4:$5:$6")
    return F.when(raw.isNull() | (raw == ""), "Unknown").otherwise(shaped)


def page_size_text(width_pt: Column, height_pt: Column) -> Column:
    return F.format_string("[%.2f x %.2f cm]", width_pt * 0.0352778, height_pt * 0.0352778)


#: Fixed value: how a page size is written.
_SIZE = r"\[([0-9.]+)\s*x\s*([0-9.]+)\s*cm\]"


def page_size_css(text: Column, as_numbers: bool = False) -> Column:
    """'Wcm Hcm' of a page size, A4 if there is none; as_numbers drops trailing zeros as printing a number would."""
    w, h = F.regexp_extract(text, _SIZE, 1), F.regexp_extract(text, _SIZE, 2)
    if as_numbers:
        w, h = w.cast("double").cast("string"), h.cast("double").cast("string")
    return F.when(text.rlike(_SIZE), F.concat(w, F.lit("cm "), h, F.lit("cm"))).otherwise("A4")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def output_name(path: Column, suffix: str = "_translated") -> Column:
    """The path with the suffix before its extension."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./]+)?$", "$1" + suffix + "$2")


def path_key(path: Column) -> Column:
    """A path as it is compared: repeated slashes and ./ steps are one, no slash at the end."""
    once = F.regexp_replace(F.regexp_replace(path, r"/(?:\./|/)+", "/"), r"^(?:\./)+(?=.)", "")
    return F.when(once == "/", once).otherwise(F.regexp_replace(once, r"/$", ""))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def page_of_hex(class_id: Column) -> Column:
    """0-based page of an id like pf1a."""
    return (F.conv(F.regexp_extract(class_id, "^pf([0-9a-fA-F]+)$", 1), 16, 10).cast("int") - 1).cast("int")


def hex_of_page(page: Column) -> Column:
    return F.concat(F.lit("pf"), F.lower(F.hex(page + 1)))


def duration(seconds: Column) -> Column:
    """'M mins S secs' from a minute on, else 'S secs'; whole seconds."""
    s = F.floor(seconds)
    return F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit(" mins "), (s % 60).cast("string"), F.lit(" secs"))).otherwise(F.concat(s.cast("string"), F.lit(" secs")))


def zoom(raw: Column) -> Column:
    """A zoom setting between 50 and 250, 80 if it isn't a number."""
    return F.greatest(F.lit(50), F.least(F.lit(250), F.coalesce(raw.try_cast("int"), F.lit(80))))


def fill_first(template: Column, key: str, value: Column) -> Column:
    """Replaces the first {key} of a template."""
    mark = "{" + key + "}"
    at = F.instr(template, mark)
    return F.when(at > 0, F.concat(F.substring(template, F.lit(1), at - 1), value, F.substring(template, at + len(mark), F.length(template)))).otherwise(template)


def drop_fences(raw: Column) -> Column:
    """A reply without its ``` lines, stripped."""
    lines = F.filter(F.split(raw, "\n"), lambda x: ~F.startswith(strip(x), F.lit("```")))
    return strip(F.when(F.contains(raw, F.lit("```")), F.array_join(lines, "\n")).otherwise(raw))


#: Parts of a lower-cased error that mean the rate is limited.
RATE_LIMIT = ("rate_limit", "rate limit", "429", "overloaded", "resource_exhausted", "resource exhausted", "quota", "503", "timeout", "timed out", "connection error")


def is_rate_limit(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(RATE_LIMIT))


def changed(text: Column, translated: Column) -> Column:
    """Whether applying a translation would change anything."""
    return F.trim(text) != F.trim(translated)


#: The letters that the width model counts as narrow and as wide, and its ideographs, as parts of a class.
NARROW, WIDE, FULL = r"iljtfrI.,;:!|' ", r"A-HJ-Zmw", r"\u2e80-\u9fff\uac00-\ud7ff\uff00-\uffef"


def text_width(text: Column) -> Column:
    """A width model in tenths of an em: narrow letters 3, capitals and wide letters 7, ideographs 10, others 5."""
    # what is left without a class is counted, as matches would be listed one by one
    narrow, wide, full = (F.length(text) - F.length(F.regexp_replace(text, rf"[{r}]+", "")) for r in (NARROW, WIDE, FULL))
    full = F.when(F.octet_length(text) > F.length(text), full).otherwise(0)
    return (F.length(text) * 5 - narrow * 2 + wide * 2 + full * 5).cast("double")


_NARROW, _WIDE = (bytes(b for b in range(128) if re.match(f"[{r}]", chr(b))) for r in (NARROW, WIDE))
_FULL, _TAGS = re.compile(f"[{FULL}]+"), re.compile("<[^>]*>")


def width_of(text: str) -> int:
    """text_width() of strip_tags() of a text at hand. Its classes are ASCII but for ideographs, so bytes are counted."""
    if "<" in text:
        text = _TAGS.sub("", text)
    raw, n = text.encode(), len(text)
    full = n - len(_FULL.sub("", text)) if len(raw) > n else 0
    return n * 5 + 2 * (len(raw.translate(None, _NARROW)) - len(raw.translate(None, _WIDE))) + full * 5


def fit_scale(sx: Column, old_width: Column, new_width: Column) -> Column:
    """The horizontal scale at which new text takes no more room than the old; never wider than before."""
    return F.when((old_width > 0) & (new_width > 0), F.least(sx, sx * old_width / new_width)).otherwise(sx)
