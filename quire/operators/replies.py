"""Replies of a text transformer: a tolerant reader of JSON lists that knows strings from structure.

What is valid is read as it stands. Otherwise structure is mended and text inside strings stays as it is: trailing,
missing and doubled commas, single or typographic quotes around strings, quotes inside a string that aren't escaped, raw
line ends, literals of other languages, chatter and fences around the list, objects without a list around them, and an
unfinished end, whose last item is left out if it isn't whole."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ITEMS = "array<struct<id:string,translated:string>>"
#: Opening quotes and what closes them.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
LITERALS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "undefined": None, "NaN": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"', "'": "'"}

_FENCE = re.compile(r"^\s*```[^\n]*\n?|\n?\s*```\s*$")
_LIST = re.compile(r"\[(?=\s*(?:[{\]]|$))")
_OBJECT = re.compile(r"\{(?=\s*[\"'“‘])")
_BARE = re.compile(r"[^\s,:\[\]{}\"'“‘]+")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
#: What may follow the end of a value in an object: another name, or the end of the object and then more structure.
_AFTER_VALUE = re.compile(r"\s*(?:$|,?\s*[\"'“‘][^\"'“”‘’\n]{0,80}[\"'”’]\s*:|,?\s*\}\s*(?:$|[,\]{}`\[]))")
_AFTER_NAME = re.compile(r"\s*:")
_AFTER_ITEM = re.compile(r"\s*(?:$|[,\]])")
_END = object()


class _Reader:
    """One pass over a text; whole is false from the place on where the text ends too early."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at, self.whole = text, at, True

    def blank(self) -> str:
        """The next character that isn't blank, or nothing."""
        text = self.text
        while self.at < len(text) and text[self.at].isspace():
            self.at += 1
        return text[self.at : self.at + 1]

    def string(self, after: re.Pattern) -> str:
        """The string that begins here. A quote ends it where what follows is structure; any other is text."""
        text, close = self.text, QUOTES[self.text[self.at]]
        out, i = [], self.at + 1
        while i < len(text):
            c = text[i]
            if c == "\\" and i + 1 < len(text):
                e = text[i + 1]
                if e == "u" and re.match(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                    code, i = int(text[i + 2 : i + 6], 16), i + 6
                    if 0xD800 <= code < 0xDC00 and (low := re.match(r"\\u([dD][c-fC-F][0-9a-fA-F]{2})", text[i : i + 6])):
                        code, i = 0x10000 + (code - 0xD800) * 1024 + int(low[1], 16) - 0xDC00, i + 6
                    out.append("�" if 0xD800 <= code < 0xE000 else chr(code))
                    continue
                out.append(ESCAPES.get(e, "\\" + e))
                i += 2
                continue
            if (c == close or c == '"' == text[self.at]) and after.match(text, i + 1):
                self.at = i + 1
                return "".join(out)
            out.append(c)
            i += 1
        self.at, self.whole = len(text), False
        return "".join(out)

    def value(self, after: re.Pattern):
        c = self.blank()
        if c == "{":
            return self.object()
        if c == "[":
            return self.list()
        if c in QUOTES:
            return self.string(after)
        if found := _BARE.match(self.text, self.at):
            self.at = found.end()
            word = found[0]
            if self.at == len(self.text):
                self.whole = False
            return LITERALS[word] if word in LITERALS else json.loads(word) if _NUMBER.fullmatch(word) and not re.match(r"-?0\d", word) else word
        return _END

    def object(self) -> dict:
        self.at += 1
        out: dict = {}
        while True:
            c = self.blank()
            if c == "}":
                self.at += 1
                return out
            if c == "":
                self.whole = False
                return out
            if c == "]" or c == "{":  # the brace is missing
                return out
            if c in QUOTES:
                name = self.string(_AFTER_NAME)
            elif (found := _BARE.match(self.text, self.at)) and re.match(r"\s*:", self.text[found.end() : found.end() + 20]):
                name, self.at = found[0], found.end()
            else:
                self.at += 1  # a comma or something that isn't structure
                continue
            if self.blank() == ":":
                self.at += 1
                got = self.value(_AFTER_VALUE)
                if got is not _END:
                    out[name] = got

    def list(self) -> list:
        self.at += 1
        out: list = []
        while True:
            c = self.blank()
            if c == "]":
                self.at += 1
                return out
            if c == "":
                self.whole = False
                return out
            if c in ",:}`":
                self.at += 1
                continue
            got = self.value(_AFTER_ITEM)
            if got is _END:
                self.at += 1
            elif self.whole:
                out.append(got)
            else:  # cut off in the middle
                return out


def read_reply(raw: str | None) -> list | None:
    """The list of a reply; None if it holds none, or if it is one object."""
    if raw is None:
        return None
    text = raw.strip()
    while (bare := _FENCE.sub("", text).strip()) != text:
        text = bare
    try:
        got = json.loads(text, strict=False)
        return got if isinstance(got, list) else None
    except ValueError:
        pass
    listed, single = _LIST.search(text), _OBJECT.search(text)
    if listed and (not single or listed.start() < single.start()):
        reader = _Reader(text, listed.start())
        got = reader.list()
        return got if got or reader.whole else None  # cut off before its first item was whole: nothing to go on
    if single is None:
        return None
    found, at = [], single.start()
    while (begin := _OBJECT.search(text, at)) is not None:  # objects one after another, without a list around them
        reader = _Reader(text, begin.start())
        got = reader.object()
        if not reader.whole:
            break
        found.append(got)
        at = reader.at
    return found if len(found) > 1 else None


def text_of(value) -> str | None:
    """A value of an item as text: strings as they are, anything else as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def items_of(found: list | None) -> list[dict] | None:
    """The objects of a list as items (id, translated)."""
    return None if found is None else [{"id": text_of(i.get("id")), "translated": text_of(i.get("translated"))} for i in found if isinstance(i, dict)]


def _read(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: items_of(read_reply(t)))


def parse_reply(raw: Column) -> Column:
    """Items of a reply as a column, in Arrow batches; null if it holds no list."""
    return F.pandas_udf(_read, ITEMS)(raw)
