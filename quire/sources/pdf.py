"""What a PDF file says of itself: its page tree and info, objects in compressed streams included.

Objects are found by their marks, so a damaged table of places doesn't matter; of several with one number the last
counts. Only objects that are looked at are parsed. Pages' contents, fonts and encrypted files aren't read."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
_TRAILER = re.compile(rb"\btrailer\s*(?=<<)")
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]()<]|/[^\s()<>\[\]{}/%]*|(\d+)\s+(\d+)\s+R\b|[^\s()<>\[\]{}/%]+")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
#: Kinds of pages and attributes that pages take from the nodes above them; depth that a value or a page tree may have.
DEEP = 60


class Ref(tuple):
    """The number of another object."""


class _Values:
    """Reads values from bytes: dictionaries, lists, names (as text), numbers, strings (as bytes) and references."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def next(self) -> re.Match | None:
        while (found := _TOKEN.search(self.data, self.at)) is not None:
            self.at = found.end()
            if found[0][:1] != b"%":
                return found
        return None

    def value(self, depth: int = 0):
        found = self.next()
        if found is None or depth > DEEP:
            raise ValueError("the file ends inside a value")
        token = found[0]
        if token == b"<<":
            out = {}
            while (name := self.value(depth + 1)) != ">>":
                out[name] = self.value(depth + 1)
            return out
        if token == b"[":
            out = []
            while (item := self.value(depth + 1)) != "]":
                out.append(item)
            return out
        if token in (b">>", b"]"):
            return token.decode()
        if token == b"(":
            return self.string()
        if token == b"<":
            end = self.data.index(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if found[1]:
            return Ref((int(found[1]),))
        if token[:1] == b"/":
            return re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), token.decode("latin-1"))
        if re.fullmatch(rb"[-+]?(\d+\.?\d*|\.\d+)", token):
            return float(token)
        return {b"true": True, b"false": False}.get(token)

    def string(self) -> bytes:
        out, open_, data = bytearray(), 1, self.data
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 0x5C and self.at < len(data):
                e = data[self.at]
                octal = re.match(rb"[0-7]{1,3}", data[self.at : self.at + 3])
                self.at += len(octal[0]) if octal else 1
                if octal:
                    out.append(int(octal[0], 8) & 255)
                elif e == 13 and data[self.at : self.at + 1] == b"\n":
                    self.at += 1
                elif e not in (10, 13):
                    out.append(_ESCAPES.get(e, e))
                continue
            open_ += (c == 0x28) - (c == 0x29)
            if not open_:
                return bytes(out)
            out.append(c)
        raise ValueError("the file ends inside a string")


class Pdf:
    """The objects of a file by number, and the dictionary that names its root."""

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer = data, {}, {}
        packed = []
        for found in _OBJECT.finditer(data):
            self.places[int(found[1])] = (data, found.end())
        for number, (_, at) in list(self.places.items()):
            head = data[at : at + 400]
            if b"/ObjStm" in head or b"/XRef" in head:
                packed.append((at, number))
        for at, number in sorted(packed):
            said = self.at(number)
            if not isinstance(said, dict):
                continue
            if said.get("/Type") == "/XRef":
                self.trailer |= said
            elif said.get("/Type") == "/ObjStm":
                self.unpack(at, said)
        for found in _TRAILER.finditer(data):
            try:
                self.trailer |= _Values(data, found.end()).value()
            except (ValueError, TypeError):
                continue

    def at(self, number: int):
        data, place = self.places[number]
        return _Values(data, place).value()

    def look(self, value, depth: int = 0):
        """A value, or what it refers to; None where nothing stands."""
        while isinstance(value, Ref) and depth < DEEP:
            if value[0] not in self.places:
                return None
            value, depth = self.at(value[0]), depth + 1
        return value

    def unpack(self, at: int, said: dict) -> None:
        begin = re.compile(rb"stream\r?\n").search(self.data, at)
        if begin is None:
            return
        length = self.look(said.get("/Length"))
        end = begin.end() + int(length) if isinstance(length, float) else self.data.find(b"endstream", begin.end())
        raw = self.data[begin.end() : end]
        filters = said.get("/Filter")
        if filters in ("/FlateDecode", ["/FlateDecode"]):
            raw = zlib.decompressobj().decompress(raw)
        elif filters:
            return
        first = int(said["/First"])
        heads = [int(x) for x in raw[:first].split()]
        for number, offset in zip(heads[::2], heads[1::2], strict=False):
            old = self.places.get(number)
            if old is None or old[0] is not self.data or old[1] < at:
                self.places[number] = (raw, first + offset)

    def first_page(self, node, box=None, depth: int = 0, seen: set | None = None):
        """(pages, MediaBox of the first page) below a node; a box holds for what is below it."""
        seen = set() if seen is None else seen
        if isinstance(node, Ref):
            if node[0] in seen or depth > DEEP:
                return 0, None
            seen.add(node[0])
        said = self.look(node)
        if not isinstance(said, dict):
            return 0, None
        box = self.look(said.get("/MediaBox")) or box
        kids = self.look(said.get("/Kids"))
        if not isinstance(kids, list):
            return 1, box
        total, first = 0, None
        for kid in kids:
            n, found = self.first_page(kid, box, depth + 1, seen)
            total, first = total + n, first if total else found
        return total, first


def text_of(raw) -> str | None:
    if not isinstance(raw, bytes):
        return None
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("latin-1")


def structure_of(data: bytes, entries: list[str]) -> tuple:
    """(pages, width, height, tagged, info entries ..., error); nulls and the reason where a file can't be read."""
    nothing = (None,) * (4 + len(entries))
    try:
        pdf = Pdf(data)
        if "/Encrypt" in pdf.trailer:
            return *nothing, "encrypted"
        root = pdf.look(pdf.trailer.get("/Root"))
        if not isinstance(root, dict):
            return *nothing, "no root"
        pages, box = pdf.first_page(root.get("/Pages"))
        sides = [pdf.look(x) for x in box] if isinstance(box, list) and len(box) == 4 else None
        width, height = (abs(sides[2] - sides[0]), abs(sides[3] - sides[1])) if sides and all(isinstance(x, float) for x in sides) else (None, None)
        info = pdf.look(pdf.trailer.get("/Info"))
        told = [text_of(pdf.look(info.get("/" + e))) for e in entries] if isinstance(info, dict) else [None] * len(entries)
        return pages, width, height, "/MarkInfo" in root or "/StructTreeRoot" in root, *told, None
    except (ValueError, KeyError, IndexError, TypeError, zlib.error, RecursionError) as e:  # damaged in one way or another
        return *nothing, type(e).__name__


def structures(files: DataFrame, info: dict[str, str]) -> DataFrame:
    """(path, pages, width_pt, height_pt, tagged, info ..., error) of binary rows (path, content); info: column -> entry."""
    names = ["path", "pages", "width_pt", "height_pt", "tagged", *info, "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *structure_of(bytes(c or b""), list(info.values()))) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=names).astype({"pages": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, pages int, width_pt double, height_pt double, tagged boolean, " + "".join(f"{n} string, " for n in info) + "error string")
