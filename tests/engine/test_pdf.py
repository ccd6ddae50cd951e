"""PDF files made here, plain and with compressed object streams, against what they were made of."""

import random
import zlib

from quire.sources import pdf, tables

random.seed(6)
INFO = [entry for entry, _ in tables.INFO.values()]


def body(objects, packed=(), length_ref=False, extra=b""):
    """A file of objects {number: bytes}; those in packed go into one compressed stream."""
    out = b"%PDF-1.7\n%\xe2\xe3\n" + extra
    for n, o in objects.items():
        if n not in packed:
            out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    if packed:
        heads, data = [], b""
        for n in packed:
            heads += [n, len(data)]
            data += objects[n] + b"\n"
        head = b" ".join(b"%d" % x for x in heads) + b" "
        raw = zlib.compress(head + data)
        length = b"901 0 R" if length_ref else b"%d" % len(raw)
        out += b"900 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %s >>\nstream\r\n%s\r\nendstream\nendobj\n" % (len(packed), len(head), length, raw)
        if length_ref:
            out += b"901 0 obj %d endobj\n" % len(raw)
    return out


TREE = {
    1: b"<< /Type /Catalog /Pages 2 0 R /MarkInfo << /Marked true >> >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /MediaBox [0 0 10 0 R 842.5] >>",
    3: b"<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 6 0 R] /Count 2 >>", 4: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 100] >>", 5: b"<< /Type /Page /Parent 3 0 R >>", 6: b"<</Type/Page/MediaBox[0 0 7 7]>>", 10: b"595",
    7: b"<< /Title (A \\(b\\) \\101\\\n c) /Author <FEFF00E900200041> /Creator 11 0 R /Keywords (nested (in) it) /CreationDate (D:20240102030405Z) >>", 11: b"(indirect)",
}
WANT = (3, 595.0, 842.5, True)


def of(data):
    got = pdf.structure_of(data, INFO)
    return got[:4], dict(zip(INFO, got[4:-1])), got[-1]


def test_trees_and_infos():
    plain = body(TREE) + b"trailer << /Root 1 0 R /Info 7 0 R >>"
    xref = b"902 0 obj << /Type /XRef /Root 1 0 R /Info 7 0 R /Length 0 >> stream\n\nendstream endobj"
    for data in (plain, body(TREE, tuple(TREE)) + xref, body(TREE, (1, 2, 7), length_ref=True) + xref, body(TREE, (5, 6, 10)) + b"trailer<</Root 1 0 R/Info 7 0 R>>"):
        tree, info, error = of(data)
        assert tree == WANT and error is None
        assert info["Title"] == "A (b) A c" and info["Author"] == "é A" and info["Creator"] == "indirect" and info["Keywords"] == "nested (in) it" and info["CreationDate"] == "D:20240102030405Z" and info["Subject"] is None
    later = plain + b"\n5 0 obj << /Type /Page /MediaBox [10 20 30 60] >> endobj\n1 0 obj << /Pages 2 0 R >> endobj"  # an update: the last object counts
    assert of(later)[0] == (3, 20.0, 40.0, False)


def test_odd_files():
    loop = dict(TREE) | {3: b"<< /Kids [2 0 R 3 0 R 5 0 R] >>"}
    assert of(body(loop) + b"trailer << /Root 1 0 R >>")[0] == (2, 595.0, 842.5, True)
    assert of(b"")[2] == of(b"junk")[2] == of(body(TREE))[2] == "no root"
    assert of(body(TREE) + b"trailer << /Root 1 0 R /Encrypt 9 0 R >>")[2] == "encrypted"
    assert of(body({1: b"<< /Pages 99 0 R >>"}) + b"trailer << /Root 1 0 R >>")[0] == (0, None, None, False)
    deep = {1: b"<< /Pages 2 0 R >>"} | {i: b"<< /Kids [%d 0 R] >>" % (i + 1) for i in range(2, 300)}
    assert of(body(deep) + b"trailer << /Root 1 0 R >>")[0][0] == 0
    whole = body(TREE, (1, 2, 5)) + b"trailer << /Root 1 0 R /Info 7 0 R >>"
    for _ in range(300):  # cut, changed and repeated bytes give nulls and a reason, or a reading
        a, b = sorted(random.sample(range(len(whole)), 2))
        for data in (whole[:a], whole[a:b], whole[:a] + bytes(random.choices(range(256), k=5)) + whole[b:], whole[:b] + whole[a:]):
            assert len(pdf.structure_of(data, INFO)) == 5 + len(INFO)


def test_files_by_spark(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(body(TREE, tuple(TREE)) + b"902 0 obj << /Type /XRef /Root 1 0 R /Info 7 0 R /Length 0 >> stream\n\nendstream endobj")
    (tmp_path / "b.pdf").write_bytes(b"junk")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pdf"))
    got = {r.path[-5:]: r for r in tables.pdf_properties(files, tables.pdf_structure(files)).collect()}
    a = got["a.pdf"]
    assert (a.pages_count, a.page_size, a.tagged, a.title, a.author, a.created_date, a.pdf_version) == (3, "[20.99 x 29.72 cm]", "Yes", "A (b) A c", "é A", "2024-01-02 03:04:05", "PDF-1.7")
    assert got["b.pdf"].pages_count == 0 and got["b.pdf"].title == "Unknown"
