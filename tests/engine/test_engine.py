"""Scalars, layout, batching, replies and streaming on small inputs with known results."""

import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.conf import EngineConf, Settings, key_variable, load_settings
from quire.functions import css, text
from quire.operators import assemble, batching, history, layout, metrics, pages, translate
from quire.sources import html, tables
from quire.streaming import progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_noise(spark):
    no = ["", "  ", " \t", "24", "0.58", "-", "+1, 2", "[12]", "(5)", "=", "²", "٣", "1-2", None]
    yes = ["(5a)", "[1,2]", "a", "I", "é", "漢", "x2", "%%", "a."]
    got = one(spark, no + yes, "t string", text.should_translate(F.col("t")))
    assert got == [False] * len(no) + [True] * len(yes)


def test_tokens(spark):
    cases = {"": 0, "a": 1, "abcd": 1, "x" * 40: 13, "漢": 0, "漢字": 1, "ab漢": 2, "abc漢": 1, "カタカナ": 1}
    assert one(spark, list(cases), "t string", text.estimate_tokens(F.col("t"))) == list(cases.values())


RANGES = [("1-3, 5", [0, 1, 2, 4]), ("3-1", [0, 1, 2]), ("6-9", []), ("-3", []), ("1-2-3", []), ("a,2", [1]), ("0", []), ("5,5,5-5", [4]), ("", []), (None, []), (" 2 - 4 ,7", [1, 2, 3, 6])]
REPLIES = [
    (1, '[{"id": "g-0", "translated": "a"}, {"id": "g-1", "translated": "b"}]', ["g-0=a", "g-1=b"]), (2, '```json\n[{"id": "g-0", "translated": "a"}]\n```', ["g-0=a"]), (3, '{"id": "g-0", "translated": "a"}', None),
    (4, 'Here: [{"id": "g-2", "translated": "c"}] done', ["g-2=c"]), (5, "nothing", None), (6, "[]", []),
]
DATES = [("D:20240131235959+01'00'", "2024-01-31 23:59:59"), ("D:2024", "2024"), (None, "Unknown"), ("", "Unknown"), ("20240131235959", "2024-01-31 23:59:59"), ("D:x", "x")]
SIZES = [("[21.00 x 29.70 cm]", "21.00cm 29.70cm", "21.0cm 29.7cm"), ("Unknown", "A4", "A4"), ("[5x6 cm]", "5cm 6cm", "5.0cm 6.0cm")]
PATHS = [("/a//b/./c.pdf", "/a/b/c.pdf", "c.pdf", "/a//b/./c_translated.pdf", True), ("/a/b/", "/a/b", "", "/a/b/_translated", False), ("x.PDF", "x.PDF", "x.PDF", "x_translated.PDF", True)]
MESSAGES = [("HTTP 429", True), ("RESOURCE_EXHAUSTED now", True), ("bad key", False), ("Timed Out", True), (None, False), ("model overloaded", True)]


@pytest.mark.parametrize("name", ["dates", "sizes", "paths", "ranges", "replies", "errors", "names", "lookups"])
def test_literal_tables(spark, name):
    t = F.col("t")
    if name == "dates":
        assert one(spark, [d for d, _ in DATES], "t string", text.pdf_date(t)) == [r for _, r in DATES]
    elif name == "sizes":
        assert one(spark, [s[0] for s in SIZES], "t string", text.page_size_css(t)) == [s[1] for s in SIZES]
        assert one(spark, [s[0] for s in SIZES], "t string", text.page_size_css(t, True)) == [s[2] for s in SIZES]
    elif name == "paths":
        for i, f in enumerate((text.path_key, text.base_name, text.output_name, tables.is_pdf), 1):
            assert one(spark, [p[0] for p in PATHS], "t string", f(t)) == [p[i] for p in PATHS]
    elif name == "errors":
        assert one(spark, [m for m, _ in MESSAGES], "t string", text.is_rate_limit(t)) == [limited for _, limited in MESSAGES]
        assert one(spark, [0, 1, 2, 3], "t int", translate.retry_delay(t)) == [2.0, 6.0, 18.0, 24.0]
    elif name == "names":
        names = ["openai/gpt-5", "gemini/x", "gpt-5", None]
        assert [r.provider for r in translate.provider_of(spark.createDataFrame([(n,) for n in names], "model string")).collect()] == ["OpenAI", "Google Gemini", None, None]
        assert one(spark, names, "t string", translate.qualified(t, F.lit("openai/"))) == ["openai/gpt-5", "openai/gemini/x", "openai/gpt-5", None]
    elif name == "lookups":
        rows = [("OpenAI", "k", True), ("OpenAI", " ", False), ("Ollama (Local)", None, True)]
        assert [r.ready for r in spark.createDataFrame(rows, "p string, k string, w boolean").select(history.provider_ready(F.col("p"), F.col("k")).alias("ready")).collect()] == [r[2] for r in rows]
        assert one(spark, [1, 3, 9, 2], "t int", pages.range_position(t, F.array(F.lit(0), F.lit(2), F.lit(5)), F.lit(4))) == [1, 2, 4, 2]
    elif name == "ranges":
        assert one(spark, [r[0] for r in RANGES], "t string", pages.page_range(t, F.lit(7))) == [r[1] for r in RANGES]
    else:
        got = one(spark, [r[1] for r in REPLIES], "t string", translate.parse_reply(t))
        assert [None if g is None else [f"{i.id}={i.translated}" for i in g] for g in got] == [r[2] for r in REPLIES]


def test_colors_round_trip(spark):
    got = spark.createDataFrame([("a\nb", "0066cc"), (" ", "0066cc"), ("x", None)], "t string, c string").select(text.color_tag(F.col("t"), F.col("c")).alias("g"))
    assert [r.g for r in got.collect()] == ["<color_0066cc>a\nb</color_0066cc>", " ", "x"]
    assert one(spark, ["<color_0066cc>a\nb</color_0066cc> <color_ff0000>c</color>"], "t string", text.color_html(F.col("t"))) == ['<span style="color: #0066cc;">a\nb</span> <span style="color: #ff0000;">c</span>']


def test_fences_templates_and_scalars(spark):
    t = F.col("t")
    assert one(spark, ["```json\n[1]\n```", " [1] ", "a\n  ```\nb"], "t string", text.drop_fences(t)) == ["[1]", "[1]", "a\nb"]
    assert one(spark, ["{n} and {n}", "none"], "t string", text.fill_first(t, "n", F.lit("3"))) == ["3 and {n}", "none"]
    assert one(spark, ["10", "999", "x", None], "t string", text.zoom(t)) == [50, 250, 80, 80]
    assert one(spark, ["pf1", "pf1a", "x"], "t string", text.page_of_hex(t)) == [0, 25, None]
    assert one(spark, ["é", None], "t string", text.nfc(t)) == ["é", None]


CSS = [
    (1, ".m0{transform:matrix(0.125,0,0,0.25,0,0);} .m1 { x:1; transform : matrix( -1.5 , 0, 0, 2 , 0,0)} .m0{transform:matrix(0.5,0,0,0.75,1,1)} .m2{transform:none} .m3{transform:matrix(1,2)}"),
    (2, "._0{margin-left:2px;} ._1{width:1.5em} ._2{left:-4.077908pt} ._a{width:50%} ._0{right:3rem} ._b{color:red;width:auto;left:1px} ._c{height:9px}"),
    (3, ".fc0{color:#abc;} .fc1{color:#1A2b3C} .fc2{color:rgb(255,50,50);} .fc3{color:rgba(0,0,0,0.5)} .fc4{color:transparent} .fc5{color:#12345678} .fc6{background-color:red;color:#fff} .fc1{color: #ffffff }"),
    (4, ".x0{left:85px;} .x1{margin-left:-2.5px} .y0{bottom:234px} .y1{margin-top:7px} .x2{left:3pt} @media print{.y2{bottom:1px}} .x3{top:1px} }{ junk"),
    (5, ""), (6, None),
]
RULES = [
    (1, "matrix", "m0", 0.5, 0.75, None), (1, "matrix", "m1", -1.5, 2.0, None), (2, "spacer", "0", 48.0, None, None), (2, "spacer", "1", 24.0, None, None), (2, "spacer", "2", round(-4.077908 * 1.333333, 6), None, None), (2, "spacer", "a", 50.0, None, None), (2, "spacer", "b", 1.0, None, None),
    (3, "color", "fc0", None, None, "aabbcc"), (3, "color", "fc1", None, None, "ffffff"), (3, "color", "fc2", None, None, "ff3232"), (3, "color", "fc3", None, None, "000000"), (3, "color", "fc5", None, None, "12345678"),
    (4, "left", "x0", 85.0, None, None), (4, "left", "x1", -2.5, None, None), (4, "bottom", "y0", 234.0, None, None), (4, "bottom", "y1", 7.0, None, None), (4, "bottom", "y2", 1.0, None, None),
]


def test_style_rules(spark):
    got = css.style_rules(spark.createDataFrame(CSS, "id int, css string"), ["id"])
    assert sorted(map(str, [(r.id, r.kind, r["class"], None if r.v1 is None else round(r.v1, 6), r.v2, r.hex) for r in got.collect()])) == sorted(map(str, RULES))


PAGE = """<html><head><style>.m0{transform:matrix(0.5,0,0,0.25,0,0);} .m1{transform:matrix(1,0,0,1,0,0);}
._0{width:40px;} ._1{width:6px;} ._2{width:-3px;} .fc0{color:#000;} .fc1{color:#f00;}</style></head><body>
<div class="pf"><div class="t m0 x1">Two<span class="_ _1"> </span>words<span class="_ _0"> </span>Next <span class="ff1 fc1">red<span class="_ _2"></span>dish</span></div>
<div class="t m9">café <em class="fc1"> </em>ðxÞ</div><div class="t m1"><span class="_ _0"></span>  <span class="_ _0"></span></div></div>
<div class="pf"><div class="t m1">last &amp; <sup>1</sup><a href="x">link</a><br></div></div></body></html>"""


def test_segments(spark):
    got = layout.segments(spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "doc_id long, html string")).orderBy("seg_no").collect()
    assert [(r.seg_id, r.page_idx, r.line_no, r.sx, r.sy, r.text) for r in got] == [
        ("g-0", 0, 0, 0.5, 0.25, "Two words"), ("g-1", 0, 0, 0.5, 0.25, "Next <color_ff0000>red</color_ff0000><color_ff0000>dish</color_ff0000>"),
        ("g-2", 0, 1, 1.0, 1.0, "café  (x)"), ("g-3", 1, 0, 1.0, 1.0, "last & 1link"),
    ]


def test_wrapped_lines_hold_every_run(spark):
    got = {(r.page_idx, r.line_no): r.html_fragment for r in layout.wrapped_lines(spark.createDataFrame([(1, PAGE)], "doc_id long, html string")).collect()}
    first = got[0, 0]
    assert first.startswith('<span class="trans-span" data-trans-id="g-0" data-sx="0.5" data-sy="0.25">') and '<span class="_ _0"></span><span class="trans-span ff1" data-trans-id="g-1"' in first
    assert "data-trans-id" not in got[0, 2] and 'data-trans-id="g-3"' in got[1, 0]


def test_visual_order(spark):
    lines = spark.createDataFrame([(1, 0, 0, ["t", "x1", "y1"]), (1, 0, 1, ["x0", "y2"]), (1, 0, 2, ["x0", "y1"]), (1, 1, 0, ["t"])], "doc_id int, page_idx int, line_no int, line_classes array<string>")
    rules = css.style_rules(spark.createDataFrame([(1, ".x0{left:5px} .x1{left:9px} .y1{bottom:50px} .y2{bottom:70px}")], "doc_id int, css string"), ["doc_id"])
    got = layout.visual_order(lines, rules).orderBy("page_idx", "visual_no").collect()
    assert [(r.line_no, r.x, r.y) for r in got] == [(1, 5.0, 70.0), (2, 5.0, 50.0), (0, 9.0, 50.0), (0, 0.0, 0.0)]


def test_malformed_pages_parse():
    rows = html.runs_of("<p>a <b>bold<br>more<p>second</i> x<script>var y</script></p><td>cell", plain=True)
    lines = {}
    for r in rows:
        lines.setdefault(r[1], []).append(r[5])
    assert ["".join(v).split() for v in lines.values()] == [["a", "boldmore"], ["second", "x"], ["cell"]]
    assert [r[5] for r in html.runs_of("<p>1<b>2</b> 3 < 4 &lt; <b" + " <b" * 50_000, plain=True)][:2] == ["1", "2"]
    assert [r[5] for r in html.runs_of("<p>a<!-- <b>x</b> -->b<!-- open", plain=True)] == ["ab"]
    assert html.runs_of(None) == [] and html.runs_of("<div class=t>no page</div>") == []


def slow_batches(tokens, budget, most):
    out, total, shut = [], 0, True
    for t in tokens:
        if not shut and t <= budget and total + t <= budget and len(out[-1]) < most:
            out[-1].append(t)
            total += t
        else:
            out.append([t])
            total, shut = t, t > budget
    return out


def test_batching_known(spark):
    assert slow_batches([4, 4, 4, 12, 1, 1, 1, 1, 9, 2], 10, 3) == [[4, 4], [4], [12], [1, 1, 1], [1, 9], [2]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=40), min_size=1, max_size=5), st.integers(1, 40), st.integers(1, 6))
def test_batching_equals_the_loop(spark, documents, budget, most):
    rows = [(d, p, f"g-{p}", "x" * n, 0) for d, sizes in enumerate(documents) for p, n in enumerate(sizes)]
    got = {}
    frame = spark.createDataFrame(rows, "doc_id long, pos int, seg_id string, text string, page_idx int")
    for r in batching.batches(frame, budget=budget, max_rows=most).orderBy("doc_id", "batch_no").collect():
        got.setdefault(r.doc_id, []).append([s.id for s in r.segments])
    for d, sizes in enumerate(documents):
        kept = [(p, n) for p, n in enumerate(sizes) if n > 0]
        tokens = [max(1, n * 13 // 40) for _, n in kept]
        ids, at = [], 0
        for b in slow_batches(tokens, budget, most):
            ids.append([f"g-{p}" for p, _ in kept[at : at + len(b)]])
            at += len(b)
        assert got.get(d, []) == ids


class Flaky:
    """Fails twice, then answers; the model that answers shows in the text."""

    def __init__(self, failures):
        self.failures, self.seen = failures, 0

    def __call__(self, system, message, model):
        self.seen += 1
        if self.seen <= self.failures:
            raise RuntimeError("429 quota")
        return f'[{{"id": "g-0", "translated": "{model}"}}]'


def test_retry_and_fallback():
    conf = EngineConf(model="mistral/mistral-medium-3.5", keys={"Mistral AI": "k"})
    waits = []
    items, attempts, model, error = translate.call(Flaky(2), "s", "m", conf, waits.append)
    assert (items[0]["translated"], attempts, model, error) == ("mistral/mistral-small-latest", 3, "mistral/mistral-small-latest", "") and waits == [2.0, 6.0]
    items, attempts, model, error = translate.call(Flaky(9), "s", "m", conf, waits.append)
    assert items is None and attempts == 4 and "429" in error and model == "mistral/mistral-large-latest"
    assert translate.call(Flaky(0), "s", "m", conf, cancelled=lambda: True)[3] == "cancelled" and error.startswith("rate limited: RuntimeError")
    asked = iter([False, True])
    assert translate.call(Flaky(9), "s", "m", conf, waits.append, cancelled=lambda: next(asked))[1:] == (1, conf.model, "cancelled")
    assert translate.translate_text(Flaky(9), "x", conf, waits.append) == translate.FAILED + "x"
    assert translate.next_model("openai/o4-mini", {"OpenAI": "k"}) is None and translate.next_model("openai/unknown", {"OpenAI": "k"}) == "openai/gpt-5" and translate.next_model("ollama/llama3", {}, "k") is None


def test_repair():
    assert translate.read_reply('```\n[{"id": "a", "translated": "b"},]\n```') == [{"id": "a", "translated": "b"}]
    assert translate.read_reply('ok [{"id": "a"}, {"id": "b", "tra') == [{"id": "a"}]
    assert translate.read_reply('[{"id": "a", "translated": "b"} {"id": "c", "translated": "d"}]') == [{"id": "a", "translated": "b"}, {"id": "c", "translated": "d"}]
    assert translate.read_reply("[{'id': 'a', 'translated': 'it\\'s \"b\"'}]") == [{"id": "a", "translated": 'it\'s "b"'}]
    assert translate.read_reply('[{"id": "a", "translated": "two\nlines"}]') == [{"id": "a", "translated": "two\nlines"}]
    assert translate.read_reply('{"id": 1}') is None and translate.read_reply("no") is None


class Contexts:
    def __call__(self, system, message, model):
        import json

        head, _, payload = message.rpartition(translate.CONTEXT_TAIL)
        seen = head.replace(translate.CONTEXT_HEAD, "").replace("\n", "|")
        return json.dumps([{"id": s["id"], "translated": f"{s['text']}<{seen}"} if i == 0 else {"id": s["id"], "translated": s["text"]} for i, s in enumerate(json.loads(payload))])


def test_context_runs_through_a_document(spark):
    rows = [(1, i, f"g-{i}", w, 0) for i, w in enumerate(["aa", "bb", "cc", "dd", "ee"])] + [(2, 0, "g-0", "zz", 0)]
    batched = batching.batches(spark.createDataFrame(rows, "doc_id long, pos int, seg_id string, text string, page_idx int"), max_rows=2)
    got = translate.translate_batches(batched, Contexts(), EngineConf(context_size=1), with_context=True).orderBy("doc_id", "batch_no").collect()
    assert [[i.translated for i in r["items"]] for r in got] == [["aa<", "bb"], ["cc<bb", "dd"], ["ee<dd"], ["zz<"]]


def test_prompts(spark):
    assert "Latin" in translate.system_prompt("Latin") and "rule x" in translate.system_prompt("Latin", " rule x ")
    got = spark.range(1).select(translate.system_prompt_column(F.lit("Latin"), F.lit("rule x")).alias("p")).first().p
    assert got == translate.system_prompt("Latin", "rule x")
    message = spark.createDataFrame([([("g-0", 'a"b\n')], "c")], "s array<struct<id:string,text:string>>, c string").select(translate.user_message(F.col("s"), F.col("c")).alias("m")).first().m
    assert message == translate.CONTEXT_HEAD + "c" + translate.CONTEXT_TAIL + '[{"id": "g-0", "text": "a\\"b\\n"}]'


def test_assembly_statuses(spark):
    seg = spark.createDataFrame([(1, f"g-{i}", 0, t) for i, t in enumerate(["one", "two", "3", "four"])], "doc_id long, seg_id string, page_idx int, text string")
    replies = spark.createDataFrame([(1, 0, [("g-0", "un"), ("g-1", "x"), ("g-9", "?"), ("g-3", " ")]), (1, 1, [("g-1", "deux"), (None, "n"), ("g-0", None)])], "doc_id long, batch_no int, items array<struct<id:string,translated:string>>")
    last = assemble.last_items(assemble.items(replies, trim=True))
    got = {r.seg_id: (r.translated, r.status) for r in assemble.assemble(seg, last).collect()}
    assert got == {"g-0": ("un", "ok"), "g-1": ("deux", "duplicate"), "g-2": ("3", "bypassed"), "g-3": ("four", "missing")}
    assert [(r.seg_id, r.page_idx) for r in assemble.unexpected(seg, last).collect()] == [("g-9", 0)]


def test_properties(spark):
    def of(n, p, done):
        rows = spark.createDataFrame([(1, f"g-{i}", i * p // n, "word") for i in range(n)], "doc_id long, seg_id string, page_idx int, text string")
        r = metrics.document_properties(rows, rows.limit(done).withColumn("translated", F.lit("w"))).first()
        return r.complexity, r.status

    assert of(30, 2, 0) == ("medium", "none") and of(29, 2, 29) == ("low", "full") and of(91, 2, 5) == ("high", "partial")


def test_fit_and_visibility(spark):
    r = spark.range(1).select(text.fit_scale(F.lit(0.5), F.lit(10.0), F.lit(20.0)).alias("a"), text.fit_scale(F.lit(0.5), F.lit(20.0), F.lit(10.0)).alias("b"), text.fit_scale(F.lit(0.5), F.lit(0.0), F.lit(1.0)).alias("c"), text.text_width(F.lit("iiM漢")).alias("w")).first()
    assert (r.a, r.b, r.c, r.w) == (0.25, 0.5, 0.5, 3 + 3 + 7 + 10)
    boxes = spark.createDataFrame([(1, 0, -50.0, 50.0), (1, 1, 50.0, 100.0), (1, 2, 100.0, 300.0)], "k int, page_idx int, top double, bottom double")
    assert pages.most_visible(boxes, 100.0, "k").first().page_idx == 0


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert load_settings(path) == {}
    s = Settings(path)
    s.set("a", "b", "7")
    assert Settings(path).get("a", "b") == "7" and s.number("a", "b", 1.0) == 7.0 and s.number("a", "z", 2.0) == 2.0
    (tmp_path / "s.json").write_text("[1]")
    assert load_settings(path) == {}
    assert key_variable("x/GPT-5") == "OPENAI_API_KEY" and key_variable("claude-x") == "ANTHROPIC_API_KEY" and key_variable("gemini") == "GEMINI_API_KEY" and key_variable("z") is None


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x\ny</p>", encoding="utf-8")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Linearized")
    (tmp_path / "b.pdf").write_bytes(b"junk")
    assert tables.html_files(spark, str(tmp_path / "*.html")).first().html == "<p>x\ny</p>"
    assert sorted((r.version or "", r.linearized) for r in tables.pdf_headers(spark, str(tmp_path / "*.pdf")).collect()) == [("", False), ("1.4", True)]
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pdf"))
    good = tables.compile_documents(files, ["cp", "{in}", "{out}"])
    assert sorted(r.html for r in good.collect()) == ["%PDF-1.4 /Linearized", "junk"]
    assert {r.error for r in tables.compile_documents(files, ["false"]).collect()} == {"exit 1"} and {r.error for r in tables.compile_documents(files, ["no-such-command"]).collect()} == {"FileNotFoundError"}
    assert tables.pending(files.select("path"), good.select("path", "html").where("html <> 'junk'")).count() == 1


def test_recent_and_lookups(spark):
    opened = spark.createDataFrame([("/a//b.pdf", 1), ("/a/b.pdf", 5), ("/c.pdf", 3)], "path string, ts long")
    assert [tuple(r) for r in history.recent(opened, 1).collect()] == [(1, "b.pdf", "/a/b.pdf")]
    assert history.existing(opened, spark.createDataFrame([("/c.pdf",)], "path string")).count() == 1


def test_landing_is_idempotent(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "g-0", "a"), (1, "g-1", "b")], "doc_id long, seg_id string, translated string")
    rows.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source)
    progress.land(stream(), out)
    rows.selectExpr("doc_id", "seg_id", "upper(translated) AS translated").coalesce(1).write.mode("append").parquet(source)
    progress.land(stream(), out)
    progress.land(stream(), out)  # nothing new
    assert sorted(r.translated for r in progress.landed(spark, out, ["doc_id", "seg_id"], ["translated"]).collect()) == ["A", "B"]
    assert spark.read.parquet(f"{out}/rows").count() == 4
    assert progress.cancellable(spark, "t1", lambda: spark.range(3).count()) == 3
    assert progress.clear(spark, out) and not progress.clear(spark, out)


def test_engine_from_files_to_pages(spark, tmp_path):
    from quire.api import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text(PAGE, encoding="utf-8")
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "-l", "de", "--translator", "quire.operators.translate:Echo"]) == 0
    page = spark.read.parquet(str(tmp_path / "out" / "html")).first().html
    assert 'data-trans-id="g-0" data-sx="0.5" data-sy="0.25">[x] Two words</span>' in page and page.index("@page{size:A4") < page.index("</head>") and "<script" not in page
    assert '[x] Next <span style="color: #ff0000;">red</span>' in page and 'style="transform:matrix(0.' in page and page.count("</div>") == PAGE.count("</div>")
    (done,) = (tmp_path / "out" / "work").glob("*/assembled")
    assert {r.status for r in spark.read.parquet(str(done)).collect()} == {"ok"}


class Odd:
    """Answers that repeat ids and hold markup."""

    def __call__(self, system, message, model):
        import json

        ids = [s["id"] for s in json.loads(message)]
        return json.dumps([{"id": i, "translated": t} for i in ids for t in ("first", "<b>last</b> </script><i onclick=x>")])


def test_pages_hold_translations_as_text(spark, tmp_path):
    from quire.api import Engine

    docs = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>no page</p></head>")], "doc_id long, html string")
    seen = []
    engine = Engine(Odd(), on_progress=lambda done, total: seen.append((done, total)))
    got = {r.doc_id: r.html for r in engine.translate(docs, str(tmp_path)).collect()}
    assert got[1].count("<b>last</b> &lt;/script&gt;&lt;i onclick=x&gt;</span>") == 4 and "first" not in got[1] and "</script>" not in got[1] and seen[-1] == (4, 4) and sorted(seen) == seen
    assert got[2] == "" and got[3].startswith("<p>no page</p><style>@page")
    twice = spark.createDataFrame([(1, "g-0", "Two words", "a"), (1, "g-0", "Two words", "b")], "doc_id long, seg_id string, text string, translated string")
    assert ">b</span>" in engine.render(docs, twice, bilingual=True).where("doc_id = 1").first().html
    assert 'title="Two words"' in engine.render(docs, twice, bilingual=True).where("doc_id = 1").first().html
    waiting = engine.instrument(docs).where("doc_id = 1").first().html
    assert waiting.count('class="waiting"') == 2 and '<div class="pf"><div class="waiting" id="waiting-0"></div><div class="t m0 x1"' in waiting
    sizes = spark.createDataFrame([(1, "21cm 29cm")], "doc_id long, size_css string")
    assert "@page{size:21cm 29cm" in engine.render(docs, twice, sizes).where("doc_id = 1").first().html


def test_resume_and_languages(spark, tmp_path):
    from quire.api import Engine

    docs = spark.createDataFrame([(1, PAGE)], "doc_id long, html string")
    first = Engine(translate.Echo("[1] "), EngineConf(max_segments=2))
    first.translate(docs, str(tmp_path)).collect()
    again = Engine(translate.Echo("[2] "), EngineConf(max_segments=2)).translate(docs, str(tmp_path), resume=True).first().html
    assert "[1] Two words" in again and "[2]" not in again
    other = Engine(translate.Echo("[3] "), EngineConf(target_language="German")).translate(docs, str(tmp_path), resume=True).first().html
    assert "[3] Two words" in other and len(list(tmp_path.glob("*/replies"))) == 2
    stop = Engine(translate.Echo(), cancelled=lambda: True)
    assert {r.error for r in stop.replies(stop.batches(stop.segments(docs))).collect()} == {"cancelled"}


def test_pdf_to_pdf(spark, tmp_path):
    from quire.api import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text(PAGE.replace("<html>", "<!-- %PDF-1.5 /Type /Page /MediaBox [0 0 595 842] --><html>"), encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text("no")
    args = [str(tmp_path / "in"), str(tmp_path / "out"), "--compiler", "cp {in} {out}", "--printer", "cp {in} {out}", "-k", "secret", "--resume", "--translator", "quire.operators.translate:Echo"]
    for _ in range(2):
        assert main(args) == 0
        (printed,) = spark.read.parquet(str(tmp_path / "out" / "pdf")).collect()
        assert b"[x] Two words" in bytes(printed.content) and b"@page{size:20.99cm 29.70cm" in bytes(printed.content)
    assert spark.read.parquet(str(tmp_path / "out" / "work" / "compiled")).count() == 1


def test_service(spark):
    import http.server
    import json
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers["Authorization"], body))
            broken = len(asked) == 1
            content = json.dumps([{"id": s["id"], "translated": s["text"].upper()} for s in json.loads(body["messages"][1]["content"])])
            data = b"slow down" if broken else json.dumps({"choices": [{"message": {"content": content}}]}).encode()
            self.send_response(429 if broken else 200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        service = translate.ChatCompletions(f"http://127.0.0.1:{server.server_port}/v1/", 0.3, 99, "k1")
        waits = []
        items, attempts, _, error = translate.call(service, "s", '[{"id": "g-0", "text": "abc"}]', EngineConf(model="openai/gpt-5"), waits.append)
        assert items == [{"id": "g-0", "translated": "ABC"}] and attempts == 2 and error == "" and waits == [2.0]
        path, key, body = asked[1]
        assert path == "/v1/chat/completions" and key == "Bearer k1" and (body["temperature"], body["max_tokens"], body["model"], body["messages"][0]["content"]) == (0.3, 99, "openai/gpt-5", "s")
        from quire.api import Engine

        engine = Engine(conf=EngineConf(base_url=f"http://127.0.0.1:{server.server_port}/v1", temperature=0.5))
        d = spark.createDataFrame([(1, PAGE)], "doc_id long, html string")
        assert ">TWO WORDS</span>" in engine.render(d, engine.assemble(engine.segments(d), engine.replies(engine.batches(engine.segments(d))))).first().html
        assert asked[-1][2]["temperature"] == 0.5
    finally:
        server.shutdown()


def test_settings_to_conf(tmp_path):
    from quire.conf import engine_conf

    s = Settings(str(tmp_path / "s.json"))
    for name, value in (("temperature", "0.2"), ("sliding_context_size", 0), ("max_segments_per_batch", "x"), ("custom_glossary", " g ")):
        s.set("TranslationConfig", name, value)
    s.set("APIConfig", "use_custom_base", True)
    s.set("APIConfig", "custom_base_url", " http://h/v1 ")
    s.set("APIConfig", "api_keys_by_provider", {"OpenAI": "k"})
    c = engine_conf(s, model="m")
    assert (c.temperature, c.context_size, c.max_segments, c.glossary, c.base_url, c.keys, c.model) == (0.2, 0, 60, "g", "http://h/v1", {"OpenAI": "k"}, "m")
    s.reset()
    assert engine_conf(Settings(str(tmp_path / "s.json"))) == EngineConf()


def test_sinks_and_structure(spark, tmp_path):
    from quire.sources import sinks

    docs = spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>b</p>")], "doc_id long, html string")
    sinks.write_text(docs, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    assert sorted(bytes(r.content) for r in sinks.print_documents(docs, ["cp", "{in}", "{out}"]).collect()) == [b"<p>a</p>", b"<p>b</p>"]
    assert {r.error for r in sinks.print_documents(docs, ["false"]).collect()} == {"exit 1"}
    (tmp_path / "x.pdf").write_bytes(b"junk")
    got = tables.pdf_structure(spark.read.format("binaryFile").load(str(tmp_path / "x.pdf"))).first()
    assert got.pages is None and got.error == "no root" and got.title is None
    whole = tables.pdf_properties(spark.read.format("binaryFile").load(str(tmp_path / "x.pdf"))).first()
    assert (whole.file_size, whole.pdf_version, whole.linearized, whole.tagged, whole.page_size, whole.pages_count, whole.title, whole.keywords, whole.mod_date) == ("0.00 MB", "PDF-1.4", "No", "No", "Unknown", 0, "Unknown", "None", "Unknown")
    better = tables.pdf_properties(spark.read.format("binaryFile").load(str(tmp_path / "x.pdf")), spark.createDataFrame([(got.path, 7, 595.0, 842.0, True, None, "s", None, None, None, None, "D:2024", None)], "path string, pages int, width_pt double, height_pt double, tagged boolean, " + ", ".join(f"{n} string" for n in tables.INFO))).first()
    assert (better.pages_count, better.page_size, better.tagged, better.title, better.subject, better.created_date) == (7, "[20.99 x 29.70 cm]", "Yes", "x", "s", "2024")


def test_registry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "batch_no", "n_segments", "estimated_tokens", "first_seg", "last_seg"]
