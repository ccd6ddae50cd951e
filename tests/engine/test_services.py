"""Services, the ledger of replies, live progress and damaged replies."""

import http.server
import json
import os
import random
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.api import Engine, main
from quire.conf import EngineConf, Settings
from quire.operators import batching, ledger, providers, replies, translate

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Service:
    """A local service that answers in upper case; fails with a status as long as it is told to."""

    def __init__(self, form="chat", status=200, seconds=0.0):
        service = self
        self.asked, self.status, self.open, self.most, lock = [], status, 0, 0, threading.Lock()

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with lock:
                    service.open += 1
                    service.most = max(service.most, service.open)
                    service.asked.append((time.monotonic(), self.path, dict(self.headers), body))
                time.sleep(seconds)
                content = json.dumps([{"id": s["id"], "translated": s["text"].upper()} for s in json.loads(body["messages"][-1]["content"])])
                answer = {"content": [{"type": "text", "text": content}]} if form == "messages" else {"choices": [{"message": {"content": content}}]}
                with lock:
                    service.open -= 1
                self.send_response(service.status)
                self.end_headers()
                self.wfile.write(json.dumps(answer).encode())

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1/"


ASK = '[{"id": "g-0", "text": "abc"}]'


def test_models_go_to_their_own_service():
    large, small, other = Service(status=503), Service(), Service("messages")
    routes = (providers.Route("mistral/", "Mistral AI", large.url), providers.Route("mistral/mistral-small", "Mistral AI", small.url), providers.Route("anthropic/", "Anthropic", other.url, "messages"))
    routes = (*routes[:1], providers.Route("mistral/mistral-small", "Mistral AI", small.url, strip=False), routes[2])
    keys = {"Mistral AI": "k1", "Anthropic": "k2"}
    service = providers.Providers(keys, 0.5, 77, routes=routes)
    waits = []
    items, attempts, model, error = translate.call(service, "sys", ASK, EngineConf(model="mistral/mistral-medium-3.5", keys=keys), waits.append)
    assert (items, attempts, model, error) == ([{"id": "g-0", "translated": "ABC"}], 3, "mistral/mistral-small-latest", "")
    assert [a[3]["model"] for a in large.asked] == ["mistral-medium-3.5"] * 2 and [a[3]["model"] for a in small.asked] == ["mistral/mistral-small-latest"]
    assert small.asked[0][2]["Authorization"] == "Bearer k1" and small.asked[0][1] == "/v1/chat/completions" and (small.asked[0][3]["temperature"], small.asked[0][3]["max_tokens"]) == (0.5, 77)
    assert translate.call(service, "sys", ASK, EngineConf(model="anthropic/claude-4-opus"), waits.append)[0] == [{"id": "g-0", "translated": "ABC"}]
    _, path, headers, body = other.asked[0]
    headers = {k.lower(): v for k, v in headers.items()}
    assert path == "/v1/messages" and headers["x-api-key"] == "k2" and headers["anthropic-version"] and body["system"] == "sys" and body["model"] == "claude-4-opus" and [m["role"] for m in body["messages"]] == ["user"]
    for model, why in (("unheard/of", "no service"), ("xai/grok-4", "no key")):
        assert why in translate.call(providers.Providers({}), "s", ASK, EngineConf(model=model, max_retries=1))[3]


def test_routes_and_keys(spark, monkeypatch):
    for r in providers.ROUTES:
        monkeypatch.delenv(next((p[2] for p in providers.PROVIDERS if p[0] == r.provider), "X"), raising=False)
    assert providers.route_of("gpt-5").provider == "OpenAI" and providers.route_of("openrouter/openai/gpt-5").provider == "OpenRouter" and providers.route_of("x") is None
    assert providers.key_of("groq/a", {}) is None and providers.key_of("groq/a", {"": "all"}) == "all" and providers.key_of("ollama/llama3", {}) == ""
    monkeypatch.setenv("GROQ_API_KEY", "env")
    assert providers.key_of("groq/a", {"Groq": "own"}) == "own" and providers.key_of("groq/a", {}) == "env"
    models = spark.createDataFrame([("gemini/g",), ("claude-4-sonnet",), ("none",)], "model string")
    got = {r.model: (r.provider, r.form, r.name) for r in providers.routed(models).collect()}
    assert got == {"gemini/g": ("Google Gemini", "chat", "g"), "claude-4-sonnet": ("Anthropic", "messages", "claude-4-sonnet"), "none": (None, None, None)}


def test_calls_are_bounded_and_paced():
    service = Service(seconds=0.05)
    ask = providers.ChatCompletions(service.url, calls=3, pace=0.02)
    threads = [threading.Thread(target=ask, args=("s", ASK, "m")) for _ in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    starts = sorted(a[0] for a in service.asked)
    assert len(starts) == 12 and 1 < service.most <= 3 and starts[-1] - starts[0] >= 0.15


def test_command_line_needs_a_transformer(tmp_path, monkeypatch, capsys):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    for args, why in ((["-m", "openai/gpt-5"], "no key for OpenAI"), (["-m", "unheard/of", "-k", "x"], "no service is known")):
        with pytest.raises(SystemExit) as e:
            main([str(tmp_path), str(tmp_path / "out"), "-l", "de", *args])
        assert e.value.code == 2 and why in capsys.readouterr().err
    assert not (tmp_path / "out").exists()


class Counting:
    """Writes a line for each call; ends its worker once, after some calls."""

    def __init__(self, folder, die_after=None):
        self.folder, self.die_after = folder, die_after

    def __call__(self, system, message, model):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(message.replace("\n", " ") + "\n")
        with open(f"{self.folder}/calls") as f:
            n = len(f.readlines())
        if self.die_after is not None and n > self.die_after and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        return json.dumps([{"id": s["id"], "translated": s["text"].upper()} for s in json.loads(message.rpartition(translate.CONTEXT_TAIL)[2])])


def frame(spark, n, copies=0):
    rows = [(d, i, f"g-{i}", f"text {d} {i}", 0) for d in range(n) for i in range(6)]
    rows += [(n + d, i, f"g-{i}", f"text 0 {i}", 0) for d in range(copies) for i in range(6)]
    return batching.batches(spark.createDataFrame(rows, "doc_id long, pos int, seg_id string, text string, page_idx int"), max_rows=3)


@pytest.mark.parametrize("with_context", [False, True])
def test_a_killed_task_asks_for_nothing_again(spark, tmp_path, with_context):
    batched = frame(spark, 8)
    conf = EngineConf(calls=1, commit_every=1, tasks=2)
    ask = lambda **kw: translate.translate_batches(batched, Counting(str(tmp_path), 7), conf, with_context=with_context, ledger=str(tmp_path / "ledger"), **kw)
    with pytest.raises(Exception):
        ask(run="one").collect()
    calls = lambda: (tmp_path / "calls").read_text().splitlines()
    before = len(calls())
    assert 8 <= before <= 16
    got = ask(run="two").collect()  # a later run goes on where the ledger ends
    asked = [c.rpartition("TRANSLATE]")[2].strip() for c in calls()]
    assert len(got) == 16 and all(r.error is None and len(r["items"]) == 3 for r in got) and sum(r.attempts == 0 for r in got) >= before - 3
    assert len(set(asked)) == 16 and len(asked) <= 16 + 2  # what was under way when a worker ended
    n = len(calls())
    again = ask(run="three").collect()
    assert len(calls()) == n and all(r.attempts == 0 for r in again)
    key = lambda r: (r.doc_id, r.batch_no)
    assert [[i.asDict() for i in r["items"]] for r in sorted(again, key=key)] == [[i.asDict() for i in r["items"]] for r in sorted(got, key=key)]
    assert ledger.entries(spark, str(tmp_path / "ledger")).count() == 16


def test_another_attempt_finds_what_was_committed(tmp_path):
    first = ledger.Writer(str(tmp_path), 3, 2)
    for i in range(5):
        first.add({"id": str(i), "items": [{"id": "g", "translated": "line\nend"}], "attempts": 1, "model": "m"})
    assert sorted(ledger.earlier(str(tmp_path), 3)) == ["0", "1", "2", "3"] and ledger.earlier(str(tmp_path), 4) == {}
    first.commit()
    second = ledger.Writer(str(tmp_path), 3, 2)
    second.add({"id": "9", "items": [], "attempts": 1, "model": "m"})
    second.commit()
    assert len(ledger.earlier(f"file://{tmp_path}", 3)) == 6 and ledger.earlier(str(tmp_path), 3)["4"]["items"][0]["translated"] == "line\nend"


def test_copies_are_paid_once(spark, tmp_path):
    got = translate.translate_batches(frame(spark, 3, copies=5), Counting(str(tmp_path)), EngineConf(calls=4, tasks=3), ledger=str(tmp_path / "ledger")).collect()
    assert len(got) == 16 and len((tmp_path / "calls").read_text().splitlines()) == 6
    assert {tuple(i.translated for i in r["items"]) for r in got if r.doc_id >= 3} == {("TEXT 0 0", "TEXT 0 1", "TEXT 0 2"), ("TEXT 0 3", "TEXT 0 4", "TEXT 0 5")}


class Slow(translate.Echo):
    def __call__(self, system, message, model):
        time.sleep(0.3)
        return super().__call__(system, message, model)


def test_progress_rises_while_replies_come_in(spark, tmp_path):
    page = "<html><head></head><body><div class='pf'>" + "".join(f"<div class='t'>line {i}</div>" for i in range(24)) + "</div></body></html>"
    seen = []
    engine = Engine(Slow(), EngineConf(max_segments=2, calls=1, commit_every=1, tasks=1), on_progress=lambda done, total: seen.append((done, total)))
    assert "[x] line 23" in engine.translate(spark.createDataFrame([(1, page)], "doc_id long, html string"), str(tmp_path)).first().html
    assert seen[-1] == (24, 24) and len(seen) >= 4 and sorted(seen) == seen and {t for _, t in seen} == {24} and 0 < seen[0][0] < 24


TEXTS = list("ab \"'{}[],:\\\n`é“”") + ["```", '", "', "'}, {'", "null", "[1, ]"]


def test_strings_are_never_changed():
    random.seed(3)
    for _ in range(3000):
        items = [{"id": f"g-{i}", "translated": "".join(random.choices(TEXTS, k=random.randint(0, 12)))} for i in range(random.randint(1, 4))]
        each = [json.dumps(x, ensure_ascii=False) for x in items]
        for raw in ("[" + ",".join(each) + ",]", "[" + " ".join(each) + "]", "```json\n[" + "\n".join(each) + "]\n```", "Sure:\n[" + ", ".join(each) + "] ok", ",\n".join([*each, ""]) if len(each) > 1 else json.dumps(items)):
            assert replies.read_reply(raw) == items, raw


def test_damaged_replies():
    read = replies.read_reply
    assert read('[{"id": "a", "translated": "set {a} {b} and [1, ] end"},]') == [{"id": "a", "translated": "set {a} {b} and [1, ] end"}]
    assert read('[{"id": "a", "translated": "He said "hi", ok? "x": y"}, {"id":"b","translated":"z"}]')[0]["translated"] == 'He said "hi", ok? "x": y'
    assert read("[{id: a, 'translated': None}, {“id”: “x” “translated”: “y”}]") == [{"id": "a", "translated": None}, {"id": "x", "translated": "y"}]
    assert read('[{"id":"a","translated":"x"},{"id":"b","translated":"cut off he') == [{"id": "a", "translated": "x"}]
    assert read('Here [1] it is: [{"id": "g-0", "translated": "c"}] done [x]') == [{"id": "g-0", "translated": "c"}]
    assert read('[{"id":"a","translated":"\\ud83d\\ude00\\q\\u00e9"},]')[0]["translated"] == "😀\\qé"
    assert read('{"id": 1}') is read("no") is read("") is read(None) is read("[") is None and read("[]") == []
    assert replies.items_of([{"id": 5, "translated": ["x"]}, "no", {}]) == [{"id": "5", "translated": '["x"]'}, {"id": None, "translated": None}]
    for _ in range(3000):
        read("".join(random.choices(TEXTS, k=30)))


def test_settings_reset(tmp_path):
    s = Settings(str(tmp_path / "s.json"))
    for section, key in (("a", "x"), ("a", "y"), ("b", "x")):
        s.set(section, key, 1)
    s.reset("a", "x")
    assert Settings(s.path).values == {"a": {"y": 1}, "b": {"x": 1}}
    s.reset("b")
    assert Settings(s.path).values == {"a": {"y": 1}}
    s.reset()
    assert Settings(s.path).values == {}


class Contexts:
    def __call__(self, system, message, model):
        head, _, payload = message.rpartition(translate.CONTEXT_TAIL)
        seen = head.replace(translate.CONTEXT_HEAD, "").replace("\n", "|")
        if "boom" in payload:
            raise RuntimeError("bad key")
        return json.dumps([{"id": s["id"], "translated": f"{s['text']}<{seen}>"} for s in json.loads(payload)])


@pytest.mark.parametrize("with_context", [False, True])
def test_table_function_equals_the_batches(spark, with_context):
    from quire.operators import table_function

    rows = [(d, i, f"g-{i}", "boom" if (d, i) == (2, 5) else f"text {d} {i}", 0) for d in range(4) for i in range(9)]
    batched = batching.batches(spark.createDataFrame(rows, "doc_id long, pos int, seg_id string, text string, page_idx int"), max_rows=3)
    conf = EngineConf(context_size=2, max_retries=2)
    wait = lambda seconds: None
    key = lambda r: (r.doc_id, r.batch_no)
    want = sorted(translate.translate_batches(batched, Contexts(), conf, with_context=with_context, sleep=wait).collect(), key=key)
    got = sorted(table_function.translate_table(batched, Contexts(), conf, with_context=with_context, sleep=wait).collect(), key=key)
    assert got == want and sum(r.error is not None for r in got) == 1 and len(got) == 12
    table_function.register(spark, Contexts(), conf, with_context=with_context, name="translated", sleep=wait)
    batched.createOrReplaceTempView("some_batches")
    counted = spark.sql("SELECT doc_id, count(*) AS n, sum(size(items)) AS items FROM translated(TABLE(some_batches) PARTITION BY doc_id ORDER BY batch_no) GROUP BY doc_id ORDER BY doc_id").collect()
    assert [r.n for r in counted] == [3] * 4 and counted[0]["items"] == 9


def test_exports(spark):
    import xml.etree.ElementTree

    from quire.sources import sinks

    rows = spark.createDataFrame([(1, 1, "g-1", 0, 'b & "c"', "<b>B</b> < x\x01"), (1, 0, "g-0", 0, "a", None), (1, 2, "g-2", 1, "é\n漢", "y")], "doc_id long, seg_no int, seg_id string, page_idx int, text string, translated string")
    told = json.loads(sinks.bilingual_json(rows).first().json)
    assert [t["id"] for t in told] == ["g-0", "g-1", "g-2"] and "target" not in told[0] and told[1]["source"] == 'b & "c"' and told[2] == {"id": "g-2", "page": 1, "source": "é\n漢", "target": "y"}
    memory = xml.etree.ElementTree.fromstring(sinks.bilingual_tmx(rows, "en", "de").first().tmx.encode())
    assert [[s.text for s in u.iter("seg")] for u in memory.iter("tu")] == [['b & "c"', "B < x"], ["é\n漢", "y"]] and memory.find("header").get("srclang") == "en"
