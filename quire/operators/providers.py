"""Text transformers behind HTTP services: which service a model belongs to, and how many calls it gets at a time."""

from __future__ import annotations

import json
import os
import threading
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..conf import PROVIDERS, RESPONSE_TOKENS, key_variable


@dataclass(frozen=True)
class Route:
    """Where calls for the models of a prefix go.

    form chat posts to url/chat/completions with the key as a bearer token; form messages posts to url/messages with the
    key in a header of its own and the system prompt beside the messages. strip drops the prefix from the model's name.
    At most `calls` calls run at a time in one worker process, and they start `pace` seconds apart."""

    prefix: str
    provider: str
    url: str
    form: str = "chat"
    strip: bool = True
    keyless: bool = False
    calls: int = 4
    pace: float = 0.0


# The public addresses of the services.
ROUTES = (
    Route("gemini/", "Google Gemini", "https://generativelanguage.googleapis.com/v1beta/openai"),
    Route("openai/", "OpenAI", "https://api.openai.com/v1"),
    Route("gpt-", "OpenAI", "https://api.openai.com/v1", strip=False),
    Route("anthropic/", "Anthropic", "https://api.anthropic.com/v1", "messages"),
    Route("claude-", "Anthropic", "https://api.anthropic.com/v1", "messages", strip=False),
    Route("deepseek/", "DeepSeek", "https://api.deepseek.com"),
    Route("mistral/", "Mistral AI", "https://api.mistral.ai/v1"),
    Route("groq/", "Groq", "https://api.groq.com/openai/v1"),
    Route("together_ai/", "Together AI", "https://api.together.xyz/v1"),
    Route("moonshot/", "Moonshot (Kimi)", "https://api.moonshot.ai/v1"),
    Route("dashscope/", "Alibaba DashScope (Qwen)", "https://dashscope-intl.aliyuncs.com/compatible-mode/v1"),
    Route("zai/", "Zhipu AI (GLM)", "https://api.z.ai/api/paas/v4"),
    Route("xai/", "xAI (Grok)", "https://api.x.ai/v1"),
    Route("openrouter/", "OpenRouter", "https://openrouter.ai/api/v1"),
    Route("ollama/", "Ollama (Local)", "http://localhost:11434/v1", keyless=True),
)
#: Fixed value: the version that services of the messages form ask for.
MESSAGES_VERSION = "2023-06-01"


def route_of(model: str, routes: tuple[Route, ...] = ROUTES) -> Route | None:
    """The route of the longest prefix that the model has."""
    return max((r for r in routes if model.startswith(r.prefix)), key=lambda r: len(r.prefix), default=None)


def routed(models: DataFrame, routes: tuple[Route, ...] = ROUTES) -> DataFrame:
    """models (model) with provider, url, form and name, what the service calls the model; null without a route.

    The routes are a small, fixed dimension; of several prefixes that fit the longest holds."""
    from pyspark.sql import functions as F

    best = F.array(*(F.struct(F.lit(r.prefix).alias("prefix"), *(F.lit(getattr(r, c)).alias(c) for c in ("provider", "url", "form", "strip"))) for r in sorted(routes, key=lambda r: -len(r.prefix))))
    out = models.withColumn("__r", F.get(F.filter(best, lambda r: F.startswith("model", r["prefix"])), F.lit(0)))
    name = F.when(F.col("__r.strip"), F.substr("model", F.length("__r.prefix") + 1)).when(F.col("__r").isNotNull(), F.col("model"))
    return out.withColumn("name", name).select(*models.columns, "__r.provider", "__r.url", "__r.form", "name")


def route_table(spark: SparkSession, routes: tuple[Route, ...] = ROUTES) -> DataFrame:
    return spark.createDataFrame([(r.prefix, r.provider, r.url, r.form, r.strip, r.keyless) for r in routes], "prefix string, provider string, url string, form string, strip boolean, keyless boolean")


def key_of(model: str, keys: dict, routes: tuple[Route, ...] = ROUTES) -> str | None:
    """The key for a model: that of its provider, that for every model (keys['']), or its environment variable's.

    An empty text where the service needs none; None where it needs one and there is none."""
    route = route_of(model, routes)
    of_provider = next((p[2] for p in PROVIDERS if route and p[0] == route.provider), None)
    variables = [v for v in (of_provider, key_variable(model)) if v]
    found = (route and keys.get(route.provider)) or keys.get("") or next((os.environ[v] for v in variables if os.environ.get(v)), "")
    return found if found or (route and route.keyless) else None


class Pace:
    """Bounds calls: `calls` at a time, each starting `pace` seconds after the one before. One for all threads of a process."""

    known: dict[tuple, Pace] = {}
    guard = threading.Lock()

    def __init__(self, calls: int, pace: float):
        self.slots, self.pace, self.lock, self.next = threading.BoundedSemaphore(max(1, calls)), pace, threading.Lock(), 0.0

    @classmethod
    def of(cls, route: Route) -> Pace:
        with cls.guard:
            key = (route.provider, route.url, route.calls, route.pace)
            return cls.known.setdefault(key, cls(route.calls, route.pace))

    def __enter__(self) -> None:
        self.slots.acquire()
        if self.pace:
            with self.lock:
                begin = max(self.next, time.monotonic())
                self.next = begin + self.pace
            time.sleep(max(0.0, begin - time.monotonic()))

    def __exit__(self, *error) -> None:
        self.slots.release()


def post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    """The JSON answer of a service; an error says the status and what the service says of it."""
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.read(500).decode(errors='replace')}") from e


class Providers:
    """A transformer that sends each model to its own provider's service; fall-back models included.

    keys has a key for each provider, or one for all under ''; what it lacks comes from the provider's environment
    variable on the machine that sends. Raises where there is no route, no key, or no complete answer. The pickled object
    holds the keys that it was given."""

    def __init__(self, keys: dict | None = None, temperature: float = 1.0, max_tokens: int = RESPONSE_TOKENS, timeout: float = 120.0, routes: tuple[Route, ...] = ROUTES):
        self.keys, self.temperature, self.max_tokens, self.timeout, self.routes = keys or {}, temperature, max_tokens, timeout, routes

    def __call__(self, system: str, message: str, model: str) -> str:
        route = route_of(model, self.routes)
        if route is None:
            raise LookupError(f"no service is known for model {model}")
        key = key_of(model, self.keys, self.routes)
        if key is None:
            raise LookupError(f"no key for {route.provider}")
        name = model[len(route.prefix) :] if route.strip else model
        with Pace.of(route):
            return self._messages(route, key, name, system, message) if route.form == "messages" else self._chat(route, key, name, system, message)

    def _chat(self, route: Route, key: str, name: str, system: str, message: str) -> str:
        body = {"model": name, "messages": [{"role": "system", "content": system}, {"role": "user", "content": message}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        got = post(f"{route.url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {key}"} if key else {}, self.timeout)
        return got["choices"][0]["message"]["content"]

    def _messages(self, route: Route, key: str, name: str, system: str, message: str) -> str:
        body = {"model": name, "system": system, "messages": [{"role": "user", "content": message}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        got = post(f"{route.url.rstrip('/')}/messages", body, {"x-api-key": key, "anthropic-version": MESSAGES_VERSION}, self.timeout)
        return "".join(part.get("text", "") for part in got["content"])


class ChatCompletions:
    """A transformer behind one service of the usual chat form, whatever the model: POST base_url/chat/completions.

    The key is given, or comes from the environment variable that key_variable() names for the model, on the machine
    that sends. Raises on any answer but a completed one."""

    def __init__(self, base_url: str, temperature: float = 1.0, max_tokens: int = RESPONSE_TOKENS, key: str = "", timeout: float = 120.0, calls: int = 4, pace: float = 0.0):
        self.route, self.key = Route("", "", base_url, strip=False, keyless=True, calls=calls, pace=pace), key
        self.providers = Providers({}, temperature, max_tokens, timeout, (self.route,))

    def __call__(self, system: str, message: str, model: str) -> str:
        key = self.key or os.environ.get(key_variable(model) or "", "")
        with Pace.of(self.route):
            return self.providers._chat(self.route, key, model, system, message)
