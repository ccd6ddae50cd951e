"""Engine settings and the catalogue dimensions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Limits, thresholds and the catalogue below decide results and are stated as they are.
DEFAULT_MODEL = "gemini/gemini-3.1-flash-lite"
DEFAULT_TOKEN_LIMIT = 1000
MAX_SEGMENTS = 60
CONTEXT_SIZE = 5
MAX_RETRIES = 4
RETRY_DELAYS = (2.0, 3.0, 6.0)
THRESHOLD_PX = 12.0
WORD_SPACE_PX = 2.5
RESPONSE_TOKENS = 16384

MODEL_TOKEN_LIMITS = {
    "gemini/gemini-3.5-flash": 1500,
    "gemini/gemini-3.1-flash-lite": 1000,
    "gemini/gemini-2.5-flash-lite": 1000,
    "gemini/gemini-3-flash-preview": 1000,
    "gemini/gemini-2.5-flash": 1500,
    "gemini/gemini-2.0-flash": 1500,
    "gemini/gemini-2.0-flash-lite": 1000,
    "gpt-4o-mini": 1500,
    "gpt-5-mini": 1500,
    "gpt-5-nano": 1000,
    "ollama/mistral": 800,
    "ollama/llama3": 800,
    "gemini/gemini-3.1-pro": 2500,
    "gemini/gemini-2.5-pro": 2500,
    "gemini/gemini-1.5-pro": 2500,
    "gpt-4o": 2500,
    "gpt-5": 2500,
    "gpt-5.5": 2500,
    "claude-3-5-sonnet-20241022": 2500,
    "claude-4-sonnet": 2500,
    "claude-4.6-sonnet": 2500,
    "claude-sonnet-4-20250514": 2500,
}

#: Provider, prefix, key variable and suggested models, in order.
PROVIDERS = (
    ("Google Gemini", "gemini/", "GEMINI_API_KEY", ["gemini-3.5-flash", "gemini-3.1-flash-lite", "gemini-2.5-flash-lite", "gemini-3-flash-preview", "gemini-3.1-pro", "gemini-2.5-flash", "gemini-2.5-pro", "gemini-2.0-flash", "gemini-2.0-flash-lite", "gemini-1.5-pro", "gemini-1.5-flash", "gemini-exp-1206"]),
    ("OpenAI", "openai/", "OPENAI_API_KEY", ["gpt-5", "gpt-5-mini", "gpt-5-nano", "gpt-5.5", "gpt-5.4", "gpt-4.1", "gpt-4.1-mini", "gpt-4.1-nano", "gpt-4o", "gpt-4o-mini", "chatgpt-4o-latest", "o1", "o1-mini", "o1-preview", "o3", "o3-mini", "o4-mini"]),
    ("Anthropic", "anthropic/", "ANTHROPIC_API_KEY", ["claude-4.8-opus", "claude-4.6-sonnet", "claude-4.5-haiku", "claude-4-opus", "claude-4-sonnet", "claude-3-7-sonnet", "claude-3-5-sonnet-20241022", "claude-3-5-haiku-20241022", "claude-3-opus-20240229", "claude-3-sonnet-20240229", "claude-3-haiku-20240307"]),
    ("DeepSeek", "deepseek/", "DEEPSEEK_API_KEY", ["deepseek-v4-flash", "deepseek-v4-pro", "deepseek-chat", "deepseek-reasoner", "deepseek-v3", "deepseek-r1"]),
    ("Mistral AI", "mistral/", "MISTRAL_API_KEY", ["mistral-medium-3.5", "mistral-small-latest", "mistral-large-latest", "mistral-medium-latest", "mistral-small-latest", "pixtral-large-latest", "pixtral-12b", "ministral-8b-latest", "ministral-3b-latest", "open-mistral-nemo", "open-mixtral-8x22b", "open-mixtral-8x7b"]),
    ("Groq", "groq/", "GROQ_API_KEY", ["llama-4-scout-groq", "llama-3.3-70b-versatile", "llama3-70b-8192", "llama-3.3-70b-versatile", "llama-3.1-70b-versatile", "llama-3.1-8b-instant", "mixtral-8x7b-32768", "gemma2-9b-it", "qwen-qwq-32b", "deepseek-r1-distill-llama-70b"]),
    ("Together AI", "together_ai/", "TOGETHERAI_API_KEY", ["meta-llama/Llama-4-Maverick", "meta-llama/Llama-4-Scout", "meta-llama/Meta-Llama-3.1-405B-Instruct", "meta-llama/Meta-Llama-3.3-70B-Instruct", "meta-llama/Llama-3.3-70B-Instruct-Turbo", "meta-llama/Llama-3.1-405B-Instruct-Turbo", "meta-llama/Llama-3.1-70B-Instruct-Turbo", "meta-llama/Llama-3.1-8B-Instruct-Turbo", "Qwen/Qwen3-235B-A22B", "Qwen/Qwen3-32B", "Qwen/Qwen2.5-72B-Instruct", "deepseek-ai/DeepSeek-V4-Pro", "deepseek-ai/DeepSeek-R1", "deepseek-ai/DeepSeek-V3", "mistralai/Mixtral-8x7B-Instruct-v0.1", "mistralai/Mixtral-8x22B-Instruct-v0.1", "moonshotai/Kimi-K2", "zai-org/GLM-4.7"]),
    ("Moonshot (Kimi)", "moonshot/", "MOONSHOT_API_KEY", ["kimi-k2.6", "kimi-k2.5", "kimi-k2", "kimi-k2-instruct", "moonshot-v1-8k", "moonshot-v1-32k", "moonshot-v1-128k"]),
    ("Alibaba DashScope (Qwen)", "dashscope/", "DASHSCOPE_API_KEY", ["qwen3.7-max-preview", "qwen3.5-plus", "qwen-max", "qwen-plus", "qwen-turbo", "qwen-long", "qwen2.5-72b-instruct", "qwen2.5-32b-instruct", "qwen2.5-14b-instruct", "qwen2.5-7b-instruct", "qwen3-235b-a22b", "qwen3-32b", "qwq-32b"]),
    ("Zhipu AI (GLM)", "zai/", "ZAI_API_KEY", ["glm-5.1", "glm-5", "glm-4.7", "glm-4.6", "glm-4.5", "glm-4-air", "glm-4-airx", "glm-4-plus", "glm-4-long"]),
    ("xAI (Grok)", "xai/", "XAI_API_KEY", ["grok-4", "grok-3", "grok-3-mini", "grok-2-1212", "grok-beta"]),
    ("OpenRouter", "openrouter/", "OPENROUTER_API_KEY", ["openrouter/free", "google/gemini-2.5-flash:free", "meta-llama/llama-3-8b-instruct:free", "nex-agi/nex-n2-pro:free", "nvidia/nemotron-3.5-content-safety:free", "nvidia/nemotron-3-ultra-550b-a55b:free", "poolside/laguna-m1:free", "nvidia/nemotron-3-super:free", "openai/gpt-oss-120b:free", "google/gemma-4-31b:free", "nvidia/nemotron-3-nano-30b-a3b:free", "nvidia/nemotron-3-nano-omni:free", "nvidia/nemotron-nano-12b-vl:free", "inclusionai/ring-2.6-1t:free", "baidu/cobuddy:free", "openai/gpt-5", "openai/gpt-5-mini", "openai/gpt-4.1", "openai/gpt-4o", "nvidia/nemotron-3-ultra-550b-a55b", "minimax/minimax-m3", "stepfun/step-3.7-flash", "inclusionai/ring-2.6-1t", "ibm-granite/granite-4.1-8b", "poolside/laguna-xs.2:free", "anthropic/claude-opus-4.8-fast", "anthropic/claude-opus-4.7-fast", "anthropic/claude-4-opus", "anthropic/claude-4-sonnet", "anthropic/claude-4.6-sonnet", "anthropic/claude-4.8-opus", "anthropic/claude-4.5-haiku", "anthropic/claude-3.7-sonnet", "google/gemini-2.5-pro", "google/gemini-2.5-flash", "google/gemini-3.5-flash", "google/gemini-3.1-flash-lite", "openai/gpt-chat-latest", "~openai/gpt-mini-latest", "deepseek/deepseek-r1", "deepseek/deepseek-chat", "deepseek/deepseek-v3", "deepseek/deepseek-v4-flash", "deepseek/deepseek-v4-pro", "x-ai/grok-4.3", "x-ai/grok-4", "x-ai/grok-3", "qwen/qwen3.5-plus-20260420", "qwen/qwen3.6-35b-a3b", "qwen/qwen3.7-max", "qwen/qwen3-235b-a22b", "qwen/qwen2.5-72b-instruct", "qwen/qwen-3.5-397b-instruct", "meta-llama/llama-3.3-70b-instruct", "meta-llama/llama-3.1-405b-instruct", "mistralai/mistral-large", "mistralai/mistral-medium-3.5", "moonshotai/kimi-k2", "z-ai/glm-4.7"]),
)

LANGUAGES = {
    "fr": "French",
    "en": "English",
    "es": "Spanish",
    "de": "German",
    "zh": "Chinese (Simplified)",
    "ar": "Arabic",
    "pt": "Portuguese",
    "it": "Italian",
    "ja": "Japanese",
    "ru": "Russian",
}


@dataclass(frozen=True)
class EngineConf:
    """Tunables of one run; they become literals of the plan."""

    model: str = DEFAULT_MODEL
    target_language: str = LANGUAGES["fr"]
    temperature: float = 1.0
    context_size: int = CONTEXT_SIZE
    max_segments: int = MAX_SEGMENTS
    threshold_px: float = THRESHOLD_PX
    word_space_px: float = WORD_SPACE_PX
    max_retries: int = MAX_RETRIES
    token_limit: int = 0  # 0: the model's limit
    glossary: str = ""
    base_url: str = ""
    calls: int = 4  # at a time, in one task and to one provider
    pace: float = 0.0  # seconds between the starts of two calls to one provider
    commit_every: int = 4  # replies in one file of the ledger
    tasks: int = 0  # tasks that ask, 0: as many as there are cores
    keys: dict = field(default_factory=dict)


def engine_conf(settings: Settings, **given) -> EngineConf:
    """The tunables that a settings file holds; what it lacks or can't be read is the default, and `given` wins."""
    n = lambda name, default, kind=float: settings.number("TranslationConfig", name, default, kind)
    d = EngineConf()
    keys = settings.get("APIConfig", "api_keys_by_provider", {})
    found = {
        "temperature": n("temperature", d.temperature), "context_size": n("sliding_context_size", d.context_size, int), "max_segments": n("max_segments_per_batch", d.max_segments, int), "threshold_px": n("threshold_px", d.threshold_px),
        "max_retries": n("max_retries", d.max_retries, int), "glossary": str(settings.get("TranslationConfig", "custom_glossary", d.glossary)).strip(), "target_language": str(settings.get("SystemConfig", "target_lang", d.target_language)).strip(),
        "base_url": str(settings.get("APIConfig", "custom_base_url", "")).strip() if settings.get("APIConfig", "use_custom_base", False) else "", "keys": keys if isinstance(keys, dict) else {},
    }
    return EngineConf(**found | given)


def token_limits(spark: SparkSession) -> DataFrame:
    """(model, token_limit): a fixed, small dimension."""
    return spark.createDataFrame(list(MODEL_TOKEN_LIMITS.items()), "model string, token_limit int")


def providers(spark: SparkSession) -> DataFrame:
    """(ord, provider, prefix, key_env, models): a fixed, small dimension."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(PROVIDERS)], "ord int, provider string, prefix string, key_env string, models array<string>")


def languages(spark: SparkSession) -> DataFrame:
    """(code, name): a fixed, small dimension."""
    return spark.createDataFrame(list(LANGUAGES.items()), "code string, name string")


class Settings:
    """Two-level settings in one JSON file: get(section, key, default) and set(), which writes through."""

    def __init__(self, path: str):
        self.path = path
        self.values = load_settings(path)

    def get(self, section: str, key: str, default=None):
        part = self.values.get(section)
        return part.get(key, default) if isinstance(part, dict) else default

    def set(self, section: str, key: str, value) -> None:
        self.values.setdefault(section, {})[key] = value
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(self.values, f, indent=4, ensure_ascii=False)

    def reset(self, section: str | None = None, key: str | None = None) -> None:
        """Back to the defaults, which are what a missing setting means: one setting, a section, or all."""
        if section is None:
            self.values = {}
        elif key is None:
            self.values.pop(section, None)
        elif isinstance(self.values.get(section), dict):
            self.values[section].pop(key, None)
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(self.values, f, indent=4, ensure_ascii=False)

    def number(self, section: str, key: str, default, kind=float):
        """A setting as a number; what can't be read as one counts as the default."""
        try:
            return kind(self.get(section, key, default))
        except (TypeError, ValueError):
            return default


def load_settings(path: str) -> dict:
    """The settings file; missing, corrupt and non-object files count as empty."""
    try:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    except (OSError, ValueError):
        return {}
    return values if isinstance(values, dict) else {}


def key_variable(model: str) -> str | None:
    """The environment variable that holds the key for a model, by its name."""
    name = model.lower()
    for parts, variable in ((("gemini",), "GEMINI_API_KEY"), (("gpt", "openai"), "OPENAI_API_KEY"), (("claude", "anthropic"), "ANTHROPIC_API_KEY")):
        if any(p in name for p in parts):
            return variable
    return None
