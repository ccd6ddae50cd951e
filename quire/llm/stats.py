"""Statistics of one text, shared by the quality operators. Words are runs of non-blank characters (ASCII blanks)."""

from __future__ import annotations

from collections import Counter

import numpy as np

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Inputs of the tree classifier, in order.
FEATURES = (
    "log_words", "word_len", "symbols", "dup_lines", "repeat_words", "distinct_words", "top_word", "log_line_words", "upper", "digits", "punct", "non_ascii",
    "stop_marks", "capital_words", "single_char_words", "log_lines", "long_words", "blanks",
)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more in the text, the first included.

    Windows are compared exactly: ids are packed where they fit 64 bits, else ranked in two steps first."""
    n = ids.size - window + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    if base**window < 2**63:
        key = np.zeros(n, np.int64)
        for k in range(window):
            key = key * base + ids[k : k + n]
    else:
        pair = np.unique(ids[:-1].astype(np.int64) * base + ids[1:], return_inverse=True)[1]
        p = int(pair.max()) + 1
        four = np.unique(pair[:-2].astype(np.int64) * p + pair[2:], return_inverse=True)[1]
        key = four[:n].astype(np.int64) * base + ids[window - 1 :]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(ids.size + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[list[bytes], np.ndarray, dict]:
    """Words, their ids in order of first use, and the counts that the base rules read."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return words, ids, {
        "n_words": len(words), "word_chars": len(text) - sum(text.count(c) for c in BLANKS), "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(ids), "n_lines": len(lines),
    }


def base_failed(c: dict) -> bool:
    return c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]


def features(text: str) -> list[float]:
    """FEATURES of a text; an empty text has zeros."""
    words, ids, c = base_counts(text)
    n = c["n_words"]
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    chars = max(1, c["word_chars"])
    upper, digits = int(kinds[65:91].sum()), int(kinds[48:58].sum())
    counts = np.bincount(ids)
    firsts = Counter(w[:1] for w in words)
    lens = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(n), c["word_chars"] / n, c["n_symbols"] / chars, c["n_dup_lines"] / max(1, c["n_lines"]), c["n_repeat_words"] / n, counts.size / n,
        float(counts.max()) / n, np.log1p(n / max(1, c["n_lines"])), upper / chars, digits / chars,
        int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / chars, int(kinds[128:].sum()) / raw.size,
        int(kinds[33] + kinds[63]) / n, sum(v for k, v in firsts.items() if b"A" <= k <= b"Z") / n, float((lens == 1).sum()) / n, np.log1p(c["n_lines"]),
        float((lens > 20).sum()) / n, 1 - c["word_chars"] / max(1, len(text)),
    ]
