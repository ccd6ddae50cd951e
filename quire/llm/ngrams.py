"""Hashed word and character n-grams, and logistic regression on them, in numpy."""

from __future__ import annotations

import numpy as np

#: Buckets of words, word pairs and character trigrams.
WORDS, PAIRS, CHARS = 2048, 2048, 4096
SIZE = WORDS + PAIRS + CHARS
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.cumprod(np.full(4096, 1099511628211, np.uint64))


def _bucket(h: np.ndarray, size: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MULT
    return (h >> np.uint64(40)).astype(np.int64) % size


def gram_ids(text: str) -> list[np.ndarray]:
    """Bucket ids of the words, word pairs and character trigrams of a text, repeats included."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = _BLANK[raw]
    none = np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not starts.size:
        return [none, none, none]
    wide = raw.astype(np.uint64) + np.uint64(1)
    begin = np.zeros(raw.size, np.int64)
    begin[starts] = starts
    at = np.arange(raw.size) - np.maximum.accumulate(begin)
    mixed = wide * _POWERS[at & 4095]
    mixed[blank] = 0
    hashes = np.add.reduceat(mixed, starts)
    three = wide[:-2] * np.uint64(65537) + wide[1:-1] * np.uint64(257) + wide[2:] if raw.size > 2 else np.zeros(0, np.uint64)
    pairs = hashes[:-1] * np.uint64(31) + hashes[1:]
    return [_bucket(hashes, WORDS), WORDS + _bucket(pairs, PAIRS), WORDS + PAIRS + _bucket(three, CHARS)]


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: for each kind of gram the square root of its buckets' shares."""
    ids, values = [], []
    for part in gram_ids(text):
        if part.size:
            at, n = np.unique(part, return_counts=True)
            ids.append(at)
            values.append(np.sqrt(n / part.size))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(ids), np.concatenate(values)


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), SIZE), np.float32)
    for i, (ids, values) in enumerate(rows):
        out[i, ids] = values
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 120, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by accelerated gradient steps; classes weigh alike. (weights, bias)."""
    n = len(y)
    share = np.bincount(y, minlength=classes)
    weight = (n / (classes * np.maximum(share, 1)))[y].astype(np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    w = np.zeros((x.shape[1], classes), np.float32)
    b = np.zeros(classes, np.float32)
    pw, pb = w.copy(), b.copy()
    step = np.float32(4.0 / max(1e-6, float(np.einsum("ij,ij->i", x, x).max()) + 1))
    for t in range(rounds):
        m = t / (t + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        z = x @ vw + vb
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * weight[:, None] / n
        pw, pb = w, b
        w, b = vw - step * (x.T @ g + l2 * vw), vb - step * g.sum(axis=0)
    return w, b


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The factor on the logits z at which the classes y are likeliest: a convex problem in one number, by bisection of
    its slope. With fewer rows than say anything it is 1."""
    if len(y) < 10:
        return 1.0

    def slope(t: float) -> float:
        e = np.exp(t * (z - z.max(axis=1, keepdims=True)))
        return float(((e * z).sum(axis=1) / e.sum(axis=1) - z[np.arange(len(y)), y]).mean())

    low, high = 0.05, 50.0
    if slope(high) < 0:
        return high  # the classes are parted without an error
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) < 0 else (low, mid)
    return (low + high) / 2


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, c) so that sigmoid(a * raw + c) is a calibrated probability; Newton steps with smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack((raw, np.ones_like(raw)), axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ theta)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (p - t) + 1e-6 * theta)
        theta -= move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])
