"""Toxicity: a learnt, weighted lexicon matched by Aho-Corasick on folded text, with exception phrases.

Folding lower-cases, strips accents, maps homoglyphs to Latin letters and turns everything else into one blank per
character. Digits and signs in a word that holds a letter are read both as letters and as they stand, and the reading
that matches most counts. Lexicon entries are whole words or word beginnings; both are
anchored at a word's start. The weights that a text collects, in sum and per length, give its probability."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, map_texts, table

#: Labelled rows of each class that the lexicon and its calibration learn from, at most.
SAMPLE = 3000
#: Lengths of word beginnings that may become entries.
BEGINNINGS = range(4, 9)
#: Log-likelihood ratio that an entry needs.
EVIDENCE = 30.0
CUT = 0.5
#: Score of every text if nothing was learnt that could tell toxic texts.
UNKNOWN = 0.02
#: Innocent phrases; a match inside one doesn't count.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "idiot proof")

#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}

_SIGNS = re.compile(r"(?<=[^\W_])[@$](?=[^\W_])|(?<![\w@$])[@$](?=[^\W\d_]{2})")
_DIGITS = re.compile(r"(?<=[a-z])[0134578]+(?=[a-z])|(?<![0-9a-z])[0134578](?=[a-z]{2})|(?<=[a-z]{2})[0134578](?![0-9a-z])")
_HAS_DIGIT = re.compile(r"[0-9]")
_MARK, _LETTER = re.compile(r"[0134578@$]"), re.compile(r"[^\W\d_]")
_DIGIT_LETTERS = str.maketrans({c: x for c, x in SUBSTITUTES.items() if c.isdigit()})
_SIGN_LETTERS = str.maketrans({c: x for c, x in SUBSTITUTES.items() if not c.isdigit()})
_SIGN_BLANKS = dict.fromkeys(_SIGN_LETTERS, " ")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = HOMOGLYPHS.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        self[code] = out = HOMOGLYPHS.get(base, base) if base and all(x.isalnum() for x in base) else "" if unicodedata.category(c) in ("Mn", "Cf") else " "
        return out


_FOLD = _Fold()
_FOLD_BUT_SIGNS = _Fold({c: chr(c) for c in _SIGN_LETTERS})


def fold(text: str) -> str:
    """The likeliest reading of a text, between blanks."""
    text = text.lower()
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: SUBSTITUTES[m.group()], text)
    text = text.translate(_FOLD)
    if _HAS_DIGIT.search(text):
        text = _DIGITS.sub(lambda m: "".join(SUBSTITUTES[c] for c in m.group()), text)
    return f" {text} "


def _word_readings(word: str) -> list[str]:
    """The readings of a word, as long as the word; the first has a letter for every digit and sign.

    Signs in front, inside and at the end are each read as letters or as blanks, and digits as letters in every part
    that holds a letter, or as they stand."""
    if not _LETTER.search(word):
        return [word.translate(_SIGN_BLANKS)]
    lead = len(word) - len(word.lstrip("@$"))
    trail = len(word.rstrip("@$"))
    parts = [dict.fromkeys((x.translate(_SIGN_LETTERS), x.translate(_SIGN_BLANKS))) for x in (word[:lead], word[lead:trail], word[trail:])]
    out: dict[str, None] = {}
    for signs in map("".join, product(*parts)):
        out[" ".join(x.translate(_DIGIT_LETTERS) if _LETTER.search(x) else x for x in signs.split(" "))] = None
        out[signs] = None
    return list(out)


def readings(text: str) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The text between blanks with the first reading of each word, and (start, end, other readings) of the words that have others.

    That of fold() is always among them. Each word is looked at once, so time is in proportion to the text."""
    kept = f" {text.lower().translate(_FOLD_BUT_SIGNS)} "
    mark = _MARK.search(kept)
    if not mark:
        return kept, []
    likely, parts, words, done = fold(text), [], [], 0
    while mark:
        start, end = max(done, kept.rfind(" ", done, mark.start()) + 1), kept.find(" ", mark.start())
        first, *others = _word_readings(kept[start:end])
        others = [x for x in dict.fromkeys([*others, likely[start:end]]) if x != first]
        if others:
            words.append((start, end, others))
        parts += [kept[done:start], first]
        done, mark = end, _MARK.search(kept, end)
    return "".join([*parts, kept[done:]]), words


def _entries(text: str) -> set[str]:
    found = set()
    folded, words = readings(text)
    for word in {*folded.split(), *(x for _, _, others in words for other in others for x in other.split())}:
        found.update(" " + word[:k] for k in BEGINNINGS if len(word) >= k)
        if len(word) > 2:
            found.add(f" {word} ")
    return found


def learn_lexicon(sample: DataFrame, evidence: float = EVIDENCE) -> dict[str, float]:
    """Entry -> weight, from a bounded labelled sample (doc_id, text, y): every entry that has the evidence.

    The sample bounds them; words of any length are entries as they stand."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[y].update(_entries(text))
        words = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"entry": part, "neg": [seen[0][w] for w in part], "pos": [seen[1][w] for w in part]}, pa.schema([("entry", pa.string()), ("neg", pa.int64()), ("pos", pa.int64())]))

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return {}
    share = n1 / (n0 + n1)
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    total = a + b
    ratio = 2 * (F.when(a > 0, a * F.log(a / (total * share))).otherwise(0.0) + F.when(b > 0, b * F.log(b / (total * (1 - share)))).otherwise(0.0))
    weight = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    best = (
        sample.select("text", "y").mapInArrow(count, "entry string, neg long, pos long").groupBy("entry").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        .where(F.col("pos") >= 4).withColumn("g", ratio).withColumn("w", weight).where((F.col("w") > 2.0) & (F.col("g") > evidence))
        .collect()
    )
    return prune({r["entry"]: (float(r["w"]), int(r["pos"])) for r in best})


def prune(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Drops a beginning if one longer entry has nearly all its documents, and then whatever a kept beginning covers."""
    kept = dict(found)
    lengths = [k + 1 for k in BEGINNINGS]  # with the blank in front; a whole word begins no other entry
    begun = lambda entry: [entry[:k] for k in lengths if k < len(entry) and entry[:k] in kept]
    for entry in sorted(found, key=lambda e: (-len(e), e)):
        for p in begun(entry):
            if found[entry][1] >= 0.95 * found[p][1]:
                del kept[p]
    for entry in sorted(kept, key=lambda e: (-len(e), e)):
        if any(kept[p][0] >= kept[entry][0] - 1.5 for p in begun(entry)):
            del kept[entry]
    return {e: w for e, (w, _) in kept.items()}


class Matcher:
    """Aho-Corasick over a lexicon and exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.reach = max([1, *(len(fold(phrase)) for phrase in exceptions)])
        for phrase in exceptions:
            folded = f" {' '.join(fold(phrase).split())} "
            self.automaton.add_word(folded, (len(folded), -1.0))
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        self.empty = not lexicon
        if not self.empty:
            self.automaton.make_automaton()

    def _matches(self, folded: str) -> tuple[dict[int, float], list[tuple[int, int]]]:
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight < 0:
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        return best, excused

    def measures(self, text: str) -> tuple[float, float, float]:
        """log1p of the summed weights, of the sum per 1000 characters, and of the number of matched words.

        A word with several readings counts by the one that collects most; whatever a phrase excuses in one reading is
        excused in all."""
        if self.empty or not text:
            return 0.0, 0.0, 0.0
        folded, words = readings(text)
        best, excused = self._matches(folded)
        for start, end, others in words:
            first = max(0, start - self.reach)
            chosen = {k: best.pop(k) for k in range(start - 1, end - 1) if k in best}
            for other in others:
                found, more = self._matches(folded[first:start] + other + folded[end : end + self.reach])
                excused += [(a + first, b + first) for a, b in more]
                mine = {k + first: w for k, w in found.items() if start - 1 <= k + first < end - 1}
                if sum(mine.values()) > sum(chosen.values()):
                    chosen = mine
            best.update(chosen)
        if excused:
            best = {k: w for k, w in best.items() if not any(a <= k < b for a, b in excused)}
        total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(1000 * total / len(folded))), float(np.log1p(len(best)))


class Model:
    def __init__(self, lexicon: dict[str, float], theta: list[float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.lexicon, self.theta, self.exceptions, self._matcher = lexicon, theta, exceptions, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matcher": None}

    def measures(self, text: str) -> tuple[float, float, float]:
        if self._matcher is None:
            self._matcher = Matcher(self.lexicon, self.exceptions)
        return self._matcher.measures(text)

    def probability(self, measures: tuple[float, float, float]) -> float:
        z = self.theta[0] + sum(a * b for a, b in zip(self.theta[1:], measures, strict=True))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    def __call__(self, text: str) -> float:
        return self.probability(self.measures(text))

    def rejects(self, text: str, cut: float = CUT) -> bool:
        """A text is rejected for what it holds: without a match it stays, whatever the calibration says."""
        found = self.measures(text)
        return found[2] > 0 and self.probability(found) >= cut


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon and calibration from at most `per_class` labelled rows of each class, never from held-out ids.

    Without rows of both classes, or without an entry of enough evidence, there is no lexicon, and every text counts as
    one that matches nothing: its score is UNKNOWN."""
    sample = labelled_sample(docs, labels, "toxic", per_class)
    lexicon = learn_lexicon(sample)
    if not lexicon:
        return Model({}, [float(np.log(UNKNOWN / (1 - UNKNOWN))), 0.0, 0.0, 0.0], exceptions)
    bare = Model(lexicon, [0.0] * 4, exceptions)

    def run(batch: pa.RecordBatch) -> dict:
        matcher = Matcher(bare.lexicon, bare.exceptions)
        got = [matcher.measures(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), **{f"m{i}": [g[i] for g in got] for i in range(3)}}

    got = map_texts(sample, ["doc_id", "text", "y"], "doc_id long, y int, m0 double, m1 double, m2 double", run).toPandas()
    x, y = got[["m0", "m1", "m2"]].to_numpy(float), got["y"].to_numpy(float)
    return Model(lexicon, fit(x, y), exceptions)


def fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps; weights can't be negative, so more matches never lower a score."""
    if len(set(y.tolist())) < 2:
        return [-4.0 if not y.size or not y[0] else 4.0, 0.0, 0.0, 0.0]
    used = [0, 1, 2]
    while True:
        z = np.column_stack([np.ones(len(y)), x[:, used]])
        theta = np.zeros(len(used) + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            h = z.T @ (z * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(theta))
            move = np.linalg.solve(h, z.T @ (p - y) + 0.1 * theta * (np.arange(len(theta)) > 0))
            theta -= move
            if np.abs(move).max() < 1e-8:
                break
        if (theta[1:] >= 0).all() or len(used) == 1:
            full = [float(theta[0]), 0.0, 0.0, 0.0]
            for k, t in zip(used, theta[1:], strict=True):
                full[1 + k] = max(0.0, float(t))
            return full
        used = [k for k, t in zip(used, theta[1:], strict=True) if t >= 0] or [0]


def score(docs: DataFrame, labels: DataFrame, cut: float = CUT, per_class: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts match nothing and get the score of such texts. Without labels of both classes every score is
    UNKNOWN. Repeated rows come out repeated; extra columns are ignored; an empty table gives no rows; a null id counts
    as the id ''. Whole texts are matched, however long; equal sums of two readings go to the first."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": [shared.value(t or "") for t in batch.column("text").to_pylist()]}

    scored = map_texts(docs, ["doc_id", "text"], "doc_id long, score double", run)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, cut: float = CUT, per_class: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns, whatever their names. Like score(), in one pass.

    A row goes if its text holds a match and its score reaches the cut. Null, empty and unmatched texts stay, and
    without a lexicon (see train()) all rows stay. Repeated rows share their fate; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not t or not shared.value.rejects(t, cut) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
