"""Toxicity: a weighted lexicon, matched by Aho-Corasick after folding look-alike characters.

Folding lower-cases, maps look-alike letters and digits used as letters to one letter each (i, l and
1 are one class), and makes anything else a space; the lexicon is folded likewise. Entries are words
and beginnings of words. A text's sum of weights counts each word once, with its longest entry;
matches inside an exception phrase don't count. The score is a logistic function of the sum and of
the sum by length.

Entries and weights are learned: log odds of a word or beginning between toxic and other labelled
documents, from at most MAX_TRAIN labelled rows chosen by a hash of their id; two thirds of them give
the lexicon, the rest the logistic function.

Defined results: null and empty texts have sum 0 and get the score of a text without entries;
repeated rows score alike; without labelled rows of both kinds every score is the share of toxic
rows (0 without any); extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_sample, strings
from panelspark.session import stage

MAX_TRAIN = 20_000
MAX_LEXICON = 4_096
LEAST_ODDS = 2.0
CUT = 0.3
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "sore loser board")

# Characters that are read as a Latin letter.
ALIKE = {
    "a": "4@аα", "b": "8вβ", "c": "сϲ", "d": "ԁ", "e": "3еεҽ", "g": "ɡ", "h": "һ", "i": "1l|іιıӏ",
    "j": "ј", "k": "кκ", "m": "м", "n": "ո", "o": "0оοօ", "p": "рρ", "q": "ԛ", "s": "5$ѕ", "t": "7тτ",
    "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уүγ",
}


class _Fold(dict):
    def __missing__(self, code: int) -> int:
        ch = chr(code)
        wide = ord(ch) - 0xFEE0 if 0xFF21 <= code <= 0xFF5A else code  # full-width letters
        out = self.get(wide, wide) if wide != code else (code if ch.isalpha() else 32)
        self[code] = out
        return out


@cache
def _table() -> _Fold:
    return _Fold({ord(c): ord(letter) for letter, chars in ALIKE.items() for c in chars})


def fold(text: str) -> str:
    if "$$" in text:
        text = text.replace("$$", "  ").replace(" $", "  ")
    return f" {text.lower().translate(_table())} "


def parts(text: str) -> set[str]:
    """Words (with spaces around) and beginnings of words, whole ones included (a space before), of a text."""
    words = set(fold(text).split())
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:k]}" for k in range(3, min(len(w), 9) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coef: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def automaton(self) -> ahocorasick.Automaton:
        auto = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            auto.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            folded = " ".join(fold(phrase).split())
            auto.add_word(f" {folded} ", (len(folded) + 2, None))
        if len(auto):
            auto.make_automaton()
        return auto


def measure(text: str, auto: ahocorasick.Automaton) -> tuple[float, float]:
    """(sum of weights, number of words) of a text."""
    folded = " ".join(fold(text).split())
    if not folded or not len(auto):
        return 0.0, float(len(folded.split()))
    best: dict[int, tuple[int, float]] = {}
    skip = []
    for end, (size, w) in auto.iter(f" {folded} "):
        start = end - size + 1
        if w is None:
            skip.append((start, end))
        elif start not in best or size > best[start][0]:
            best[start] = size, w
    total = sum(w for start, (_, w) in best.items() if not any(a <= start < b for a, b in skip))
    return total, float(folded.count(" ") + 1)


def _inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(np.maximum(total, 0)),
                     np.log1p(100 * np.maximum(total, 0) / np.maximum(words, 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _counts(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(part, n): documents that hold a part; counted in each task before the shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in strings(batch, "text"):
                seen.update(parts(text) if shared.value is None else parts(text) & shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                         names=["part", "n"])
    return rows.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def _entries(pos: dict[str, int], neg: dict[str, int], n1: int, n0: int) -> dict[str, float]:
    odds = {p: np.log((n + 0.5) / (n1 + 1)) - np.log((neg.get(p, 0) + 0.5) / (n0 + 1)) for p, n in pos.items()}
    good = {p for p, v in odds.items() if v >= LEAST_ODDS}
    longer: Counter[str] = Counter()  # of a beginning: the largest support of an entry that extends it
    for p in good:
        for k in range(4, len(p)):
            longer[p[:k]] = max(longer[p[:k]], pos[p])
    kept = [p for p in good if longer[p] < 0.9 * pos[p]]
    kept = sorted(kept, key=lambda p: (-pos[p] * odds[p], p))[:MAX_LEXICON]
    return {p: float(odds[p]) for p in kept}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_train: int = MAX_TRAIN,
        exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Fit on a bounded sample of the label rows; only their documents' texts are gathered."""
    picked = bounded_sample(labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("y")), "id", max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = stage(rows.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(3))), "labelled-sample")
    n = {(r[0], r[1]): r[2] for r in rows.groupBy(F.expr("part > 0"), "y").count().collect()}
    n1, n0 = n.get((True, 1), 0), n.get((True, 0), 0)
    if not n1 or not n0:
        total = sum(n.values())
        share = sum(v for (_, y), v in n.items() if y == 1) / total if total else 0.0
        bias = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Lexicon({}, exceptions, np.array([bias, 0.0, 0.0]))
    least = max(3, round(0.005 * n1))
    learn = rows.where("part > 0")
    pos = {r[0]: r[1] for r in _counts(learn.where("y = 1"), None).where(F.col("n") >= least).collect()}
    neg = {r[0]: r[1] for r in _counts(learn.where("y = 0"), set(pos)).collect()}
    out = Lexicon(_entries(pos, neg, n1, n0), exceptions)
    got = _measured(rows.where("part = 0"), out, "id", "text", ("y",)).select("y", "total", "words").collect()
    y, total, words = (np.array([float(r[k]) for r in got]) for k in range(3))
    if len(y):
        out.coef = _logistic(_inputs(total, words), y)
    return out


def _measured(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    types = dict(docs.dtypes)
    cols = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value.automaton()
        for batch in batches:
            got = [measure(t, auto) for t in strings(batch, text_col)]
            total, words = (np.array([g[k] for g in got], dtype=float) for k in (0, 1))
            score = 1 / (1 + np.exp(-np.clip(_inputs(total, words) @ shared.value.coef, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(total), pa.array(words),
                                              pa.array(score)], names=[*cols, "total", "words", "score"])
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cols), "total double, words double, score double"])
    return docs.select(*cols, text_col).mapInArrow(run, schema)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, total, words, score) of every row."""
    return _measured(docs, lexicon, id_col, text_col)
