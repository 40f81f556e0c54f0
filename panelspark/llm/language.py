"""Language identification with a string kernel.

The kernel of two texts is the number of distinct character n-grams (n = 1..3, blended) that both
hold, divided by the geometric mean of their own numbers. Landmark texts give a Nyström map; kernel
ridge regression, one language against the rest, is fitted on it. A text is scored by one matrix
product of its n-gram presence row with the landmarks' rows.

n-grams are of lower-cased letters, runs of anything else are one boundary, and they are placed
in `DIM` slots by a hash. Whole texts are read, in batches.

Defined results: null text, empty text and text without a letter give `und` with score 0; ties
between languages go to the first by name; rows that repeat are predicted alike; with no labelled
row every text is `und`; extra columns are ignored.

The outputs of the k one-versus-rest fits sum to 2 - k, so the winner's score is never below 1 / k;
a bound that rejects must come from the fit, and the caller chooses it. `Model.bound` is the quantile
REJECTED of the winning scores of the n labelled rows of the fit, interpolated between rows, less the share
1 / sqrt(n), for few rows tell little of so rare a score: one row rejects nothing, 2,000 lower the quantile
by 2 %. `Model.lowest` is the strict order statistic, which fewer rows than 1 / REJECTED - 1 do not have: then it is 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_sample, map_rows, strings

DIM = 1 << 14
MAX_TRAIN = 2_000
LANDMARKS = 128
RIDGE = 1e-3
REJECTED = 0.005
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # DIM x m, presence / sqrt(own number)
    weights: np.ndarray    # m x languages
    bias: np.ndarray
    lowest: float = 0.0    # the order statistic of the winning scores in the fit
    bound: float = 0.0     # a text with a lower score is in none of the languages


@cache
def _letters() -> np.ndarray:
    """For each code point: itself for a letter, 0 otherwise."""
    flags = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(flags, np.arange(0x110000), 0).astype(np.uint32)


def presence(texts: list[str]) -> np.ndarray:
    """One row per text: 1 in each slot that one of its n-grams falls in."""
    out = np.zeros((len(texts), DIM), dtype=np.uint8)
    lowered = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(b) // 4 + 1 for b in lowered), dtype=np.int64, count=len(texts))
    chars = np.frombuffer(b"\0\0\0\0".join(lowered) + b"\0\0\0\0", dtype=np.uint32)
    code = _letters()[chars]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    keep = code != 0
    keep[1:] |= code[:-1] != 0  # the first of a run of boundaries
    code, row = code[keep].astype(np.uint64), row[keep]
    flat = out.reshape(-1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    gram = np.zeros(len(code), dtype=np.uint64)
    for n in range(3):
        gram = gram[: len(code) - n] * np.uint64(0x100000001B3) + code[n:]
        if not len(gram):
            break
        inside = (row[: len(gram)] == row[n:]) & (gram != 0)
        slot = ((gram + np.uint64(n)) * mix >> np.uint64(50)).astype(np.int64)
        flat[(row[: len(gram)] * DIM + slot)[inside]] = 1
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    own = rows.sum(axis=1, dtype=np.int64)
    return rows.astype(np.float32) / np.sqrt(np.maximum(own, 1)).astype(np.float32)[:, None]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on a sample of at most `max_train` labelled rows, chosen by a hash of their id.

    The landmarks are the first texts of each language in that order, the same number for each.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    got = bounded_sample(rows.select(id_col, text_col, lang_col), id_col, max_train).collect()
    got = [r for r in got if any(ch.isalpha() for ch in r[1])]
    if not got:
        return None
    langs = sorted({r[2] for r in got})
    y = np.array([langs.index(r[2]) for r in got])
    per = max(1, landmarks // len(langs))
    marks = np.concatenate([np.flatnonzero(y == k)[:per] for k in range(len(langs))])
    base = _unit(presence([got[i][1] for i in marks]))
    kernel = np.concatenate([_unit(presence([r[1] for r in got[k:k + 256]])) @ base.T
                             for k in range(0, len(got), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    phi = kernel @ root
    centre = phi.mean(axis=0)
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    level = target.mean(axis=0)
    centred = phi - centre
    gram = centred.T @ centred + RIDGE * len(got) * np.eye(phi.shape[1])
    w = np.linalg.solve(gram, centred.T @ (target - level))
    bias = level - centre @ w
    scores = ((phi @ w + bias).max(axis=1) + 1) / 2
    return Model(langs, np.ascontiguousarray(base.T), (root @ w).astype(np.float32), bias, _lowest(scores), smooth_bound(scores))


def _lowest(scores: np.ndarray) -> float:
    """The order statistic that at most the share REJECTED falls short of; 0 for too few rows to have one."""
    rank = int(REJECTED * (len(scores) + 1))
    return float(np.sort(np.clip(scores, 0, 1))[rank - 1]) - 1e-5 if rank else 0.0


def smooth_bound(scores: np.ndarray) -> float:
    """A bound of the winning score for any number of labelled rows; rounding never rejects a row on it."""
    bound = np.quantile(np.clip(scores, 0, 1), REJECTED) * (1 - 1 / np.sqrt(len(scores)))
    return max(0.0, float(bound) - 1e-5)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns `keep` of every row, its predicted language and a score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), f"{names[0]} string", f"{names[1]} double"])

    def run(batch: pa.RecordBatch) -> pa.Table:
        m, texts = shared.value, strings(batch, text_col)
        bits = presence(texts)
        bits_in = bits.any(axis=1)
        if m is None:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        else:
            out = _unit(bits) @ m.landmarks @ m.weights + m.bias
            best = out.argmax(axis=1)
            top = np.clip((out[np.arange(len(texts)), best] + 1) / 2, 0, 1)
            lang = [m.langs[k] if ok else UNKNOWN for k, ok in zip(best, bits_in)]
            score = np.where(bits_in, top, 0.0)
        cols = [batch.column(k) for k in keep]
        return pa.table([*cols, pa.array(lang, pa.string()), pa.array(np.asarray(score, dtype=float))],
                        names=[*keep, *names])

    return map_rows(docs.select(*dict.fromkeys([*keep, text_col])), run, schema, rows=64, text_col=text_col)
