"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Features are the square roots of the shares of character-class trigrams of the
whole text (12 classes, so 1728 trigrams), the share of distinct words and that of
distinct word pairs. Trusted positives are rows labelled 1 among those that may be
learned from; the unlabelled web text is a sample of all of these rows, labelled or
not. The class prior of the unlabelled text is estimated from the tails of the score
distributions of a plain positive-against-unlabelled model: where only positives
score, the share of unlabelled rows above a threshold over that of positives comes
down to the prior. A linear model then minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss. Both samples have about ``bound`` ids at most, chosen by a
hash; everything is scored.

Defined results: a null or empty text scores like a text without characters; texts are
scored whole; a null doc_id is a row like any other, but isn't learned from; an id that
is repeated is learned from once, by its least text; repeated rows get a row and the
same score each, so ties stay ties; with no positives to learn from every score is 0.5;
an empty table gives an empty result; a carried column that has the name of a result is
renamed (see ``carried``), other extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import WORD_ARRAY, SpanHash, bounded_sample, carried, map_text, one_text, slices, text_bytes
from corpusloom.session import materialize

#: Most rows of either sample.
BOUND = 3000
CLASSES = 12
GRAMS = CLASSES**3
WIDTH = GRAMS + 3


def class_table() -> np.ndarray:
    """Byte classes: blank, line feed, lower, upper, digit, stop, comma, cry, mark, symbol, non-ASCII, control."""
    out = np.full(256, 11, np.int16)
    for k, chars in enumerate((" \t", "\n\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", "'\"()-:;/", "#$%&*@^~|<>{}[]=+_\\`")):
        out[np.frombuffer(chars.encode(), np.uint8)] = k
    out[128:] = 10
    return out


CLASS_OF = class_table()


def features(data: np.ndarray, off: np.ndarray, hasher: SpanHash) -> np.ndarray:
    """Rows x WIDTH."""
    n = len(off) - 1
    out = np.zeros((n, WIDTH), np.float32)
    out[:, -1] = 1.0
    if not len(data):
        return out
    kind = CLASS_OF[data]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    if len(data) > 2:
        gram = kind[:-2] * (CLASSES * CLASSES) + kind[1:-1] * CLASSES + kind[2:]
        same = row[:-2] == row[2:]
        at = row[:-2] * GRAMS + gram
        counts = np.bincount(at if same.all() else at[same], minlength=n * GRAMS).reshape(n, GRAMS)
        out[:, :GRAMS] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    word = WORD_ARRAY[data] != 32
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[off[off < len(data)]] = True
    cut = np.flatnonzero(edge)
    keep = word[cut[:-1]]
    starts, ends = cut[:-1][keep], cut[1:][keep]
    if len(starts):
        h = hasher.spans(hasher.sums(data), starts, ends)
        r = row[starts]
        out[:, GRAMS] = _distinct(r, h, n)
        if len(h) > 1:
            pair = r[1:] == r[:-1]
            out[:, GRAMS + 1] = _distinct(r[1:][pair], (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[pair], n)
    return out


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The share of distinct values in each row."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row, weights=new, minlength=n) / np.maximum(1, np.bincount(row, minlength=n))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _adam(grad, w: np.ndarray, steps: int, rate: float) -> np.ndarray:  # noqa: ANN001
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def prior_of(xp: np.ndarray, xu: np.ndarray, steps: int = 120) -> float:
    """The share of positives among the unlabelled, from score tails on rows that the scorer hasn't seen."""
    a, b = xp[::2], xu[::2]

    def grad(w: np.ndarray) -> np.ndarray:
        return -(a.T @ (1 - sigmoid(a @ w))) / len(a) + (b.T @ sigmoid(b @ w)) / len(b) + 1e-3 * w

    w = _adam(grad, np.zeros(xp.shape[1], np.float32), steps, 0.05)
    sp, su = np.sort(xp[1::2] @ w), np.sort(xu[1::2] @ w)
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0.0, 0.7, 29))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    return float(np.clip((above_u / np.maximum(above_p, 1e-6)).min(), 0.05, 0.97))


@dataclass
class PuModel:
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights)


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> PuModel:
    if not len(xp) or not len(xu):
        return PuModel(np.zeros(xp.shape[1], np.float32), 0.5)
    prior = prior_of(xp, xu)

    def grad(w: np.ndarray) -> np.ndarray:
        p, u = sigmoid(xp @ w), sigmoid(xu @ w)
        as_negative = np.mean(-np.log1p(-np.clip(u, 0, 1 - 1e-7))) - prior * np.mean(-np.log1p(-np.clip(p, 0, 1 - 1e-7)))
        g_neg = (xu.T @ u) / len(xu) - prior * (xp.T @ p) / len(xp)
        if as_negative < 0:
            return -g_neg + decay * w
        return -prior * (xp.T @ (1 - p)) / len(xp) + g_neg + decay * w

    return PuModel(_adam(grad, np.zeros(xp.shape[1], np.float32), steps, rate), prior)


def feature_rows(df: DataFrame) -> np.ndarray:
    """Features of a bounded sample (column t), gathered on the driver; rows in order of their bytes."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher = SpanHash()
        data, off = text_bytes(batch.column(0))
        x = [features(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher).astype(np.float16) for i, j in slices(np.diff(off), 1 << 20)]
        return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for m in x for r in m], pa.binary())], names=["x"])

    rows = sorted(bytes(r.x) for r in map_text(df.select("t"), fn, "x binary").collect())
    return np.stack([np.frombuffer(x, np.float16) for x in rows]).astype(np.float32) if rows else np.zeros((0, WIDTH), np.float32)


def train(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = BOUND) -> PuModel:
    """``learn``: which rows (by id) may be learned from."""
    good = bounded_sample(labels.filter(learn & (F.col(label_col) == 1)).select(id_col, label_col), label_col, bound)
    web = bounded_sample(df.filter(learn).select(id_col, F.lit(0).alias("k")), "k", bound)
    xp, xu = (feature_rows(one_text(df, materialize(ids, "ids"), id_col, text_col)) for ids in (good, web))
    return fit_nnpu(xp, xu)


def score_quality(df: DataFrame, model: PuModel, text_col: str = "text", carry: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """``carry`` (default: doc_id) with score and predicted."""
    carry = ["doc_id"] if carry is None else carry
    src = df.select(F.struct(*[F.col(c) for c in carry]).alias("__row"), F.col(text_col).alias("__text"))
    schema = T.StructType([src.schema["__row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    known = df.sparkSession.sparkContext.broadcast(model)  # WIDTH weights

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher = SpanHash()
        data, off = text_bytes(batch.column(1))
        s = [known.value.score(features(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher)) for i, j in slices(np.diff(off), 1 << 20)]
        s = np.concatenate(s).astype(np.float64) if s else np.zeros(0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["__row", "score", "predicted"])

    return map_text(src, fn, schema).select(*carried("__row", carry, ("score", "predicted")), "score", "predicted")
