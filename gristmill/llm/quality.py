"""Operator 3: quality classifier over random-indexing word vectors."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DIMS = 96
NONZERO = 6
WINDOW = 2
HIDDEN = 24
VOCABULARY = 20_000
FIT_ROWS = 4_000
FIT_BYTES = 24_000_000
#: Words of a text whose neighbours are summed at a time.
PIECE = 4096
THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*")


def stream(text: str | None) -> Iterator[str]:
    """Lower-cased words, numbers, and runs of one mark; then marks for form, which are words like others.

    <caps> stands beside a word of capitals, <again> in place of a word equal to the one before it.
    """
    last = ""
    for m in TOKEN.finditer(text or ""):
        w = m.group()
        low = w.lower()
        yield "<again>" if low == last else low if len(low) <= 24 else f"{low[:8]}<{zlib.crc32(low.encode('utf-8', 'surrogatepass')):x}>"
        if len(w) > 1 and w.isupper():
            yield "<caps>"
        last = low


def tokens(text: str | None) -> list[str]:
    return list(stream(text))


def index_vectors(words: list[str]) -> np.ndarray:
    """The random index of each word: NONZERO entries of +1 or -1, from the word's own checksum."""
    out = np.zeros((len(words), DIMS), np.float32)
    for i, w in enumerate(words):
        g = np.random.default_rng(zlib.crc32(w.encode("utf-8", "surrogatepass")))
        at = g.choice(DIMS, NONZERO, replace=False)
        out[i, at] = g.choice([-1.0, 1.0], NONZERO)
    return out


class Model:
    """Vocabulary, its vectors, the network and its temperature."""

    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray):
        self.vocabulary, self.vectors = vocabulary, vectors
        self.mean = self.scale = np.zeros(0)
        self.w1 = self.b1 = self.w2 = np.zeros(0)
        self.b2 = 0.0
        self.temperature = 1.0

    def pooled(self, text: str | None) -> np.ndarray:
        """The mean vector of all words of a text, and how many there are (log scale)."""
        count = Counter(stream(text))
        n = sum(count.values())
        out = np.zeros(DIMS + 1, np.float64)
        if n:
            get, known = self.vocabulary.get, len(self.vocabulary)
            rows = np.fromiter((get(w, -1) for w in count), np.int64, len(count))
            times = np.fromiter(count.values(), np.float64, len(count))
            rows[rows < 0] = known  # all unknown words share one vector
            out[:DIMS] = times @ self.vectors[rows] / n
        out[DIMS] = np.log1p(n)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def word_vectors(texts: list[str]) -> Model:
    """Random indexing over the fitting texts: a word's vector sums the index vectors of its neighbours and its own.

    Texts are held as numbers of words and summed in pieces: as strings, their words are many times the text.
    """
    number: dict[str, int] = {}
    lists = [np.fromiter((number.setdefault(w, len(number)) for w in stream(t)), np.int32) for t in texts]
    df = np.zeros(len(number), np.int64)
    for ids in lists:
        df[np.unique(ids)] += 1
    names = [w for _, w in sorted((-c, w) for w, c in zip(number, df.tolist(), strict=True) if c > 1)[:VOCABULARY]]
    at = {w: i for i, w in enumerate(names)}
    index = np.vstack([index_vectors(names), np.zeros((1, DIMS), np.float32), index_vectors(["<unknown>"])])
    none, unknown = len(names), len(names) + 1
    row = np.full(len(number), unknown, np.int32)
    row[np.array([number[w] for w in names], np.int64)] = np.arange(len(names))
    del number
    context = np.zeros((len(names) + 2, DIMS), np.float32)
    seen = np.zeros(len(names) + 2)
    for ids in lists:
        rows = np.pad(row[ids], WINDOW, constant_values=none)
        for start in range(WINDOW, WINDOW + len(ids), PIECE):
            stop = min(start + PIECE, WINDOW + len(ids))
            near = sum(index[rows[start + j : stop + j]] for j in range(-WINDOW, WINDOW + 1) if j)
            np.add.at(context, rows[start:stop], near)
        np.add.at(seen, row[ids], 1)
    context /= np.sqrt(np.maximum(seen, 1))[:, None]
    context /= np.maximum(np.linalg.norm(context, axis=1), 1e-9)[:, None]
    vectors = index / np.sqrt(NONZERO)
    context *= 0.5
    vectors += context
    vectors[none] = vectors[unknown]
    return Model(at, vectors[: none + 1].astype(np.float64, copy=False))


def train(texts: list[str], labels: np.ndarray, seed: int = 3, epochs: int = 60) -> Model:
    """Fits vectors, network and temperature; a fifth of the rows is kept for the temperature and the choice of epoch."""
    model = word_vectors(texts)
    x, y = np.array([model.pooled(t) for t in texts]).reshape(len(texts), DIMS + 1), labels.astype(float)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    if len(held) < 20:
        held = fit = order
    model.mean, model.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    model.w1, model.b1 = rng.normal(0, 0.1, (DIMS + 1, HIDDEN)), np.zeros(HIDDEN)
    model.w2, model.b2 = rng.normal(0, 0.1, HIDDEN), np.zeros(())
    z = (x - model.mean) / model.scale
    params = [model.w1, model.b1, model.w2, model.b2]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t, best, kept = 0, np.inf, [p.copy() for p in params]
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            h = np.tanh(z[at] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            d = (p - y[at]) / len(at)
            dh = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[at].T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], d.sum()]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        model.w1, model.b1, model.w2, model.b2 = params
        loss = np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * model.logits(x[held])).mean()
        if loss < best:
            best, kept = loss, [p.copy() for p in params]
    model.w1, model.b1, model.w2, model.b2 = kept
    logits, sign = model.logits(x[held]), np.where(y[held] > 0, 1, -1)
    grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    model.temperature = float(grid[np.argmin([np.logaddexp(0, -sign * logits / g).mean() for g in grid])])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = FIT_ROWS, max_bytes: int = FIT_BYTES) -> Model:
    """Fits on at most ``max_rows`` labelled rows of at most ``max_bytes`` of text in all, those of least hash; a text that does not fit what is left is passed over; held-out ids never enter.

    A row is held out if crc32 of its id as text is 2 modulo 4. Without labelled rows of both
    kinds the model answers with their share (0.5 for none).
    """
    ok = (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2) & F.col(label_col).isin(0, 1)
    lab = labels.where(ok).groupBy(F.col(id_col).alias("id_")).agg(F.max(label_col).cast("int").alias("y")).withColumn("h", F.xxhash64(F.lit(9), "id_"))
    lab = lab.orderBy("h", "id_").limit(max_rows)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = rows.join(F.broadcast(lab), "id_")  # at most max_rows rows of labels
    picked = picked.withColumn("x", F.xxhash64("text")).withColumn("b", F.octet_length("text").cast("long")).withColumn("key", F.xxhash64("id_", "x"))
    left, taken = max_bytes, []
    for r in picked.groupBy("h", "id_", "x", "key").agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("c")).orderBy("h", "id_", "x").toLocalIterator():  # rows of numbers
        if r.b * r.c <= left:
            left -= r.b * r.c
            taken.append(r.key)
    got = picked.where(F.col("key").isin(taken)).orderBy("h", "id_", "x").select("text", "y").toPandas()
    y = got["y"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        model = word_vectors(list(got["text"]))
        model.mean, model.scale = np.zeros(DIMS + 1), np.ones(DIMS + 1)
        model.w1, model.b1, model.w2 = np.zeros((DIMS + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN)
        share = (y.sum() + 1) / (len(y) + 2)
        model.b2 = np.log(share / (1 - share))
        return model
    return train(list(got["text"]), y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, and the columns ``keep``; texts are scored whole.

    Null and empty texts get the score of a text without words. Null ids count as not held out.
    Repeated rows are scored each; an empty table gives no rows; clashing extra columns stay
    out unless they are kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY vectors

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        m = shared.value
        x = np.array([m.pooled(t) for t in texts]).reshape(len(texts), DIMS + 1)
        return pd.Series(m.probabilities(x))

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = docs.select(*(keep or []), *([] if keep and id_col in keep else [F.col(id_col).alias("doc_id")]), held.alias("held_out"), probability(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return score(docs, fit(docs, labels), keep=keep)

