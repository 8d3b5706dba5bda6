"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes run through learned filters over overlapping chunks that cover the whole text. Each filter is max-pooled
within a chunk; the mean and the largest of a text's chunk values are combined by a logistic layer into one
probability. The filters are tables with a weight for each byte at each place of the filter, so a convolution is a
sum of table rows.

Only the number of training rows is bounded: at most `per_class` labelled documents of each class, by hash of their
id. Both training and scores read whole texts, a slice at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, quoted, text_bytes

CHUNK, STEP = 256, 192  # chunks overlap by a quarter
WIDTH, FILTERS = 6, 16
_SLICE = 1 << 14  # bytes convolved at a time, few enough for a processor's cache


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    head: np.ndarray  # of means, then of maxima
    shift: float


def _convolve(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter values at each place of x (along its last axis)."""
    n = x.shape[-1] - WIDTH + 1
    x = x.astype(np.intp)
    out = np.take(rows[0], x[..., :n], axis=0, mode="clip")
    row = np.empty_like(out)
    for j in range(1, WIDTH):
        out += np.take(rows[j], x[..., j : j + n], axis=0, out=row, mode="clip")
    return out


def _padded(text: bytes) -> np.ndarray:
    """Bytes, with blanks up to the end of the last chunk."""
    n = max(len(text), WIDTH)
    chunks = -(-(n - WIDTH + 1) // STEP)
    out = np.full(STEP * (chunks - 1) + CHUNK + WIDTH - 1, 32, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)[: len(out)]
    return out


def _pooled(made: np.ndarray) -> np.ndarray:
    """Largest filter values of each chunk, by way of the parts that chunks share."""
    part = CHUNK - STEP
    parts = made.reshape(-1, part, made.shape[-1]).max(axis=1)
    chunks = (len(parts) * part - CHUNK) // STEP + 1
    return parts[(STEP // part) * np.arange(chunks)[:, None] + np.arange(CHUNK // part)].max(axis=1)


def score_text(model: Model, text: bytes) -> float:
    x = _padded(text)
    step = _SLICE // STEP * STEP  # whole chunks at a time
    places = len(x) - WIDTH + 1
    values = [_pooled(_convolve(model.tables, x[lo : min(lo + step + CHUNK - STEP, places) + WIDTH - 1])) for lo in range(0, places - (CHUNK - STEP), step)]
    pooled = np.maximum(np.concatenate(values) + model.bias, 0)
    return float(1 / (1 + np.exp(-(np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)]) @ model.head + model.shift))))


def _largest(tables: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest value in each chunk of a whole text, and the WIDTH bytes that give it (chunks x WIDTH x FILTERS)."""
    x = _padded(text)
    starts = np.arange(0, len(x) - CHUNK - WIDTH + 2, STEP)
    values, windows = [], []
    for lo in range(0, len(starts), _SLICE // STEP):
        chunks = x[starts[lo : lo + _SLICE // STEP, None] + np.arange(CHUNK + WIDTH - 1)]
        made = _convolve(tables, chunks)
        best = made.argmax(axis=1)  # chunks x filters
        values.append(np.take_along_axis(made, best[:, None], axis=1)[:, 0])
        windows.append(np.take_along_axis(chunks[:, :, None], best[:, None] + np.arange(WIDTH)[None, :, None], axis=1))
    return np.concatenate(values), np.concatenate(windows)


def train(texts: list[bytes], labels: np.ndarray, prior: float, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Model:
    """Fits whole texts to labels by Adam. `prior` is the share of label 1 that scores should assume."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, lanes = 0, np.arange(FILTERS)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            tables = params[0].astype(np.float32)
            seen = [_largest(tables, texts[i]) for i in pick]
            sizes = np.array([len(v) for v, _ in seen])
            y, cuts = labels[pick], np.concatenate(([0], np.cumsum(sizes)[:-1]))
            raw, windows = np.concatenate([v for v, _ in seen]) + params[1], np.concatenate([w for _, w in seen])
            pooled = np.maximum(raw, 0)
            means, tops = np.add.reduceat(pooled, cuts) / sizes[:, None], np.maximum.reduceat(pooled, cuts)
            seen = np.concatenate([means, tops], axis=1)
            p = 1 / (1 + np.exp(-np.clip(seen @ params[2] + params[3], -30, 30)))
            err = (p - y) / len(pick)
            grads = [np.zeros_like(params[0]), None, seen.T @ err + 1e-4 * params[2], np.array([err.sum()])]
            doc = np.repeat(np.arange(len(pick)), sizes)
            top = pooled == tops[doc]
            share = top / np.maximum(np.add.reduceat(top.astype(float), cuts), 1)[doc]
            d = err[doc, None] * (params[2][:FILTERS] / sizes[doc, None] + params[2][FILTERS:] * share) * (raw > 0)
            grads[1] = d.sum(axis=0)
            for j in range(WIDTH):
                np.add.at(grads[0][j], (windows[:, j], np.broadcast_to(lanes, d.shape)), d)
            grads[0] += 1e-5 * params[0]
            step += 1
            now = rate * (1 - epoch / epochs)
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    shift = float(params[3][0] + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return Model(params[0].astype(np.float32), params[1].astype(np.float32), params[2].astype(np.float32), shift)


def _sample(labels: DataFrame, id_col: str, label_col: str, per_class: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """At most `per_class` distinct ids (id, y) of each class, the smallest by hash, and the ids in each class; ids with both labels are left out."""
    known = labels.where(F.col(quoted(label_col)).isin(0, 1)).select(id_key(F.col(quoted(id_col))).alias("id"), F.col(quoted(label_col)).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("id", "y")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(per_class) for y in (0, 1)]
    return first[0].unionByName(first[1]), totals


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2500, seed: int = 3) -> Model:
    """Trains on the whole texts of at most `per_class` labelled ids of each class, the smallest by hash.

    Labels other than 0 and 1 count as none, and so do those of an id that has both. Of several texts under one id
    the smallest by hash is read, so at most 2 * per_class texts come to the driver. Ids that no document has are
    passed over. Without documents of both classes every score is the share of label 1 (one half without labels).
    """
    sample, totals = _sample(labels, id_col, label_col, per_class, seed)
    rows = docs.select(id_key(F.col(quoted(id_col))).alias("id"), text_bytes(F.col(quoted(text_col))).alias("text")).join(F.broadcast(sample), "id")
    one = rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    taken = sorted((r["id"], r["y"], bytes(r["text"])) for r in one.collect())  # at most 2 * per_class rows
    y = np.array([r[1] for r in taken], dtype=float)
    total = sum(totals.values())
    prior = totals.get(1, 0) / total if total else 0.5
    if len(set(y.tolist())) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.log(p / (1 - p))))
    return train([r[2] for r in taken], y, prior, seed=seed)


def with_quality(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """All columns and the probability of label 1 as `name`; a column of that name is replaced. Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([score_text(model, t) for t in texts], dtype=float)

    return docs.withColumn(name, score.asNondeterministic()(text_bytes(F.col(quoted(text_col)))))


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row; repeated rows score alike, an empty table gives an empty table, other columns are ignored."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return with_quality(rows, model, "score").select(F.col("id").alias(id_col), "score")
