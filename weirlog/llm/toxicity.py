"""Toxicity as ordered grades: cumulative-link regression on sparse text features.

A text's features are its words and their beginnings; those kept are the ones that labelled toxic
texts hold far more often than labelled clean ones. The labels say only toxic or not, so toxic
training texts are graded 1 to 3 by the thirds of how many of their words bear a kept feature; clean
ones have grade 0. One weight vector is shared by the three ordered thresholds: the chance of
grade k or more is the logistic of the weighted features less threshold k. The expected severity is
the sum of these chances.

Training rows are bounded by `TOXIC` and `CLEAN` and come from outside the held-out fold; every
document is scored whole.

Defined results: a null or empty text has no features; a document with several labels is toxic if their
mean is above one half; without toxic or without clean training rows the severity is 0 for every
text; repeated rows are scored each; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm.common import id_bucket, lean, ship, slices, text_or_empty
from weirlog.llm.learning import Adam, sample, sigmoid

FOLDS, HELD = 4, 2
TOXIC, CLEAN, GRADES = 6_000, 18_000, 3
#: Features kept: at most so many, in at least so many toxic texts, so many times likelier there (as a logarithm).
FEATURES, SUPPORT, ODDS = 4096, 4, 3.0
PREFIXES = (4, 5, 6)
STEPS, RATE, DECAY, TOXIC_AT = 400, 0.1, 1e-5, 0.7
HOLD = 250_000
_EDGE = b".,;:!?'\"()[]{}*%&$#|-"


def word_features(word: bytes) -> list[int]:
    """Hashes of a word, without marks at its edges, and of its beginnings."""
    w = word.lower().strip(_EDGE)
    if not w:
        return []
    parts = [b"=" + w, *(b"^" + w[:n] for n in PREFIXES if len(w) >= n)]
    return [h - (1 << 64) if (h := xxhash.xxh3_64_intdigest(p)) >> 63 else h for p in parts]


class Kept(dict):
    """Numbers of the kept features of a word."""

    def __init__(self, number: dict[int, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > HOLD:
            self.clear()
        out = self[word] = tuple(self.number[h] for h in word_features(word) if h in self.number)
        return out


def sparse(text: bytes, kept: Kept) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the features in a text, log(1 + times) of each, and how many words bear one."""
    bearing = [f for f in map(kept.__getitem__, text.split()) if f]
    at, n = np.unique(np.array([x for f in bearing for x in f], np.int64), return_counts=True)
    return at, np.log1p(n), len(bearing)


@dataclass
class Model:
    number: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray
    edges: tuple[float, float]

    def chances(self, score: np.ndarray) -> np.ndarray:
        """Of grade k or more, k from 1."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, size: int, balanced: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of greatest likelihood; if balanced, toxic rows weigh as much as clean ones in sum."""
    n, toxic = len(rows), int((grade > 0).sum())
    weight = np.where(grade > 0, 0.5 / max(1, toxic), 0.5 / max(1, n - toxic)) if balanced else np.full(n, 1 / n)
    row = np.repeat(np.arange(n), [len(a) for a, _ in rows])
    col = np.concatenate([a for a, _ in rows]) if n else np.empty(0, np.int64)
    val = np.concatenate([v for _, v in rows]) if n else np.empty(0)
    x = np.zeros(size + GRADES)
    x[size] = 2.0  # the first threshold, then logarithms of the steps between them
    adam = Adam(len(x), RATE)
    for step in range(STEPS):
        theta = np.cumsum(np.concatenate((x[size : size + 1], np.exp(x[size + 1 :]))))
        s = np.bincount(row, val * x[col], n)
        at = np.concatenate((np.full((n, 1), np.inf), s[:, None] - theta, np.full((n, 1), -np.inf)), axis=1)
        up = np.where(np.isposinf(at), 1.0, np.where(np.isneginf(at), 0.0, sigmoid(np.where(np.isfinite(at), at, 0.0))))
        i = np.arange(n)
        high, low = up[i, grade], up[i, grade + 1]
        p = np.maximum(high - low, 1e-9)
        # Slope of -log p in the two cumulative chances of the row's grade.
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        ds = (dl - dh) * weight
        dt = np.zeros(GRADES)
        np.add.at(dt, (grade - 1)[grade > 0], (dh * weight)[grade > 0])
        np.add.at(dt, grade[grade < GRADES], -(dl * weight)[grade < GRADES])
        tail = np.cumsum(dt[::-1])[::-1]
        steps = np.concatenate((tail[:1], tail[1:] * np.exp(x[size + 1 :])))
        gradient = np.concatenate((np.bincount(col, val * ds[row], size) + DECAY * x[:size], steps))
        adam.rate = RATE * (1 - step / STEPS)
        x = adam.step(x, gradient)
    return x[:size], np.cumsum(np.concatenate((x[size : size + 1], np.exp(x[size + 1 :]))))


def _document_frequencies(rows: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many texts of either label; partial sums of each task."""

    def go(batches):
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            found = [np.array([*{h for w in set(t.as_py().split()) for h in word_features(w)}], np.int64) for t in batch.column(0)]
            sides = [np.unique(np.concatenate([f for f, x in zip(found, toxic, strict=True) if x == side] or [np.empty(0, np.int64)]), return_counts=True) for side in (1, 0)]
            for (h, n), column in zip(sides, ("toxic", "clean"), strict=True):
                zero = np.zeros(len(h), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n if column == "toxic" else zero), pa.array(n if column == "clean" else zero)], names=["feature", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(lean(go), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of `labels.toxic`, from rows outside the held-out fold."""
    ship(docs.sparkSession)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).filter("doc_id is not null and toxic is not null")
    told = told.filter(id_bucket(FOLDS) != HELD).groupBy("doc_id").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    # At most TOXIC + CLEAN ids are broadcast, so no text is shuffled.
    chosen = sample(told.filter("toxic = 1"), "doc_id", TOXIC).union(sample(told.filter("toxic = 0"), "doc_id", CLEAN))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    counts = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model({}, np.zeros(0), np.array([40.0, 50.0, 60.0]), (0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (counts[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (counts[0] + 1.0))
    ranked = _document_frequencies(rows).withColumn("odds", odds).filter((F.col("toxic") >= SUPPORT) & (F.col("odds") >= ODDS))
    number = {r["feature"]: i for i, r in enumerate(ranked.orderBy((F.col("odds") * F.col("toxic")).desc(), "feature").limit(FEATURES).collect())}

    def go(batches):
        kept = Kept(number)
        for batch in batches:
            out = [sparse(t.as_py(), kept) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _, _ in out], pa.list_(pa.int64())), pa.array([v for _, v, _ in out], pa.list_(pa.float64())), pa.array([n for _, _, n in out], pa.int64()), batch.column(1)], names=["at", "value", "bearing", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(lean(go), "at array<long>, value array<double>, bearing long, toxic int").toArrow()
    sparse_rows = [(np.array(a, np.int64), np.array(v)) for a, v in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)]
    bearing, toxic = found.column(2).to_numpy(), found.column(3).to_numpy()
    if not toxic.any():
        return Model({}, np.zeros(0), np.array([40.0, 50.0, 60.0]), (0.0, 0.0))
    edges = tuple(float(x) for x in np.quantile(bearing[toxic == 1], (1 / 3, 2 / 3)))
    grade = np.where(toxic == 1, 1 + (bearing > edges[0]) + (bearing > edges[1]), 0).astype(np.int64)
    weights, thresholds = fit(sparse_rows, grade, len(number))
    return Model(number, weights, thresholds, edges)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, severity (0 to 3), grade, p_toxic, toxic (0 or 1) for every document."""
    model = train(docs, labels)

    def go(batches):
        kept = Kept(model.number)
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), 1 << 22):
                s = []
                for t in batch.column(2)[a:b]:
                    at, value, _ = sparse(t.as_py(), kept)
                    s.append(float(value @ model.weights[at]) if len(at) else 0.0)
                up = model.chances(np.array(s))
                each = np.diff(-np.hstack((np.ones((len(s), 1)), up, np.zeros((len(s), 1)))), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(up.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(up[:, 0])], names=["doc_id", "held_out", "severity", "grade", "p_toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(FOLDS) == HELD).alias("held_out"), text_or_empty().cast("binary").alias("text"))
    scored = rows.mapInArrow(lean(go), "doc_id long, held_out boolean, severity double, grade int, p_toxic double")
    return scored.withColumn("toxic", (F.col("p_toxic") >= TOXIC_AT).cast("int"))
