"""Positive-unlabelled learning of text quality by non-negative risk.

Trusted positives are rows labelled 1 outside the held-out fold; the unlabelled rows are all documents
outside it. Rows labelled 0 are never used. The class prior is the least ratio of the unlabelled to the
positive share above a score (where only positives are, the ratio is the prior). Scores that learnt from
the rows make it too small, scores that learnt from half of few rows too large, and the mean of both is
taken; the unlabelled shares are counted over all unlabelled documents in one pass that returns a few
counts from each task. A linear model on text statistics then minimises the non-negative unbiased risk:
where the estimate of the negative part falls below zero, the step ascends it instead.

Inputs of a score are counted from the text alone: shares of pairs of character kinds, and shapes of
words and lines. The rows that weights are fitted on are bounded by
`POSITIVES` and (about, thinned by hash) `UNLABELLED`; every document is scored whole.

Defined results: a null text counts as empty; an empty text has the score that the model gives to a
text without characters; a document with several labels is a positive if its labels' mean is above one
half; without any positives, every score is 0.5; equal texts have equal scores; a text of any length is
read whole; repeated rows are scored each; an empty table gives no rows; further columns are not read,
or, in `keep`, come back unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm.common import id_bucket, lean, ship, slices, text_or_empty
from weirlog.llm.learning import Adam, sample, sigmoid, thinned

FOLDS, HELD, ACCEPT = 4, 2, 0.7
POSITIVES, UNLABELLED = 12_000, 24_000
STEPS, RATE, DECAY = 300, 0.05, 0.05
EDGES = 31

# The kinds of characters by byte; every other punctuation mark is one kind.
_OWN = b"!.,|$%&*#-"
KINDS = 8 + len(_OWN)


def _kinds() -> np.ndarray:
    out = np.full(256, 7, np.uint8)
    out[128:] = 6
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[[9, 11, 12, 13, 32]] = 4
    out[10] = 5
    for i, c in enumerate(_OWN):
        out[c] = 8 + i
    return out


KIND = _kinds()
SHAPES = 10
SIZE = KINDS * KINDS + KINDS + SHAPES


def features(texts: list[bytes]) -> np.ndarray:
    """A row of shares for each text."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    kind = KIND[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int64)
    owner = np.repeat(np.arange(n), sizes)
    single = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    same = owner[1:] == owner[:-1] if len(owner) else np.empty(0, bool)
    pair = np.bincount((owner[1:] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:])[same], minlength=n * KINDS * KINDS).reshape(n, -1) if len(owner) else np.zeros((n, KINDS * KINDS))
    shapes = np.zeros((n, SHAPES))
    for i, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        lines = [x for x in t.split(b"\n") if x]
        m, distinct = len(words), len(set(words))
        twice = sum(map(bytes.__eq__, words, words[1:]))
        upper = sum(map(bytes.isupper, words))
        pairs = len(set(zip(words, words[1:], strict=False)))
        shapes[i] = (twice / m, upper / m, distinct / m, pairs / max(1, m - 1), len(t) / m / 10, np.log1p(m) / 10, len(set(lines)) / max(1, len(lines)), min(1.0, 20 / m), m / max(1, len(lines)) / 100, 1.0)
    whole = np.maximum(sizes, 1)[:, None]
    return np.hstack((np.sqrt(pair / whole), np.sqrt(single / whole), shapes)).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return sigmoid(z @ self.weights + self.bias)


def _edges(positive: np.ndarray) -> np.ndarray:
    """Scores at quantiles of the positives; the highest tails are left out, where the ratio is mostly noise."""
    return np.quantile(positive, np.linspace(0.05, 0.8, EDGES))


def _least_ratio(positive: np.ndarray, above: np.ndarray, total: int, margin: float) -> float:
    """The prior from the positives' scores and from how many of so many unlabelled rows score at each edge or above it."""
    p = (positive[None, :] >= _edges(positive)[:, None]).mean(1)
    noise = margin / np.sqrt(np.maximum(p * min(len(positive), total), 1))
    return float(np.clip((above / total / p + noise).min(), 0.05, 0.98))


def _above(scores: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many scores reach each of the ascending edges."""
    return len(scores) - np.searchsorted(np.sort(scores), edges, side="left")


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = 1.0) -> float:
    """The least ratio of shares above a score, with a margin of so many deviations. Only scores with enough positives above them are asked."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    return _least_ratio(positive, _above(unlabelled, _edges(positive)), len(unlabelled), margin)


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> tuple[np.ndarray, float]:
    """Weights and bias of least logistic risk; without a prior, of positives against unlabelled rows."""
    size, kind = positive.shape[1], positive.dtype
    x, adam = np.zeros(size + 1), Adam(size + 1, RATE)
    for step in range(STEPS):
        # Products are taken in the rows' own type, so that no other copy of them is made.
        gp, gu = (sigmoid((m @ x[:size].astype(kind)).astype(np.float64) + x[size]) for m in (positive, unlabelled))
        if prior is None:
            dp, du = (gp - 1) / len(gp), gu / len(gu)
        else:
            # Risk of calling positives negative is log(1 + exp(g)), whose slope is the sigmoid.
            negative = np.logaddexp(0, np.log(np.maximum(gu, 1e-12) / np.maximum(1 - gu, 1e-12))).mean() - prior * np.logaddexp(0, np.log(np.maximum(gp, 1e-12) / np.maximum(1 - gp, 1e-12))).mean()
            if negative >= 0:
                dp, du = (prior * (gp - 1) - prior * gp) / len(gp), gu / len(gu)
            else:
                dp, du = prior * gp / len(gp), -gu / len(gu)
        gradient = np.concatenate((dp.astype(kind) @ positive + du.astype(kind) @ unlabelled, [dp.sum() + du.sum()]), dtype=np.float64)
        gradient[:size] += DECAY * x[:size]
        adam.rate = RATE * (1 - step / STEPS)
        x = adam.step(x, gradient)
    return x[:size], float(x[size])


def _blocks(rows: np.ndarray):
    """Some thousand rows at a time, in double precision."""
    for a in range(0, len(rows), 2048):
        yield rows[a : a + 2048].astype(np.float64)


def _of_half(rows: np.ndarray, halves: np.ndarray, half: int) -> np.ndarray:
    """The rows of a half, not copied; halves ascend."""
    a, b = np.searchsorted(halves, (half, half + 1))
    return rows[a:b]


@dataclass
class Probes:
    """Rows learnt from, standardised, and three models of positives against unlabelled rows: one of all rows, one of each half. Rows come by ascending half."""

    mean: np.ndarray
    spread: np.ndarray
    positive: np.ndarray
    unlabelled: np.ndarray
    halves: tuple[np.ndarray, np.ndarray]
    models: list[tuple[np.ndarray, float]]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def judged(self, k: int) -> np.ndarray:
        """Scores that model k gives to positives: to all, or, if it learnt from one half, to the other."""
        w, b = self.models[k]
        unseen = _of_half(self.positive, self.halves[0], 2 - k) if k else self.positive
        return np.concatenate([m @ w + b for m in _blocks(unseen if len(unseen) else self.positive)])

    def edges(self) -> np.ndarray:
        return np.array([_edges(self.judged(k)) for k in range(3)])

    def counts(self, x: np.ndarray, half: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """For each model, of unlabelled rows that it has not learnt from (the first: of all): how many reach each edge, and how many there are."""
        z, out = self.scaled(x), np.zeros((3, EDGES + 1), np.int64)
        for k, (w, b) in enumerate(self.models):
            s = (z[half == 2 - k] if k else z) @ w + b
            out[k, :EDGES], out[k, EDGES] = _above(s, edges[k]), len(s)
        return out


def probe(positive: np.ndarray, unlabelled: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> Probes:
    """Model 1 learns from the rows of half 0, model 2 from those of half 1; a half without rows of a kind takes the other's.

    Rows come by ascending half and are standardised in place: on a driver with little memory there is one copy of them.
    """
    both, n = (positive, unlabelled), len(positive) + len(unlabelled)
    mean = sum(x.sum(0) for m in both for x in _blocks(m)) / n
    spread = np.sqrt(sum(((x - mean) ** 2).sum(0) for m in both for x in _blocks(m)) / n) + 1e-3
    out = Probes(mean.astype(np.float32), spread.astype(np.float32), positive, unlabelled, halves, [])
    for m in both:
        m -= out.mean
        m /= out.spread
        np.clip(m, -6, 6, out=m)
    for k in range(3):
        sides = [own if k and len(own := _of_half(m, h, k - 1)) else m for m, h in zip(both, halves, strict=True)]
        out.models.append(_fit(*sides, None))
    return out


def fit(probes: Probes, counts: np.ndarray) -> Model:
    """The model of least non-negative risk, at the prior that the counts of all unlabelled rows give: the mean of what rows learnt from and what cross-fitted scores say."""
    told = [_least_ratio(probes.judged(k), counts[k, :EDGES], int(counts[k, EDGES]), 0.0 if k else 1.0) for k in range(3) if counts[k, EDGES]]
    prior = (told[0] + float(np.mean(told[1:] or told))) / 2
    return Model(probes.mean, probes.spread, *_fit(probes.positive, probes.unlabelled, prior), prior)


NOTHING = Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), 0.0, 0.5)


def _batches(batch):
    """Features of a batch's texts (its first column, binary), some megabytes of text at a time, with their places."""
    texts = batch.column(0)
    for a, b in slices(pc.binary_length(texts).to_pylist(), 1 << 21):
        yield a, b, features(texts[a:b].to_pylist())


def _half():
    """0 or 1 by the id's hash: the half that a document belongs to in cross-fitting."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2)).cast("int").alias("half")


def _featured(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and halves of a bounded set of rows (text binary), on the driver, by ascending half. Most shares are zero, so they travel packed."""

    def go(batches):
        for batch in batches:
            for a, b, x in _batches(batch):
                half = batch.column(1)[a:b].to_numpy().astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([half.tobytes()], pa.binary())], names=["x", "half"])

    found = rows.select("text", _half()).mapInArrow(lean(go), "x binary, half binary").toArrow()
    halves = [np.frombuffer(h.as_py(), np.int8) for h in found.column(1)]
    ends = np.cumsum([sum(int((h == k).sum()) for h in halves) for k in range(2)])
    out, at = np.empty((ends[1], SIZE), np.float32), [0, ends[0]]
    for packed, half in zip(found.column(0), halves, strict=True):
        x = np.frombuffer(pa.decompress(packed.as_buffer(), len(half) * SIZE * 4, "zstd"), np.float32).reshape(-1, SIZE)
        for k in range(2):
            own = x[half == k]
            out[at[k] : at[k] + len(own)] = own
            at[k] += len(own)
    return out, np.repeat(np.arange(2), np.diff(ends, prepend=0))


def _counted(rows: DataFrame, probes: Probes) -> np.ndarray:
    """`Probes.counts` over all rows: each task sends one row of counts for each model, and they are summed."""
    edges = probes.edges()
    small = Probes(probes.mean, probes.spread, np.empty(0), np.empty(0), (np.empty(0), np.empty(0)), probes.models)

    def go(batches):
        total = np.zeros((3, EDGES + 1), np.int64)
        for batch in batches:
            half = batch.column(1).to_numpy()
            for a, b, x in _batches(batch):
                total += small.counts(x, half[a:b], edges)
        yield pa.RecordBatch.from_arrays([pa.array(range(3), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["model", "n"])

    sums = [F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(EDGES + 1)]
    found = rows.select("text", _half()).mapInArrow(lean(go), "model int, n array<long>").groupBy("model").agg(*sums).orderBy("model").collect()
    return np.array([list(r)[1:] for r in found], np.int64).reshape(-1, EDGES + 1)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(FOLDS) == HELD).alias("held_out"), text_or_empty().cast("binary").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of `labels.quality`, from rows outside the held-out fold."""
    ship(docs.sparkSession)
    rows = _rows(docs).filter("not held_out")
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("doc_id is not null and quality is not null")
    good = told.filter(id_bucket(FOLDS) != HELD).groupBy("doc_id").agg(F.avg("quality").alias("q")).filter("q > 0.5").select("doc_id")
    # At most POSITIVES ids are broadcast, so no text is shuffled.
    positive, own = _featured(rows.join(F.broadcast(sample(good, "doc_id", POSITIVES)), "doc_id", "left_semi"))
    unlabelled, other = _featured(thinned(rows, F.col("doc_id"), UNLABELLED, rows.count()))
    if not len(positive) or not len(unlabelled):
        return NOTHING
    probes = probe(positive, unlabelled, (own, other))
    return fit(probes, _counted(rows, probes))


def _scores(model: Model):
    def go(batches):
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), 1 << 21):
                s = model.score(features(batch.column(2)[a:b].to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(s.astype(np.float64))], names=["doc_id", "held_out", "score"])

    return lean(go)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)
    scored = _rows(docs).mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that the classifier accepts."""
    model = train(docs, labels)

    @F.pandas_udf("boolean")
    def accepted(texts):
        data, out = [t.encode() for t in texts], []
        for a, b in slices([len(t) for t in data], 1 << 21):
            out.append(model.score(features(data[a:b])) >= ACCEPT)
        return type(texts)(np.concatenate(out) if out else np.empty(0, bool))

    return docs.filter(accepted(text_or_empty()))
