import math
import zlib
from collections import Counter

import numpy as np
import pytest

from weirlog.llm import brown

from cases import documents, empty, prose


def likelihood(pairs, of):
    n = np.zeros((brown.CLASSES, brown.CLASSES))
    for x in range(len(of)):
        np.add.at(n[of[x]], of, pairs[x])
    return brown._f(n).sum() - brown._f(n.sum(1)).sum() - brown._f(n.sum(0)).sum()


def test_exchange_never_loses_likelihood(monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 5)
    rng = np.random.default_rng(0)
    pairs = rng.poisson(rng.random((40, 40)) ** 6 * 30).astype(float)
    of = np.arange(40) % 5
    for _ in range(6):
        after = brown.exchange(pairs, of, 1)
        assert likelihood(pairs, after) >= likelihood(pairs, of) - 1e-6
        of = after


def test_exchange_finds_planted_classes(monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 2)
    rng = np.random.default_rng(1)
    side = np.arange(30) % 2
    pairs = rng.poisson(np.where(side[:, None] != side[None, :], 20, 0.5)).astype(float)
    of = brown.exchange(pairs, np.arange(30) // 15)
    assert len({(a, b) for a, b in zip(side, of)}) == 2


def base(docs):
    words = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2
    c = Counter(w for d, t in docs if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(d), held(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in docs)


def test_counts_and_base_score(spark):
    docs = documents(spark)
    rows = brown.score(docs).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert got == base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(r["score"] < 0 and r["perplexity"] >= 1 for r in rows)


class Brute:
    """The model word by word, in plain loops."""

    def __init__(self, texts):
        learnt = [[*(t or "").encode().lower().split(), None] for t in texts]
        self.count = Counter(w for seq in learnt for w in seq)
        words = sorted((w for w in self.count if w is not None), key=lambda w: (-self.count[w], w))
        total = sum(self.count[w] for w in words)
        table = [w for w in words if self.count[w] * brown.HEAD >= total]
        single = set(table[: brown.SINGLE])
        unit = lambda w: 0 if w is None else 1 + table.index(w) if w in single else 1 + min(brown.SINGLE, len(table)) + zlib.crc32(w[-3:]) % brown.TAIL
        of_word = {w: unit(w) for w in self.count}
        size = 1 + min(brown.SINGLE, len(table)) + brown.TAIL
        pairs = np.zeros((size, size))
        for seq in learnt:
            for a, b in zip([None, *seq], seq):
                pairs[of_word[a] if a is not None else 0, of_word[b]] += 1
        start = np.empty(size, np.int64)
        start[np.argsort(-pairs.sum(0), kind="stable")] = np.arange(size) % brown.CLASSES
        of_unit = brown.exchange(pairs, start)
        before = {w: of_unit[u] for w, u in of_word.items()} | {None: of_unit[0]}
        steps = self.steps(learnt, before)
        beside = {w: np.zeros((2, brown.CLASSES)) for w in self.count}
        for seq in learnt:
            whole = [None, *seq]
            for i in range(1, len(whole) - 1):
                beside[whole[i]][0, before[whole[i - 1]]] += 1
                beside[whole[i]][1, before[whole[i + 1]]] += 1
        self.of = {w: before[w] if w is None or w in single else int(brown.best_classes(steps, np.array([before[w]]), beside[w][:1], beside[w][1:])[0]) for w in before}
        self.n = self.steps(learnt, self.of)
        self.size, self.types = (np.array([sum(f(w) for w in self.count if self.of[w] == c) for c in range(brown.CLASSES)]) for f in (self.count.__getitem__, lambda w: 1))
        once, twice = (sum(self.count[w] == k for w in words) for k in (1, 2))
        self.discount = min(once / (once + 2 * twice), 0.95) if once else 0.5

    @staticmethod
    def steps(seqs, of):
        n = np.zeros((brown.CLASSES, brown.CLASSES))
        for seq in seqs:
            for a, b in zip([None, *seq], seq):
                n[of[a], of[b]] += 1
        return n

    def arrive(self, a, b):
        anywhere = (self.size + 0.5) / (self.size.sum() + 0.5 * brown.CLASSES)
        out = self.n[a].sum()
        if not out:
            return anywhere[b]
        kept = [max(x - brown.CONTEXT_DISCOUNT, 0) / out for x in self.n[a]]
        return kept[b] + (1 - sum(kept)) * anywhere[b]

    def unseen(self, c):
        return max(self.discount * self.types[c] / self.size[c], 1e-12) if self.size[c] else 1.0

    def score(self, text):
        sum_, last = 0.0, self.of[None]
        for w in [*(text or "").encode().lower().split(), None]:
            if w in self.count:
                c = self.of[w]
                sum_ += math.log10(self.arrive(last, c)) + math.log10(max(self.count[w] - self.discount, 1e-9) / self.size[c])
            else:
                each = [self.arrive(last, k) * self.unseen(k) for k in range(brown.CLASSES)]
                c = int(np.argmax(each))
                sum_ += min(math.log10(sum(each)), 0)
            last = c
        return sum_


def _held(d):
    return zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2


@pytest.mark.parametrize(("head", "single"), [(60_000, 2000), (60_000, 30), (200, 30), (1, 30)])
def test_score_as_a_plain_model(spark, monkeypatch, head, single):
    """All words in the table; most of them not exchanged alone; most outside the table; no table at all."""
    for k, v in {"HEAD": head, "SINGLE": single, "CLASSES": 8, "SPAN": 300, "CHUNK": 4000}.items():
        monkeypatch.setattr(brown, k, v)
    docs = documents(spark).coalesce(1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = Brute([t for d, t in rows if not _held(d)])
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 5)) for r in brown.score(docs).collect())
    assert got == sorted((str(d), len((t or "").encode().split()) + 1, round(plain.score(t), 5)) for d, t in rows)


def test_probabilities_sum_to_one():
    """Over all known words and one unknown in a class, and over the classes after any."""
    plain = Brute([prose(200, i) for i in range(20)] + ["rare"])
    for c in np.flatnonzero(plain.size):
        known = sum((plain.count[w] - plain.discount) / plain.size[c] for w in plain.count if plain.of[w] == c)
        assert abs(known + plain.unseen(c) - 1) < 1e-9
    assert all(abs(sum(plain.arrive(a, b) for b in range(brown.CLASSES)) - 1) < 1e-9 for a in range(brown.CLASSES))


def test_beats_the_base_on_held_out_text(spark, sf):
    held = [r for r in brown.score(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_nothing_to_learn_from(spark):
    assert brown.score(empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    [r] = brown.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_every_word_is_clustered_by_its_contexts(spark, monkeypatch):
    """Two kinds of words that take turns share one ending; outside the exchanged words they must be told apart too."""
    for k, v in {"SINGLE": 40, "CLASSES": 4, "HEAD": 1000, "SPAN": 2000}.items():
        monkeypatch.setattr(brown, k, v)
    rng = np.random.default_rng(3)
    kinds = [[f"{k}{i}xyz" for i in range(300)] for k in "ab"]
    # The 20 words of either kind at the front are the exchanged ones.
    weight = np.where(np.arange(300) < 20, 8.0, 1.0)
    draws = [rng.choice(300, (400, 20), p=weight / weight.sum()) for _ in kinds]
    texts = [" ".join(kinds[i % 2][draws[i % 2][d, i // 2]] for i in range(40)) for d in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    plain = Brute([t for d, t in enumerate(texts) if not _held(d)])
    a, b = ({plain.of[w.encode()] for w in kind if w.encode() in plain.of} for kind in kinds)
    assert len(plain.of) == 601 and not a & b
    assert all(abs(r["score"] - plain.score(texts[r["doc_id"]])) < 1e-6 for r in brown.score(docs).collect())


@pytest.mark.parametrize("head", [50, 60_000])
def test_tail_words_cost_no_more_than_their_kind(spark, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)
    monkeypatch.setattr(brown, "SINGLE", 20)
    monkeypatch.setattr(brown, "CLASSES", 4)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{'ab'[i % 2]}{int(30 * rng.random() ** 2)}xyz" for i in range(40)) for _ in range(600)]
    rows = brown.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    # What a place's own kind leaves open; without the kinds it is twice that.
    share = np.diff(np.sqrt(np.arange(31) / 30))
    assert 10 ** (-sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)) < 1.3 * np.exp(-(share * np.log(share)).sum())


def test_best_class_gains_most_likelihood(monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 5)
    rng = np.random.default_rng(5)
    pairs = rng.poisson(rng.random((30, 30)) ** 6 * 30).astype(float)
    np.fill_diagonal(pairs, 0)
    of = rng.integers(0, 5, 30)
    n = np.array([[pairs[of == a][:, of == b].sum() for b in range(5)] for a in range(5)])
    left, right = (np.stack([np.bincount(of, row, 5) for row in m]) for m in (pairs.T, pairs))
    for w, c in enumerate(brown.best_classes(n, of, left, right)):
        moved = lambda k: likelihood(pairs, np.where(np.arange(30) == w, k, of))
        assert moved(c) >= max(map(moved, range(5))) - 1e-6
