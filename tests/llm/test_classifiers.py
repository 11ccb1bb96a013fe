import tracemalloc
import zlib

import numpy as np
import pytest

from weirlog.llm import quality, toxicity

from cases import documents, empty, prose


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


@pytest.fixture(scope="module")
def larger(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_held_out(larger):
    docs, labels = larger
    rows = quality.score(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    good, bad = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)


def test_toxic_held_out(larger):
    docs, labels = larger
    rows = toxicity.score(docs, labels).join(labels.select("doc_id", F_toxic(labels)), "doc_id").filter("held_out").collect()
    clean = [r["toxic"] for r in rows if r["label"] == 0]
    assert np.mean(clean) < 0.01
    found = {r["doc_id"] for r in rows if r["toxic"] and r["label"]}
    marked = {r["doc_id"] for r in docs.filter("lang = 'en'").join(labels.filter("toxic = 1"), "doc_id").collect() if held(r["doc_id"])}
    assert len(found & marked) >= 0.85 * len(marked)


def F_toxic(labels):
    return labels["toxic"].alias("label")


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    for prior in (0.3, 0.6, 0.9):
        u = np.concatenate((rng.normal(2, 1, int(6000 * prior)), n[: int(6000 * (1 - prior))]))
        assert abs(quality.estimated_prior(p, u) - prior) < 0.08


def test_non_negative_risk_learns_from_positives_only():
    rng = np.random.default_rng(2)
    x = lambda m, k: np.hstack((rng.normal(m, 1, (k, 3)), rng.normal(0, 1, (k, 5))))
    w, b = quality._fit(x(1, 500), np.vstack((x(1, 700), x(-1, 300))), 0.7)
    assert ((x(1, 500) @ w + b) > 0).mean() > 0.9 and ((x(-1, 500) @ w + b) < 0).mean() > 0.8


def labels_for(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_awkward_documents(spark):
    docs = documents(spark)
    labels = labels_for(spark, [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(80)] + [(None, 1, 1), (5, None, None), (6, 0, 1), (6, 1, 0), (10_000, 1, 1)])
    scored = quality.score(docs, labels)
    assert scored.count() == docs.count() and scored.filter("score is null").count() == 0
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scored.filter("predicted = 1").count()
    toxic = toxicity.score(docs, labels)
    assert toxic.count() == docs.count() and toxic.filter("severity is null or severity < 0 or severity > 3").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 0, 0), (2, 0, 0)], [(1, 1, 1)]])
def test_too_few_labels(spark, rows):
    docs, labels = documents(spark), labels_for(spark, rows)
    assert quality.score(docs, labels).count() == docs.count()
    assert toxicity.score(docs, labels).count() == docs.count()
    assert quality.score(empty(spark), labels).count() == 0 and toxicity.score(empty(spark), labels).count() == 0


def test_grades_follow_the_number_of_marked_words(spark):
    rows, labels = [], []
    for i in range(400):
        n = (0, 0, 0, 2, 5, 12)[i % 6]
        words = prose(80, i).split()
        for k in range(n):
            words[k * 6] = ("vileword", "nastyterm")[k % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(n > 0)))
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels_for(spark, labels)).collect()
    means = [np.mean([r["severity"] for r in out if r["doc_id"] % 6 == k]) for k in (0, 3, 4, 5)]
    assert means == sorted(means) and means[0] < 0.3 and means[3] > 2
    assert all(r["toxic"] == (r["doc_id"] % 6 > 2) for r in out)


def test_features_as_counted_plainly():
    texts = ["", "A b, b\n\nUP up 9$", prose(40, 3), "é" * 9, "x" * 300_000, " \t\n"]
    got = quality.features([t.encode() for t in texts])
    for row, t in zip(got, texts, strict=True):
        raw, words = t.encode(), t.split()
        kinds = [int(quality.KIND[c]) for c in raw]
        pairs, single, size = np.zeros((quality.KINDS, quality.KINDS)), np.zeros(quality.KINDS), max(1, len(raw))
        for i, k in enumerate(kinds):
            single[k] += 1
            if i:
                pairs[kinds[i - 1], k] += 1
        assert np.allclose(row[: -quality.SHAPES], np.sqrt(np.concatenate((pairs.ravel(), single)) / size), atol=1e-6)
        if words:
            shape = row[-quality.SHAPES :]
            assert np.isclose(shape[0], sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)) and np.isclose(shape[2], len(set(words)) / len(words))


def test_prior_counts_cover_all_unlabelled_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "UNLABELLED", 60)
    monkeypatch.setattr(quality, "POSITIVES", 30)
    texts = {i: prose(30, i) if i % 5 else "$$ 0|0 ## " * 12 for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen, counted = [], quality._counted
    monkeypatch.setattr(quality, "_counted", lambda rows, probes: seen.append((probes, counted(rows, probes), rows.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'half'), 2) as half").collect())) or seen[-1][1])
    quality.train(docs, labels_for(spark, [(i, 1, 0) for i in range(0, 400, 3) if i % 5]))
    probes, counts, rows = seen[0]
    assert {r["doc_id"] for r in rows} == {i for i in texts if not held(i)}
    z = probes.scaled(quality.features([texts[r["doc_id"]].encode() for r in rows]))
    for k, (w, b) in enumerate(probes.models):
        s = [float(x @ w + b) for x, r in zip(z, rows, strict=True) if not k or r["half"] == 2 - k]
        assert counts[k, -1] == len(s)
        assert np.abs(counts[k, :-1] - [sum(v >= e for v in s) for e in probes.edges()[k]]).max() <= 2  # rounding at an edge


@pytest.mark.parametrize("share", [3, 6, 9])
def test_prior_of_known_mixtures_of_texts(spark, share):
    """With production bounds; a fifth of the good texts is labelled."""
    rows = [(i, prose(30 + i % 40, i) if i % 10 < share else "$$ 0|0 ## " * (6 + i % 9)) for i in range(3000)]
    labels = labels_for(spark, [(i, 1, 0) for i in range(3000) if i % 10 < share and i // 10 % 5 == 0])
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert abs(model.prior - share / 10) < 0.1


def test_weights_have_least_risk():
    """The plain risk, written out for each row, is no less anywhere around the weights."""
    rng = np.random.default_rng(5)
    p, u, prior = rng.normal(0.7, 1, (200, 3)), rng.normal(0, 1, (300, 3)), 0.5
    softplus = lambda g: float(np.log1p(np.exp(g)))

    def risk(w, b):
        negative = np.mean([softplus(x @ w + b) for x in u]) - prior * np.mean([softplus(x @ w + b) for x in p])
        return prior * np.mean([softplus(-(x @ w + b)) for x in p]) + max(0.0, negative) + quality.DECAY / 2 * float(w @ w)

    w, b = quality._fit(p, u, prior)
    least = risk(w, b)
    for _ in range(60):
        assert risk(w + rng.normal(0, 0.2, 3), b + rng.normal(0, 0.2)) > least - 2e-3


def test_thresholds_have_greatest_likelihood():
    """The plain likelihood of cumulative links, row by row, is no greater anywhere around the fitted model."""
    rng = np.random.default_rng(6)
    rows = [(np.flatnonzero(x), x[np.flatnonzero(x)].astype(float)) for x in rng.integers(0, 2, (300, 4))]
    latent = np.array([v.sum() for _, v in rows]) + rng.logistic(0, 1, 300)
    grade = np.digitize(latent, (1.0, 2.0, 3.5))

    def loss(w, theta):
        total = 0.0
        for (at, v), g in zip(rows, grade, strict=True):
            up = [1.0, *(1 / (1 + np.exp(-(float(v @ w[at]) - t))) for t in theta), 0.0]
            total -= np.log(max(1e-9, up[g] - up[g + 1]))
        return total / len(rows)

    w, theta = toxicity.fit(rows, grade, 4, balanced=False)
    assert (np.diff(theta) > 0).all()
    for _ in range(60):
        assert loss(w + rng.normal(0, 0.2, 4), np.sort(theta + rng.normal(0, 0.2, 3))) > loss(w, theta) - 1e-3


def test_severity_as_a_plain_sum(spark):
    rows = [(i, prose(60, i) + (" vileword nastyterm" * (i % 4))) for i in range(200)] + [(900, None), (901, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), labels_for(spark, [(i, 1, int(i % 4 > 0)) for i in range(200)])
    model = toxicity.train(docs, labels)
    texts = dict(rows)
    for r in toxicity.score(docs, labels).collect():
        times = {}
        for w in (texts[r["doc_id"]] or "").encode().split():
            for h in toxicity.word_features(w):
                if h in model.number:
                    times[h] = times.get(h, 0) + 1
        s = sum(np.log1p(n) * model.weights[model.number[h]] for h, n in times.items())
        assert abs(r["severity"] - sum(1 / (1 + np.exp(t - s)) for t in model.thresholds)) < 1e-6


def test_quality_learns_from_one_copy_of_the_rows(monkeypatch):
    """The driver holds up to 36,000 rows of features; learning must not double them."""
    monkeypatch.setattr(quality, "STEPS", 20)
    rng = np.random.default_rng(5)
    positive, unlabelled = (rng.random((n, quality.SIZE), np.float32) for n in (6_000, 12_000))
    halves = tuple(np.repeat(np.arange(2), len(m) // 2) for m in (positive, unlabelled))
    tracemalloc.start()
    try:
        probes = quality.probe(positive, unlabelled, halves)
        quality.fit(probes, probes.counts(np.zeros((10, quality.SIZE), np.float32), np.arange(10) % 2, probes.edges()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < positive.nbytes + unlabelled.nbytes


def test_quality_rows_reach_the_driver_unchanged(spark):
    texts = [f"Line {i}!\n" * (i % 7) + "x" * (i % 11) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x, halves = quality._featured(docs.selectExpr("doc_id", "cast(text as binary) as text"))
    told = {r["doc_id"]: r["half"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'half'), 2) as half").collect()}
    for k in range(2):
        want = quality.features([texts[i].encode() for i in range(300) if told[i] == k])
        assert np.array_equal(x[halves == k], want)
