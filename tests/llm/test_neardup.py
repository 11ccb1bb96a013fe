from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirlog.llm import neardup
from weirlog.llm.common import ship
from weirlog.scratch import Scratch

from cases import documents, empty, prose


def brute(rows):
    """(doc_id, class_id, n_links) of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("short", *w)} if w else set())
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 5 * inter >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    small = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return Counter((d, small[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def check(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, neardup.join(docs).collect())) == brute(rows)


def test_brute_force(spark):
    check(spark, documents(spark))


@pytest.mark.parametrize(("bucket", "whole", "block", "direct"), [(4, 6, 3, 1), (2, 2, 2, 1), (2, 2, 2, 2)])
def test_deep_paths_and_blocks(spark, monkeypatch, bucket, whole, block, direct):
    """Buckets that split down to the last level, and families that are compared in blocks."""
    for name, v in (("BUCKET", bucket), ("WHOLE", whole), ("BLOCK", block), ("DIRECT", direct)):
        monkeypatch.setattr(neardup, name, v)
    check(spark, documents(spark))


def test_large_family(spark):
    base, rows = prose(150, 9).split(), []
    for i in range(300):
        words = list(base)
        for k in range(i % 4):
            words[(i * 37 + k * 41) % 150] = f"w{i}"
        rows.append((i, " ".join(words)))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_first_of_each(spark):
    docs = documents(spark)
    out = neardup.first_of_each(docs)
    assert out.columns == docs.columns
    classes = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = [r["doc_id"] for r in out.collect()]
    for d, first, _ in classes:
        if first is not None and d is not None:
            assert (d in kept) == (d == first)
    assert sum(r["text"] is None or not r["text"].strip() for r in out.collect()) == sum(r["text"] is None or not r["text"].strip() for r in docs.collect())


def test_empty(spark):
    assert neardup.join(empty(spark)).count() == 0 and neardup.first_of_each(empty(spark)).count() == 0


def test_large_buckets_are_compared(spark, monkeypatch):
    """Sketches in a large last-level bucket: all that agree enough get united, those that agree little do not."""
    monkeypatch.setattr(neardup, "BUCKET", 8)
    rng = np.random.default_rng(3)
    sketches = []
    for size in (30, 20, 1, 1, 1):
        base = rng.integers(0, 256, neardup.COORDINATES)
        for _ in range(size):
            mine, k = base.copy(), int(rng.integers(0, 18))
            mine[rng.choice(neardup.COORDINATES, k, replace=False)] = rng.integers(0, 256, k)
            sketches.append(mine.astype(np.uint8))
    rows = [(1, i, bytearray(x.tobytes()), len(sketches), 0) for i, x in enumerate(sketches)]
    stars, far = neardup._settled(spark.createDataFrame(rows, "key long, rep long, sketch binary, members long, first long"), Scratch(spark))
    assert stars.count() == 30 and 23 <= far.count() < 53
    rest = neardup._in_blocks(far)
    assert max(r["count"] for r in rest.groupBy("key").count().collect()) < 30
    ship(spark)
    edges = stars.union(rest.repartition("key").sortWithinPartitions("key").mapInArrow(neardup._unite, "a long, b long")).collect()
    got = neardup.local_roots(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), len(rows))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (sketches[a] == sketches[b]).sum() >= neardup.UNITE]
    want = neardup.local_roots(*np.array(pairs).T, len(rows))
    assert got.tolist() == want.tolist() and len(set(got.tolist())) == 5


def test_long_texts_are_compared_in_blocks(spark, monkeypatch):
    """Families whose shingles exceed two blocks."""
    monkeypatch.setattr(neardup, "SHINGLES", 400)
    base = prose(300, 5).split()
    rows = [(i, " ".join([*base[: 300 - i], f"w{i}"])) for i in range(12)] + [(12, None), (13, prose(300, 6))]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_equal_hashes_of_different_documents(spark, monkeypatch):
    """Documents are told apart by their ids where row hashes collide."""
    monkeypatch.setattr(neardup, "row_hash", lambda: F.lit(7).cast("long").alias("h"))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l"), (None, "m n o p q"), (4, "")], "doc_id long, text string")
    check(spark, docs)
    assert {r["doc_id"] for r in neardup.first_of_each(docs).collect()} == {1, 3, 4, None}


def test_runs_reach_the_recall():
    assert len(neardup.runs(0.999)) == 5 and len(set(neardup.runs())) == len(neardup.runs())


@pytest.mark.parametrize("splits", range(neardup.DEPTH))
def test_split_buckets_keep_the_recall(splits):
    """The exact chance that a pair at the threshold, whose sketches agree enough, meets in no leaf when its buckets split so often."""
    n, tried, s, missed = neardup.COORDINATES, len(neardup.runs()), neardup.NUMERATOR / neardup.DENOMINATOR, 0.0
    for agree in range(neardup.UNITE, n + 1):
        together = 1.0
        for level in reversed(range(splits)):
            together = 1 - (1 - agree / n * together) ** neardup.BRANCH[level]
        for met in range(max(0, tried - n + agree), min(agree, tried) + 1):
            drawn = comb(agree, met) * comb(n - agree, tried - met) / comb(n, tried)
            missed += comb(n, agree) * s**agree * (1 - s) ** (n - agree) * drawn * (1 - together) ** met
    assert missed < 1e-7
