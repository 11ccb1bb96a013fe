import random
import zlib
from collections import Counter, defaultdict

import pytest

from weirlog.llm import sharding

from cases import documents, empty


def check(spark, docs, shards):
    rows = sharding.shard(docs, shards).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len(t) + 16, zlib.crc32(t)) for d, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < shards and r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40, 500])
def test_law_and_slots(spark, shards):
    check(spark, documents(spark), shards)


def test_groups_stay_together(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i}" if i < 900 else f"copy {rng.randrange(60)}") for i in range(1500)]
    out = check(spark, spark.createDataFrame(rows, "doc_id long, text string"), 10)
    of = {r["doc_id"]: r["shard"] for r in out}
    apart = sum(len({of[i] for i, t in rows if t == f"copy {k}"}) > 1 for k in range(60))
    assert apart == 0


def test_one_text_holds_a_third(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(1200)]
    out = check(spark, spark.createDataFrame(rows, "doc_id long, text string"), 12)
    hot = Counter(r["shard"] for r in out if r["doc_id"] % 3 == 0)
    # 400 of 100 a shard need four.
    assert sum(n for _, n in hot.most_common(4)) == 400


def test_empty(spark):
    assert sharding.shard(empty(spark)).count() == 0


@pytest.mark.parametrize("linked", [0.5, 0.9, 1.0])
def test_full_shards_cut_few_groups(spark, linked):
    """Groups of 8 that fill the shards: each of 39 stretches of free places may cut one."""
    n = 20_000
    rows = [(i, f"copy {i % int(n * linked / 8)}" if i < n * linked else f"t{i}") for i in range(n)]
    out = check(spark, spark.createDataFrame(rows, "doc_id long, text string"), 40)
    of = defaultdict(set)
    for r in out:
        of[rows[r["doc_id"]][1]].add(r["shard"])
    assert sum(len(v) > 1 for v in of.values()) <= (39 if linked == 1 else 0)


def test_units_of_every_size(spark):
    rng = random.Random(3)
    rows = [(i, f"copy {int(60 * rng.random() ** 3)}") for i in range(3000)]
    out = check(spark, spark.createDataFrame(rows, "doc_id long, text string"), 12)
    held = Counter((rows[r["doc_id"]][1], r["shard"]) for r in out)
    sizes = Counter(t for _, t in rows)
    # The shards that a text needs at least, and one more cut for each shard's free places.
    needed = sum(-(-n // 250) for n in sizes.values())
    assert len(held) <= needed + 11 + 3


def test_groups_that_fit_keep_their_links(spark):
    """At 1,000 rows on 40 shards 20 copies fit in one."""
    rows = [(i, f"copy {i % 25}" if i < 500 else f"t{i}") for i in range(1000)]
    out = check(spark, spark.createDataFrame(rows, "doc_id long, text string"), 40)
    held = Counter((rows[r["doc_id"]][1], r["shard"]) for r in out if r["copies"] > 1)
    assert sum(n * (n - 1) for n in held.values()) == 25 * 20 * 19
