"""Mutations: what is put into a clean log is what the audits report."""

import hashlib
import random
import signal

import pytest
from pyspark.sql import functions as F

from weirlog.operators import audit, reconcile, rollup, windows

GAPS = [(10, 12)]


def observed(spark, rows):
    return spark.createDataFrame(rows, "stream string, pos long, seq long, content long, did long")


CLEAN = [("a", i, i, i * 3, i) for i in range(1, 31) if not 10 < i <= 12]


def findings(spark, rows):
    o, gaps = observed(spark, rows), spark.createDataFrame(GAPS, "after long, upto long")
    s = audit.steps(o)
    return {
        "conflicts": audit.content_conflicts(o).count(), "backs": s.filter("back").count(), "holes": audit.jumps(s, gaps).filter("not covered").count(),
        "covered": audit.jumps(s, gaps).filter("covered").count(), "twice": audit.duplicates(o, gaps).count(),
    }


def test_clean_log(spark):
    assert findings(spark, CLEAN) == {"conflicts": 0, "backs": 0, "holes": 0, "covered": 1, "twice": 0}


@pytest.mark.parametrize(
    ("mutate", "what"),
    [
        (lambda r: [x for x in r if x[2] != 20], "holes"),
        (lambda r: [*r, ("a", 99, 5, 15, 5)], "backs"),
        (lambda r: [*r, ("b", 1, 7, -1, 7)], "conflicts"),
        (lambda r: [*r, ("a", 99, 40, 9, 3)], "twice"),
    ],
)
def test_each_fault_is_reported(spark, mutate, what):
    assert findings(spark, mutate(CLEAN))[what] == 1


def test_acknowledged(spark):
    acked = spark.createDataFrame([(5, 15, 5), (6, 1, 6), (20, 60, 20), (11, 1, 11), (12, 1, 25)], "seq long, content long, did long")
    rows = [r for r in CLEAN if r[2] != 20]
    got = {r["seq"]: r["fate"] for r in audit.acknowledged(acked, observed(spark, rows), spark.createDataFrame(GAPS, "after long, upto long")).collect()}
    assert got == {5: "ok", 6: "content", 20: "missing", 11: "lost", 12: "reingested"}


def test_merged_gaps(spark):
    g = spark.createDataFrame([(1, 3), (3, 5), (9, 10), (2, 4)], "after long, upto long")
    assert sorted(map(tuple, audit.merged_gaps(g).collect())) == [(1, 5), (9, 10)]


def test_greedy_is_the_two_pointer_rule(spark):
    rng = random.Random(5)
    s = [(1, rng.randrange(1000), i) for i in range(60)]
    r = [(1, rng.randrange(1000), 100 + i) for i in range(60)]
    frame = lambda x: spark.createDataFrame(x, "k int, at long, id long")
    got = {(x["source"], x["relay"]) for x in reconcile.greedy(frame(s), frame(r), ["k"], "at", "id").collect()}
    want, free = set(), sorted((t, i) for _, t, i in r)
    for _, t, i in sorted(s, key=lambda x: (x[1], x[2])):
        later = [x for x in free if x[0] >= t]
        if not later:
            break
        want.add((i, later[0][1]))
        free = [x for x in free if x > later[0]]
    assert got == want


def test_rebalance_evens_out(spark):
    hosts = spark.createDataFrame([(f"h{i}", "a" if i < 9 else "b") for i in range(12)], "host string, owner string")
    moves = rollup.rebalance(hosts, ["a", "b", "c"], 100)
    owner = {f"h{i}": "a" if i < 9 else "b" for i in range(12)} | dict(moves)
    counts = sorted(list(owner.values()).count(m) for m in "abc")
    assert counts == [4, 4, 4] and len(moves) == 5


@pytest.mark.parametrize("seed", range(4))
def test_rebalance_takes_the_highest_affinity(spark, seed):
    """Against one move after another; hosts may be repeated, null or of other owners."""
    rng = random.Random(seed)
    rows = [(None if not rng.randrange(40) else f"h{rng.randrange(150 if seed % 2 else 10**6)}", rng.choice(["a", "a", "a", "b", "b", "c", "gone", None])) for _ in range(300)]
    members, most = ["e", "b", "a", "c", "d"], [None, 7, 1000, 60][seed]
    held = {m: [h for h, o in rows if o == m] for m in sorted(members)}
    want = []
    while len(want) < (max(len(rows) // 64, 4) if most is None else most):
        high, low = max(held, key=lambda m: (len(held[m]), m)), min(held, key=lambda m: (len(held[m]), m))
        if len(held[high]) <= len(held[low]) + 1:
            break
        h = max(held[high], key=lambda x: hashlib.sha256(f"{low}/{x}".encode()).hexdigest())
        held[high].remove(h)
        held[low].append(h)
        want.append((h, low))
    assert rollup.rebalance(spark.createDataFrame(rows, "host string, owner string"), members, most) == want


def test_rebalance_of_many_hosts(spark):
    """A round over 300,000 hosts is 4,687 moves and must not try every host for each of them."""

    def late(*_):
        raise TimeoutError("rebalance took more than 90 s")

    n = 300_000
    hosts = spark.range(n).selectExpr("concat('h', id) AS host", "concat('n', id % 3) AS owner")
    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(90)
    try:
        moves = rollup.rebalance(hosts, ["n0", "n1", "n2", "n3"])
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    affinity = lambda h: hashlib.sha256(f"n3/{h}".encode()).hexdigest()
    k = n // 64
    best = {j: iter(sorted((f"h{i}" for i in range(j, n, 3)), key=affinity, reverse=True)) for j in range(3)}
    # Equal counts give in turn, the last by name first.
    assert moves == [(next(best[2 - i % 3]), "n3") for i in range(k)]


def test_sliding_follows_the_tracker(spark):
    rng = random.Random(4)
    rows, s = [], 0
    for i in range(400):
        s += rng.randrange(9)
        rows.append((i, s, rng.choice("ab")))
    frame = spark.createDataFrame(rows, "event_id long, s long, key string").withColumn("width", F.lit(60).cast("long")).withColumn("limit", F.lit(8).cast("long"))
    got = {r["event_id"]: r["numerator"] for r in windows.sliding(frame, ["key"]).collect()}
    counts: dict = {}
    for i, s, k in rows:
        w = s // 60
        counts[k, w] = counts.get((k, w), 0) + 1
        assert got[i] == counts[k, w] * 60 + counts.get((k, w - 1), 0) * (60 - s % 60)


def test_segments(spark, tmp_path):
    from weirlog.sources import segments

    root = f"file://{tmp_path}/log"
    log = spark.range(1, 101).withColumnRenamed("id", "seq")
    refs = [segments.flush(log.filter(F.col("seq").between(a, a + 24)), root, i) for i, a in enumerate((1, 26, 51, 76))]
    segments.commit(spark, root, refs[:2], 1)
    assert segments.scan(spark, root, 20, 90).count() == 30  # 21..50: the last two segments aren't committed
    segments.commit(spark, root, refs, 2)
    assert segments.scan(spark, root, 20, 90).count() == 70
    with pytest.raises(RuntimeError):
        segments.commit(spark, root, refs, 2)
    with pytest.raises(FileNotFoundError):
        segments.scan(spark, root, 500)


def test_byte_budget_takes_empty_entries(spark):
    """More entries than the budget has bytes, many of them empty, over several stretches."""
    rows = [(i, 1 if i % 3000 == 0 else 0) for i in range(1, 20_000)]
    got = sorted(r["seq"] for r in audit.byte_budget(spark.createDataFrame(rows, "seq long, bytes long"), 5, 3).collect())
    assert got == list(range(5, 12_000))
    assert [r["seq"] for r in audit.byte_budget(spark.createDataFrame([(7, 9), (8, 1)], "seq long, bytes long"), 0, 3).collect()] == [7]
