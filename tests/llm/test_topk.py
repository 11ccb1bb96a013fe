import math
import random

from weirlog.llm import topk


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, v in sorted((i, v) for i, v in ok if i % 50 == 0):
        if q in seen:
            continue
        seen.add(q)
        found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted(map(tuple, topk.search(frame, frame.filter("vec_id % 50 = 0")).collect()))


def test_brute_force(spark):
    rng = random.Random(1)
    grid = [i / 8 for i in range(-16, 17)]  # exact in single precision, with many ties
    rows = [(i, [rng.choice(grid) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(50)]
    rows += [(None, [1.0] * 8), (900, None), (950, [None] * 8), (1000, [float("nan")] * 8), (1050, [float("inf")] + [0.0] * 7), (1100, []), (1101, []), (1150, [1.0, 2.0]), (1151, [2.0, 1.0]), (1200, [3.0])]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(0, 1000, 10)]
    rows += [(60, [1.0, 1.0, 1.0, 1.0]), (100, rows[10][1])]
    assert run(spark, rows) == brute(rows)


def test_large_values_are_exact(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**13, 1.0]), (2, [2.0**13, 2.0]), (3, [-(2.0**60), 0.0]), (4, [2.0**60, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
