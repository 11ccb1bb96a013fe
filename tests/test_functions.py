"""Scalar functions, rules and encodings on small tables."""

import hashlib
import random

from pyspark.sql import functions as F

from weirlog.functions import hosts, ids
from weirlog.operators import limits, lookup, policy, validation


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_encodings_round_trip():
    rng = random.Random(1)
    for _ in range(200):
        raw = rng.randbytes(15)
        assert ids.base32_decode(ids.base32_encode(raw)) == raw
        us = rng.randrange(1 << 52)
        assert ids.tid_micros(ids.tid(us, rng.randrange(1024))) == us
    assert ids.base32_decode("0" * 24) is None and ids.base32_decode("a") is None
    assert ids.tid_micros("zzzzzzzzzzzzz") is None
    assert ids.base58_decode("11") == b"\0\0" and ids.base58_decode("0") is None
    assert ids.fnv1a(b"") == 0xCBF29CE484222325 and ids.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_tid_order_is_time_order():
    stamps = sorted(random.Random(2).sample(range(1 << 50), 100))
    assert [ids.tid(s) for s in stamps] == sorted(ids.tid(s) for s in stamps)


def test_multikey():
    point = b"\xe7\x01\x02" + bytes(range(32))
    n, text = int.from_bytes(point, "big"), ""
    while n:
        n, r = divmod(n, 58)
        text = ids.BASE58[r] + text
    assert ids.multikey(f"did:key:z{text}") == ("k256", point[2:])
    assert ids.multikey("z1") is None and ids.multikey("m" + text) is None


def test_spark_forms(spark):
    frame = spark.createDataFrame([("a",), (None,)], "s string")
    got = frame.select(ids.fnv1a_of(F.col("s")).alias("h"), ids.did_bytes(F.col("s")).alias("d")).collect()
    assert got[0]["h"] == ids.fnv1a(b"a") - (1 << 64) and got[1]["h"] is None and got[0]["d"] is None


def test_suffixes(spark):
    assert one(spark, hosts.suffixes(F.col("h")), h="a.b.example.com:8443") == ["a.b.example.com", "b.example.com", "example.com"]
    assert one(spark, hosts.suffixes(F.col("h")), h="localhost") == ["localhost"]


def test_rules_prefer_exact_then_longest(spark):
    rules = spark.createDataFrame([(1, "*.example.com", "a"), (2, "x.example.com", "b"), (3, "*.x.example.com", "c"), (4, "y.example.com:99", "d"), (5, "*.com", "e")], "id int, pattern string, effect string")
    names = spark.createDataFrame([(h,) for h in ("x.example.com", "z.x.example.com", "q.example.com", "example.com", "y.example.com:99", "y.example.com:98", "other.org", "x.com")], "host string")
    got = {r["host"]: r["rule"] for r in lookup.most_specific(names, rules).collect()}
    assert got == {"x.example.com": 2, "z.x.example.com": 3, "q.example.com": 1, "example.com": 1, "y.example.com:99": 4, "y.example.com:98": 1, "other.org": None, "x.com": None}


def test_first_known(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a")], [(1, "b"), (2, "b")]))
    assert sorted(map(tuple, lookup.first_known(keys, [a, b], "k", ["v"]).collect())) == [(1, "a", 0), (2, "b", 1), (3, None, None)]


def test_first_failing_order(spark):
    checks = [("late", F.col("n") > 5), ("early", F.col("n") > 1), ("null", F.lit(None).cast("boolean"))]
    assert [one(spark, validation.first_failing(checks), n=n) for n in (0, 3, 9)] == [None, "early", "late"]


def test_cidr(spark):
    inside = lambda cidr, ip: one(spark, limits.cidr_contains(F.col("c"), F.col("i")), c=cidr, i=ip)
    assert inside("10.0.0.0/8", "10.255.0.1") and not inside("10.0.0.0/8", "11.0.0.1") and inside("0.0.0.0/0", "1.2.3.4") and inside("1.2.3.4/32", "1.2.3.4")


def test_debt_bucket_follows_the_recursion(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(300):
        t += rng.randrange(5)
        rows.append((i, t, float(rng.randrange(1, 9))))
    frame = spark.createDataFrame(rows, "i int, s long, n double")
    got = {r["i"]: r["tokens"] for r in limits.debt_bucket(frame, [], "s", "n", "i", 0.7, 12.0).collect()}
    x, last = 12.0, rows[0][1]
    for i, s, n in rows:
        x, last = min(12.0, x + 0.7 * (s - last)) - n, s
        assert abs(got[i] - x) < 1e-9


def test_severity_and_status(spark):
    assert one(spark, policy.severity(F.col("o"), F.lit(10.0), F.lit("alert")), o=50) == "critical"
    assert one(spark, policy.severity(F.col("o"), F.lit(0.0), F.lit("case")), o=50) == "warn"


def test_host_key_is_a_digest_prefix(spark):
    assert one(spark, F.substring(F.sha2("h", 256), 1, 16), h="x") == hashlib.sha256(b"x").hexdigest()[:16]
