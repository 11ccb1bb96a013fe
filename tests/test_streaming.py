"""Streams over files reach what batch reaches; a restart resumes where it stopped."""

import datetime

from pyspark.sql import functions as F

from weirlog.operators import stateful, transitions
from weirlog.streaming import flows, machines

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def drained(spark, rows, tmp_path, name):
    flows.drain(rows, flows.parquet_sink(f"{tmp_path}/{name}"), f"{tmp_path}/{name}-state")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_dedupe_and_restart(spark, tmp_path):
    path, schema = f"{tmp_path}/in", "id int, at timestamp"
    kind = put(spark, path, [(1, at(0)), (2, at(1)), (1, at(2))], schema)
    stream = lambda: flows.deduplicated(flows.files(spark, path, "*.parquet", kind), "at", ["id"], "1 hour")
    assert drained(spark, stream(), tmp_path, "out").count() == 2
    put(spark, path, [(2, at(5)), (3, at(6))], schema)
    assert sorted(r["id"] for r in drained(spark, stream(), tmp_path, "out").collect()) == [1, 2, 3]


def test_pairs(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    kind = put(spark, a, [(i, at(i)) for i in range(20)], "seq int, at timestamp")
    put(spark, b, [(i, at(i + (60 if i == 7 else 2))) for i in range(0, 20, 1) if i != 3], "seq int, at timestamp")
    left, right = (flows.files(spark, p, "*.parquet", kind) for p in (a, b))
    out = drained(spark, flows.paired(left, right, "seq", "at", "30 seconds"), tmp_path, "out")
    assert sorted(r["seq"] for r in out.collect()) == [i for i in range(20) if i not in (3, 7)]


def test_machine_state_crosses_batches(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = [(k, t, (t + k) % 3 + 1) for t in range(0, 6000, 170) for k in range(3)]
    for i in range(3):
        kind = put(spark, path, rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3], "k int, ms long, n int")
    # Files come in order of time, so the batches do.
    stream = machines.run(flows.files(spark, path, "*.parquet", kind), transitions.admit_bucket(2.0), ["k"], ["ms"], ["ms"])
    got = {(r["k"], r["ms"]): r["ok"] for r in drained(spark, stream, tmp_path, "out").collect()}
    frame = spark.createDataFrame(rows, "k int, ms long, n int")
    want = {(r["k"], r["ms"]): r["ok"] for r in stateful.run(frame, transitions.admit_bucket(2.0), ["k"], ["ms"], ["ms"]).collect()}
    assert got == want


def test_upsert_keeps_the_newest(spark, tmp_path):
    path = f"{tmp_path}/in"
    for i in range(3):
        kind = put(spark, path, [(k, 10 * i + k, f"v{i}") for k in range(i, 4)], "k int, n int, v string")
    flows.drain(flows.files(spark, path, "*.parquet", kind), flows.upsert_sink(f"{tmp_path}/out", ["k"], ["n"]), f"{tmp_path}/state")
    versions = spark.read.parquet(f"{tmp_path}/out")
    last = versions.filter(F.col("version") == versions.agg(F.max("version")).first()[0])
    assert {(r["k"], r["v"]) for r in last.collect()} == {(0, "v0"), (1, "v1"), (2, "v2"), (3, "v2")}
