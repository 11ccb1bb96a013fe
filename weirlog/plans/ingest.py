"""Routing, validation, reject classes, net operations, sequence checks, takedowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirlog.operators import validation
from weirlog.plans.fixtures import EV, events, sql_values, values
from weirlog.session import table


def route_kinds(spark, d):
    return events(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq"))


def _frames(spark, d):
    """Each event as a commit of one to three operations, some of them bad in ways that its numbers decide."""
    k, e = F.col("k"), F.col("event_id")
    op = lambda i: F.struct(F.when((e + i) % 5 == 0, "delete").when((e + i) % 41 == 0, "purge").otherwise("create").alias("action"), F.concat(F.when((e + i) % 29 == 0, F.lit("")).otherwise(F.lit("app.post/")), (k + i).cast("string")).alias("path"), F.when((e + i) % 5 != 0, F.concat(F.lit("c"), e.cast("string"))).alias("cid"), F.lit(None).cast("string").alias("prev"))
    return events(spark, d).select(
        "event_id", "host", F.when(e % 31 == 0, 0).otherwise(e + 1).alias("seq"), F.when(e % 37 == 0, 6_000_000).when(e % 23 == 0, 2_500_000).otherwise(F.floor("value")).alias("size"),
        F.concat(F.when(e % 19 == 0, F.lit("id:")).otherwise(F.lit("did:")), F.lit("plc:u"), F.col("user_id").cast("string")).alias("did"), (F.col("s") + F.when(e % 17 == 0, 301).otherwise(300)).alias("rev_s"), F.col("s").alias("now"),
        F.when(k % 2 == 0, F.array(op(0))).otherwise(F.array(op(0), op(1), op(2))).alias("ops"),
    )


def validate_first_reason(spark, d):
    return _frames(spark, d).select("event_id", validation.first_failing(validation.commit_checks()).alias("reason"))


REASONS = [*validation.REJECT_CLASS, "bad_car", "op_mismatch", "store", "not_owner", "bad_cid", "duplicate_path"]


def _rejects(spark, d):
    return events(spark, d).select("event_id", "host", "s", F.element_at(F.array(*(F.lit(r) for r in REASONS)), (F.col("k") % len(REASONS) + 1).cast("int")).alias("reason"), "kind").filter("kind = 'reject'")


def reject_classes(spark, d):
    rows = _rejects(spark, d).withColumn("class", validation.reject_class(F.col("reason")))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.count_if(validation.retryable(F.col("reason"))).alias("retryable"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in validation.REJECT_CLASS.items())
_REASONS_SQL = "[" + ", ".join(f"'{r}'" for r in REASONS) + "]"
REJECTS_SQL = f"""{EV}, rej AS (SELECT event_id, host, s, ({_REASONS_SQL})[k % {len(REASONS)} + 1] AS reason FROM ev WHERE kind = 'reject'),
cls AS (SELECT *, CASE reason {_CASES} ELSE 'invalid_commit' END AS class FROM rej)"""


def props_json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", F.col("p.k").alias("k"), (F.col("p.k") % 2 == 0).alias("even"))


OPS = [(1, 0, "create", "a", "x", None), (1, 1, "update", "a", "y", "x"), (1, 2, "delete", "a", None, "y"), (2, 0, "create", "a", "x", None), (2, 1, "create", "a", "y", None), (3, 0, "update", "b", "q", "p"), (3, 1, "update", "b", "r", "z"), (4, 0, "delete", "c", None, "m"), (4, 1, "create", "c", "n", None), (4, 2, "create", "d", "o", None), (5, 0, "delete", "e", None, None), (5, 1, "delete", "e", None, None)]


def net_ops(spark, d):
    """Inline commits and one commit of each order: its lines are operations on the part's supplier."""
    inline = values(spark, OPS, "g long, i long, action string, path string, cid string, prev string")
    lines = table(spark, d, "lineitem")
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("sup"), F.min("l_partkey").alias("part"))
    ops = rows.select((F.col("l_orderkey") + 1000).alias("g"), F.col("l_linenumber").cast("long").alias("i"), F.when(F.col("part") % 3 == 0, "delete").when(F.col("part") % 3 == 1, "create").otherwise("update").alias("action"), F.concat(F.lit("s"), (F.col("sup") % 4).cast("string")).alias("path"), F.when(F.col("part") % 3 != 0, F.concat(F.lit("c"), (F.col("part") % 2).cast("string"))).alias("cid"), F.when(F.col("part") % 5 == 0, F.lit("c1")).alias("prev"))
    return validation.net_ops(inline.union(ops), ["g"])


def seq_regressions(spark, d):
    """Every 97th frame comes again two places later; the copy doesn't advance its socket."""
    e = events(spark, d).select("host", F.col("event_id").alias("seq"), (F.col("event_id") * 10).alias("arrival"))
    again = e.filter("seq % 97 = 0").withColumn("arrival", F.col("arrival") + 25)
    out = validation.regressions(e.union(again), ["host"], "arrival")
    return out.groupBy("host").agg(F.count("*").alias("frames"), F.count_if(~F.col("advances")).alias("dropped"))


def restarted_sequences(spark, d):
    """A host's sequence counts within its days; every fifth day it starts over."""
    e = events(spark, d).withColumn("arrival", F.col("event_id")).withColumn("seq", F.col("event_id") - F.when(F.col("s") % 432_000 >= 0, F.floor(F.col("s") / 432_000) * F.when(F.col("user_id") % 2 == 0, 5_000).otherwise(0)).otherwise(0))
    out = validation.generations(e.select("host", "arrival", "seq"), ["host"], "arrival")
    return out.groupBy("host", "generation").agg(F.count("*").alias("n"), F.sum("gap").cast("long").alias("skipped"))


def takedown_filter(spark, d):
    """Customers whose latest even or odd order says so are taken down; counts of what still passes by kind."""
    acts = table(spark, d, "orders").select((F.col("o_custkey") % 150).alias("did"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 == 0).alias("active")).filter("did % 4 = 0")
    rows = validation.without_taken_down(events(spark, d).withColumn("did", F.col("user_id")), acts)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("did").alias("accounts"))


def takedown_latest(spark, d):
    """The newest takedowns with their accounts' latest actions, newest first."""
    acts = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    latest = acts.groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_orderstatus")).alias("r"))
    return latest.select(F.col("r.o_orderkey").alias("at"), "o_custkey", F.col("r.o_orderstatus").alias("action")).filter("action = 'F'").orderBy(F.col("at").desc(), "o_custkey")


def seq_rewrite(spark, d):
    """Dense sequence numbers in arrival order: a window over ids in two levels, so no task sorts the log."""
    from pyspark.sql import Window

    e = events(spark, d).filter("kind <> 'reject'").select("event_id", F.floor(F.col("event_id") / 1000).alias("part"))
    counts = e.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return e.join(before, "part").select("event_id", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("event_id"))).alias("seq"))


def reject_top_reason(spark, d):
    """Each host's commonest class among its last 50 rejects of the last week."""
    from weirlog.operators import rollup

    rows = _rejects(spark, d).withColumn("class", validation.reject_class(F.col("reason"))).withColumn("at", F.col("s"))
    order = sorted({*validation.REJECT_CLASS.values(), "invalid_commit"})
    index = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(order) for x in (c, i))), F.col("class"))
    end = events(spark, d).agg(F.max("s").alias("end"))
    return rollup.commonest(rows.join(F.broadcast(end)), ["host"], "class", "event_id", 50, F.col("end") - 604_800, index)


QUERIES = {f.__name__: f for f in (route_kinds, validate_first_reason, reject_classes, props_json_extract, net_ops, seq_regressions, restarted_sequences, takedown_filter, takedown_latest, seq_rewrite, reject_top_reason)}

SQL = {
    "route_kinds": f"WITH {EV} SELECT kind, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq FROM ev GROUP BY kind",
    "validate_first_reason": f"""WITH {EV}, ix AS (SELECT event_id, i FROM ev, (VALUES (0), (1), (2)) t(i) WHERE i = 0 OR k % 2 <> 0),
      bad AS (SELECT event_id, bool_or((event_id + i) % 41 = 0 AND (event_id + i) % 5 <> 0 OR (event_id + i) % 29 = 0) AS b FROM ix GROUP BY event_id)
      SELECT event_id, CASE WHEN event_id % 37 = 0 THEN 'frame_too_big' WHEN event_id % 31 = 0 THEN 'bad_seq' WHEN event_id % 19 = 0 THEN 'bad_did' WHEN event_id % 23 = 0 THEN 'blocks_too_big' WHEN event_id % 17 = 0 THEN 'future_rev' WHEN b THEN 'bad_op' END AS reason FROM ev JOIN bad USING (event_id)""",
    "reject_classes": f"WITH {REJECTS_SQL} SELECT class, count(*) AS n, count(*) FILTER (reason IN ('identity_unavailable', 'store', 'not_owner')) AS retryable FROM cls GROUP BY class",
    "props_json_extract": f"WITH {EV} SELECT event_id, k, k % 2 = 0 AS even FROM ev",
    "net_ops": f"""WITH {sql_values("inl", OPS, "g, i, action, path, cid, prev")}, li AS (SELECT l_orderkey + 1000 AS g, l_linenumber AS i, min(l_suppkey) AS sup, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
      ops AS (SELECT g::BIGINT AS g, i::BIGINT AS i, action, path, cid, prev FROM inl UNION ALL SELECT g, i, CASE part % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'create' ELSE 'update' END, 's' || (sup % 4), CASE WHEN part % 3 <> 0 THEN 'c' || (part % 2) END, CASE WHEN part % 5 = 0 THEN 'c1' END FROM li),
      f AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN true WHEN action = 'create' THEN lag(cid) OVER w IS NULL ELSE lag(cid) OVER w IS NOT NULL AND (prev IS NULL OR prev = lag(cid) OVER w) END AS fit FROM ops WINDOW w AS (PARTITION BY g, path ORDER BY i))
      SELECT g, path, first(prev ORDER BY i) AS before, first(action ORDER BY i) <> 'create' AS needs_before, last(cid ORDER BY i) AS after, max(i) AS last, bool_and(fit) AS fits FROM f GROUP BY g, path""",
    "seq_regressions": f"""WITH {EV}, a AS (SELECT host, event_id AS seq, event_id * 10 AS arrival FROM ev UNION ALL SELECT host, event_id, event_id * 10 + 25 FROM ev WHERE event_id % 97 = 0),
      b AS (SELECT *, seq > coalesce(max(seq) OVER (PARTITION BY host ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS adv FROM a) SELECT host, count(*) AS frames, count(*) FILTER (NOT adv) AS dropped FROM b GROUP BY host""",
    "restarted_sequences": f"""WITH {EV}, a AS (SELECT host, event_id AS arrival, event_id - (s // 432000) * CASE WHEN user_id % 2 = 0 THEN 5000 ELSE 0 END AS seq FROM ev), b AS (SELECT *, lag(seq) OVER (PARTITION BY host ORDER BY arrival) AS p FROM a),
      c AS (SELECT *, coalesce(p > seq, false)::INT AS fell FROM b), e AS (SELECT *, sum(fell) OVER (PARTITION BY host ORDER BY arrival) AS generation, CASE WHEN fell = 1 THEN 0 ELSE greatest(coalesce(seq - p - 1, 0), 0) END AS gap FROM c)
      SELECT host, generation::BIGINT AS generation, count(*) AS n, sum(gap)::BIGINT AS skipped FROM e GROUP BY 1, 2""",
    "takedown_filter": f"""WITH {EV}, act AS (SELECT o_custkey % 150 AS did, arg_max(o_orderkey % 3 = 0, o_orderkey) AS active FROM orders WHERE o_custkey % 150 % 4 = 0 GROUP BY 1)
      SELECT kind, count(*) AS n, count(DISTINCT user_id) AS accounts FROM ev WHERE kind NOT IN ('commit', 'sync') OR user_id NOT IN (SELECT did FROM act WHERE active) GROUP BY kind""",
    "takedown_latest": "SELECT max(o_orderkey) AS \"at\", o_custkey, arg_max(o_orderstatus, o_orderkey) AS action FROM orders GROUP BY o_custkey HAVING action = 'F' ORDER BY 1 DESC, o_custkey",
    "seq_rewrite": f"WITH {EV} SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq FROM ev WHERE kind <> 'reject'",
    "reject_top_reason": f"""WITH {REJECTS_SQL}, r AS (SELECT host, class FROM cls WHERE s >= (SELECT max(s) FROM ev) - 604800 AND event_id IN (SELECT event_id FROM cls QUALIFY row_number() OVER (PARTITION BY host ORDER BY event_id DESC) <= 50)),
      c AS (SELECT host, class, count(*) AS n FROM r GROUP BY 1, 2) SELECT host, class FROM c QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, class DESC) = 1""",
}
