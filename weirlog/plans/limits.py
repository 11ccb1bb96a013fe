"""Limiters, clocks, small scalar functions, and the order-dependent machines over the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirlog.operators import limits, stateful, transitions
from weirlog.plans.fixtures import EV, events, sql_values, values
from weirlog.session import table

RATE, BURST = 0.01, 40.0


def debt_bucket(spark, d):
    rows = limits.debt_bucket(events(spark, d).withColumn("n", F.floor("value").cast("double")), ["host"], "s", "n", "event_id", RATE, BURST)
    return rows.select("event_id", F.round("tokens", 4).alias("tokens"), F.round("wait", 2).alias("wait"))


def daily_budget(spark, d):
    rows = limits.daily_budget(events(spark, d).filter("kind = 'account'"), "s", "event_id", 25)
    return rows.groupBy(F.floor(F.col("s") / 86_400).alias("day")).agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


def request_guard(spark, d):
    per = events(spark, d).groupBy(F.floor(F.col("s") / 600).alias("t")).agg(F.count("*").alias("n"))
    rows = per.select("t", F.sum("n").over(Window.orderBy("t")).alias("a"))
    return limits.request_guard(rows, "t", "a", 36, 6, 3, 19, 1_000_000)


def event_clock(spark, d):
    rows = events(spark, d).withColumn("said", F.col("s") + (F.col("event_id") * 7919 % 200_001) - 150_000)
    return limits.event_clock(rows, ["host"], "event_id", "said", "s", 86_400).select("event_id", "clock")


def rev_chain(spark, d):
    """Commits whose rev is above every earlier one of the account; revs fall back now and then."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events(spark, d).filter("kind = 'commit'").withColumn("rev", F.col("event_id") - F.when(F.col("k") % 5 == 0, 2_000).otherwise(0))
    return rows.withColumn("ok", F.col("rev") > F.coalesce(F.max("rev").over(w), F.lit(-1_000_000))).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("accepted"))


def burst_schedule(spark, d):
    return events(spark, d).select("event_id", limits.bursts_due(F.col("s") % 100_000, 3_600, 60, 5).alias("due"))


PRICES = [("alpha", 0.0, 1000.0, 0.5), ("alpha", 1000.0, 10_000.0, 0.25), ("alpha", 10_000.0, None, 0.125), ("beta", 0.0, 5000.0, 0.375), ("beta", 5000.0, None, 0.25), ("gamma", 0.0, None, 0.28125)]


def cost_tiers(spark, d):
    usage = table(spark, d, "customer").select(F.col("c_custkey").alias("scenario"), (F.col("c_custkey") * 13).cast("double").alias("amount"))
    return limits.tiered_cost(usage, values(spark, PRICES, "provider string, lo double, hi double, price double"))


def version_compare(spark, d):
    rows = events(spark, d).select("event_id", F.concat(F.lit("n"), (F.col("k") % 2).cast("string"), F.lit(":"), F.col("event_id").cast("string")).alias("a"), F.when(F.col("k") % 3 == 0, F.col("k").cast("string")).when(F.col("k") % 3 == 1, F.concat(F.lit("n1:"), (F.col("event_id") * 7 % 9973).cast("string"))).otherwise("n0:x").alias("b"))
    return rows.select("event_id", limits.version_after(F.col("a"), F.col("b")).alias("c"))


PROXIES = ["10.0.0.0/8", "192.168.1.0/24"]


def client_ips(spark, d):
    e = F.col("event_id")
    peer = F.when(e % 4 == 0, "203.0.113.9").when(e % 4 == 1, "192.168.1.77").when(e % 4 == 2, "192.168.2.77").otherwise("10.200.3.4")
    hops = F.concat(F.lit("198.51.100."), (e % 250).cast("string"), F.lit(", 10.1.2.3"), F.when(e % 3 == 0, F.lit(" ,192.168.1.9")).otherwise(F.lit("")))
    return events(spark, d).select("event_id", limits.client_ip(peer, F.when(e % 5 != 0, hops), PROXIES).alias("ip"))


def consumer_lag(spark, d):
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select(c.alias("id"), F.when(c % 3 != 0, c * 5).alias("last"), F.when(c % 2 == 0, c).alias("start"), F.lit(7_000).cast("long").alias("head"), F.lit(4_000).alias("cutoff"), (c % 2 == 0).alias("backfilling"))
    return limits.consumer_position(rows).select("id", "position", "lag", "slow")


def window_progress(spark, d):
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(n.cast("long").alias("n"), (n * 1000 + n * 37 % 900).cast("long").alias("after"), F.when(n < 24, (n + 1) * 1000 - 1).cast("long").alias("until"), (n % 6 == 0).alias("done"))
    return limits.window_progress(rows, F.lit(24_900)).select("n", F.col("permille").cast("long").alias("permille"))


def read_lags(spark, d):
    e = events(spark, d).withColumn("ms", F.floor(F.col("us") / 1000))
    lag = limits.read_lag(F.col("ms") + F.col("event_id") % 15_000, F.col("ms") - F.floor(F.col("value") * 100) + 500, F.col("ms"), F.col("k") * 10)
    return e.select("event_id", lag.cast("long").alias("lag_ms"))


def backoff_delays(spark, d):
    return events(spark, d).select("event_id", limits.backoff((F.col("k") % 12).cast("double"), 1.0, 300.0).alias("delay"))


# --- Order-dependent machines ---


def _account_events(spark, d):
    e, k = F.col("event_id"), F.col("k")
    return events(spark, d).withColumn("kind", F.when(F.col("kind") == "reject", "commit").otherwise(F.col("kind"))).select(
        "user_id", "event_id", "kind", (e - F.when(k % 13 == 0, 3_000).otherwise(0)).alias("rev"), e.alias("commit"), (e % 4).alias("data"),
        F.when(k % 3 == 0, F.lag(e % 4).over(Window.partitionBy("user_id").orderBy("event_id"))).alias("prev_data"), (k % 9 != 0).alias("active"), F.when(k % 2 == 0, "suspended").otherwise("gone").alias("status"), F.floor(F.col("s") / 60).alias("minute"),
    )


def chain_desync(spark, d):
    return stateful.run(_account_events(spark, d), transitions.account_chain(5), ["user_id"], ["event_id"], ["event_id"])


def _sweeps(spark, d):
    """A sweep of each host every six hours; the operator acts now and then."""
    e = events(spark, d).groupBy("host", (F.floor(F.col("s") / 21_600) * 21_600).alias("s")).agg(F.count_if(F.col("kind") != "reject").alias("events"), F.count_if(F.col("kind") == "reject").alias("failed"), F.max("k").alias("k"))
    act = F.element_at(F.array(*(F.lit(a) for a in ("set:trusted", "suspend", "unban", "ban", "unban", "set:default"))), (F.col("s") / 21_600 % 6 + 1).cast("int"))
    return e.withColumn("spam", F.col("k") > 98).withColumn("action", F.when(F.col("k") % 40 == 3, act))


def tier_machine(spark, d):
    return stateful.run(_sweeps(spark, d), transitions.tier_machine(recover_s=43_200, error_min=4), ["host"], ["s"], ["s"])


def lag_cases(spark, d):
    e = events(spark, d).select("host", "event_id", (F.floor(F.col("us") / 60_000) * 1_000).alias("ms"), F.when(F.col("k") != 5, F.floor(F.col("value") * 30_000)).alias("lag_ms"), F.when(F.col("k") % 29 == 0, F.floor(F.col("us") / 60_000) * 1_000 - 1_000).alias("held_ms"), (F.col("k") == 7).alias("pressed"))
    return stateful.run(e, transitions.lag_cases(sustain=20_000, resolve=30_000, grace=9_000), ["host"], ["ms", "event_id"], ["event_id"])


def admit_bucket(spark, d):
    e = events(spark, d).select("host", "event_id", F.floor(F.col("us") / 1_000_000).alias("ms"), (F.col("k") % 3 + 1).alias("n"))
    return stateful.run(e, transitions.admit_bucket(2.0), ["host"], ["ms", "event_id"], ["event_id"])


def reserving_bucket(spark, d):
    e = events(spark, d).select("host", "event_id", F.floor(F.col("us") / 1_000_000).alias("ms"))
    return stateful.run(e, transitions.reserving_bucket(0.25, 3.0, 2.0), ["host"], ["ms", "event_id"], ["event_id"])


def hourly_log(spark, d):
    e = events(spark, d).select("host", "event_id", "s", (F.col("k") % 4 == 0).alias("failed"))
    return stateful.run(e, transitions.hourly_log(8, 36_000), ["host"], ["s", "event_id"], ["event_id"])


def fixed_window(spark, d):
    return stateful.run(events(spark, d).select("host", "event_id", "s"), transitions.fixed_window(3, 10_000), ["host"], ["s", "event_id"], ["event_id"])


def account_gate(spark, d):
    e = events(spark, d).filter("kind = 'account'").select("host", "event_id", "s", F.col("user_id").alias("did"), (F.col("k") % 2 == 0).alias("created"))
    return stateful.run(e, transitions.account_gate(150, 0.05, 86_400), ["host"], ["s", "event_id"], ["event_id"])


def ack_epochs(spark, d):
    e = F.col("event_id")
    start = events(spark, d).select("host", (e * 10).alias("t"), F.when(F.col("k") == 50, "connect").otherwise("start").alias("op"), F.when((F.col("k") == 50) & (e % 3 == 0), F.lit(None)).when(F.col("k") == 50, e - 300).otherwise(e).alias("seq"), F.floor(e / 2_000).alias("epoch"))
    end = events(spark, d).filter("k <> 50").select("host", (e * 10 + (F.col("k") % 40) * 30).alias("t"), F.when(F.col("k") % 33 == 0, "fail").otherwise("finish").alias("op"), e.alias("seq"), F.floor(e / 2_000).alias("epoch"))
    return stateful.run(start.union(end), transitions.ack_epochs(), ["host"], ["t", "op"], ["t"])


def identity_patience(spark, d):
    return stateful.run(events(spark, d).select("user_id", "event_id", "s", (F.col("k") % 3 == 0).alias("ok")), transitions.identity_patience(300_000, 400_000), ["user_id"], ["event_id"], ["event_id"])


def resync_queue(spark, d):
    e = events(spark, d).select("host", "event_id", "s", F.when(F.col("k") % 2 == 0, "ask").otherwise("done").alias("op"), F.col("user_id").alias("did"))
    return stateful.run(e, transitions.resync_queue(200_000, 5), ["host"], ["event_id"], ["event_id"])


def versioned_saves(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("doc"), F.col("o_orderkey").alias("t"), (F.floor(F.col("o_orderkey") / 200) % 100).cast("int").alias("base"), "o_orderstatus")
    return stateful.run(o.withColumnRenamed("o_orderstatus", "body"), transitions.versioned_saves(), ["doc"], ["t"], ["t"])


def log_truncation(spark, d):
    e = events(spark, d).select("host", "event_id", F.floor(F.col("event_id") / 2_500).alias("epoch"), (F.row_number().over(Window.partitionBy("host").orderBy("event_id")) - F.col("k") % 3).cast("long").alias("seq"), F.floor((F.col("event_id") - 10) / 2_500).alias("prev_epoch"), F.col("k").alias("content")).filter("seq >= 1")
    return stateful.run(e, transitions.log_truncation(), ["host"], ["event_id"], ["event_id"])


def clock_pace(spark, d):
    e = events(spark, d).select("host", "event_id", "s", (F.col("s") - 80_000 + F.col("event_id") * 3).alias("event_s"))
    return stateful.run(e, transitions.clock_pace(), ["host"], ["event_id"], ["event_id"])


QUERIES = {f.__name__: f for f in (debt_bucket, daily_budget, request_guard, event_clock, rev_chain, burst_schedule, cost_tiers, version_compare, client_ips, consumer_lag, window_progress, read_lags, backoff_delays, chain_desync, tier_machine, lag_cases, admit_bucket, reserving_bucket, hourly_log, fixed_window, account_gate, ack_epochs, identity_patience, resync_queue, versioned_saves, log_truncation, clock_pace)}

SQL = {
    "debt_bucket": f"""WITH RECURSIVE {EV}, o AS (SELECT host, event_id, s, floor(value) AS n, row_number() OVER (PARTITION BY host ORDER BY s, event_id) AS i FROM ev),
      b AS (SELECT host, i, event_id, s, {BURST}::DOUBLE - n AS x FROM o WHERE i = 1 UNION ALL SELECT o.host, o.i, o.event_id, o.s, least({BURST}::DOUBLE, b.x + (o.s - b.s) * {RATE}::DOUBLE) - o.n FROM b JOIN o ON o.host = b.host AND o.i = b.i + 1)
      SELECT event_id, round(x, 4) AS tokens, round(CASE WHEN x >= 0 THEN 0.0::DOUBLE ELSE -x / {RATE}::DOUBLE END, 2) AS wait FROM b""",
    "daily_budget": f"WITH {EV}, r AS (SELECT s // 86400 AS day, row_number() OVER (PARTITION BY s // 86400 ORDER BY event_id) AS n FROM ev WHERE kind = 'account') SELECT day, count(*) FILTER (n <= 25) AS admitted, count(*) FILTER (n > 25) AS refused FROM r GROUP BY day",
    "request_guard": f"""WITH {EV}, p AS (SELECT s // 600 AS t, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT t, (sum(n) OVER (ORDER BY t))::BIGINT AS a FROM p),
      g AS (SELECT t, a, (SELECT max(t) FROM c o WHERE o.t <= c.t - 36) AS t0, (SELECT min(t) FROM c o WHERE o.t >= c.t - 6) AS t1, row_number() OVER (ORDER BY t) AS i FROM c),
      w AS (SELECT g.t, g.a, CASE WHEN g.a >= 1000000 THEN 'total' WHEN g.a - x.a > (g.t - g.t0) * 3 THEN 'rate' WHEN CASE WHEN i = 1 THEN g.a ELSE g.a - y.a END > 19 THEN 'burst' END AS why FROM g LEFT JOIN c x ON x.t = t0 LEFT JOIN c y ON y.t = t1) SELECT * FROM w WHERE why IS NOT NULL ORDER BY t LIMIT 1""",
    "event_clock": f"WITH {EV}, c AS (SELECT event_id, host, s, s + event_id * 7919 % 200001 - 150000 AS e FROM ev) SELECT event_id, greatest(max(least(greatest(e, s - 86400), s)) OVER (PARTITION BY host ORDER BY event_id), s - 86400) AS clock FROM c",
    "rev_chain": f"WITH {EV}, r AS (SELECT user_id, event_id, event_id - CASE WHEN k % 5 = 0 THEN 2000 ELSE 0 END AS rev FROM ev WHERE kind = 'commit'), o AS (SELECT user_id, rev > coalesce(max(rev) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) AS ok FROM r) SELECT user_id, count(*) AS n, count(*) FILTER (ok) AS accepted FROM o GROUP BY user_id",
    "burst_schedule": f"WITH {EV} SELECT event_id, s % 100000 // 3600 * 300 + least(s % 100000 % 3600, 60) * 5 AS due FROM ev",
    "cost_tiers": f"""WITH {sql_values("p", PRICES, "provider, lo, hi, price")}, u AS (SELECT c_custkey AS scenario, (c_custkey * 13)::DOUBLE AS amount FROM customer), c AS (SELECT scenario, provider, sum(greatest(least(amount, coalesce(hi, amount)) - lo, 0) * price) AS cost FROM u, p GROUP BY 1, 2)
      SELECT scenario, provider, cost, row_number() OVER (PARTITION BY scenario ORDER BY cost, provider) = 1 AS cheapest FROM c""",
    "version_compare": f"WITH {EV} SELECT event_id, CASE WHEN k % 3 = 1 AND k % 2 = 1 THEN sign(event_id - event_id * 7 % 9973)::INTEGER END AS c FROM ev",
    "client_ips": f"""WITH {EV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN '203.0.113.9' WHEN 2 THEN '192.168.2.77' ELSE CASE WHEN event_id % 5 <> 0 THEN '198.51.100.' || (event_id % 250) ELSE CASE event_id % 4 WHEN 1 THEN '192.168.1.77' ELSE '10.200.3.4' END END END AS ip FROM ev""",
    "consumer_lag": """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 5 WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 7000 END AS position, c_custkey % 2 = 0 AS b FROM customer) SELECT id, position, greatest(7000 - position, 0) AS lag, NOT b AND greatest(7000 - position, 0) * 4 > 4000 AS slow FROM r""",
    "window_progress": """WITH r AS (SELECT n_nationkey::BIGINT AS n, n_nationkey * 1000 + n_nationkey * 37 % 900 AS a, CASE WHEN n_nationkey < 24 THEN (n_nationkey + 1) * 1000 - 1 ELSE 24900 END AS e FROM nation), b AS (SELECT *, coalesce(lag(e) OVER (ORDER BY n) + 1, 0) AS s FROM r)
      SELECT n, (CASE WHEN n % 6 = 0 THEN 1000 ELSE floor(least(greatest((a - s) * 1000 / greatest(e - s, 1), 0), 1000)) END)::BIGINT AS permille FROM b""",
    "read_lags": f"WITH {EV} SELECT event_id, CASE WHEN event_id % 15000 >= 10000 THEN 0 ELSE greatest(floor(value * 100)::BIGINT - 500, 0) + k * 10 END::BIGINT AS lag_ms FROM ev",
    "backoff_delays": f"WITH {EV} SELECT event_id, least(pow(2.0::DOUBLE, k % 12), 300.0::DOUBLE) / 2 AS delay FROM ev",
}

_NUM = "o AS (SELECT host, event_id, {cols}, row_number() OVER (PARTITION BY host ORDER BY event_id) AS i FROM ev)"
SQL |= {
    "admit_bucket": f"""WITH RECURSIVE {EV}, {_NUM.format(cols="us // 1000000 AS ms, k % 3 + 1 AS n")},
      b AS (SELECT host, i, event_id, ms, CASE WHEN n <= 2 THEN 2.0::DOUBLE - n ELSE 2.0::DOUBLE END AS x, n <= 2 AS ok FROM o WHERE i = 1
        UNION ALL SELECT o.host, o.i, o.event_id, o.ms, t.t - CASE WHEN t.t >= o.n THEN o.n ELSE 0 END, t.t >= o.n FROM b JOIN o ON o.host = b.host AND o.i = b.i + 1, LATERAL (SELECT least(2.0::DOUBLE, b.x + greatest(0, o.ms - b.ms) / 1000 * 2.0::DOUBLE) AS t) t)
      SELECT host, event_id, ok FROM b""",
    "reserving_bucket": f"""WITH RECURSIVE {EV}, {_NUM.format(cols="us // 1000000 AS ms")},
      b AS (SELECT host, i, event_id, ms, 2.0::DOUBLE AS x, true AS ok, 0.0::DOUBLE AS wait FROM o WHERE i = 1
        UNION ALL SELECT o.host, o.i, o.event_id, o.ms, CASE WHEN (1 - t.t) / 0.25::DOUBLE <= 2 THEN t.t - 1 ELSE t.t END, (1 - t.t) / 0.25::DOUBLE <= 2, greatest(0, (1 - t.t) / 0.25::DOUBLE) FROM b JOIN o ON o.host = b.host AND o.i = b.i + 1, LATERAL (SELECT least(3.0::DOUBLE, b.x + greatest(0, o.ms - b.ms) / 1000 * 0.25::DOUBLE) AS t) t)
      SELECT host, event_id, ok, CASE WHEN ok THEN round(wait, 6) END AS wait FROM b""",
    "fixed_window": f"""WITH RECURSIVE {EV}, {_NUM.format(cols="s")},
      b AS (SELECT host, i, event_id, s AS since, 1 AS n, true AS ok FROM o WHERE i = 1
        UNION ALL SELECT o.host, o.i, o.event_id, CASE WHEN o.s - b.since >= 10000 THEN o.s ELSE b.since END, CASE WHEN o.s - b.since >= 10000 THEN 1 WHEN b.n < 3 THEN b.n + 1 ELSE b.n END, o.s - b.since >= 10000 OR b.n < 3 FROM b JOIN o ON o.host = b.host AND o.i = b.i + 1)
      SELECT host, event_id, ok FROM b""",
    "identity_patience": f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, s, k % 3 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ev),
      b AS (SELECT user_id, i, event_id, CASE WHEN NOT ok THEN s END AS since, NULL::BIGINT AS fin, CASE WHEN ok THEN 'ok' ELSE 'retry' END AS verdict FROM o WHERE i = 1
        UNION ALL SELECT o.user_id, o.i, o.event_id, CASE WHEN NOT o.ok THEN w.s0 END, CASE WHEN o.ok THEN NULL WHEN w.f0 IS NOT NULL THEN w.f0 WHEN o.s - w.s0 >= 300000 THEN o.s END, CASE WHEN o.ok THEN 'ok' WHEN w.f0 IS NOT NULL OR o.s - w.s0 >= 300000 THEN 'gave_up' ELSE 'retry' END
          FROM b JOIN o ON o.user_id = b.user_id AND o.i = b.i + 1, LATERAL (SELECT b.since IS NULL OR coalesce(o.s - b.fin >= 400000, false) OR (b.fin IS NULL AND o.s - b.since >= 400000) AS fresh) f,
            LATERAL (SELECT CASE WHEN fresh THEN o.s ELSE b.since END AS s0, CASE WHEN NOT fresh THEN b.fin END AS f0) w)
      SELECT user_id, event_id, verdict FROM b""",
    "versioned_saves": """WITH RECURSIVE o AS (SELECT o_custkey % 100 AS doc, o_orderkey AS t, (o_orderkey // 200 % 100)::INTEGER AS base, o_orderstatus AS body, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS i FROM orders),
      b AS (SELECT doc, i, t, CASE WHEN base = 0 THEN 1 ELSE 0 END AS version, CASE WHEN base = 0 THEN body END AS body, CASE WHEN base = 0 THEN 'saved' ELSE 'conflict' END AS verdict FROM o WHERE i = 1
        UNION ALL SELECT o.doc, o.i, o.t, b.version + (o.base = b.version)::INTEGER, CASE WHEN o.base = b.version THEN o.body ELSE b.body END, CASE WHEN o.base <> b.version THEN 'conflict' WHEN o.body IS DISTINCT FROM b.body THEN 'saved' ELSE 'same' END FROM b JOIN o ON o.doc = b.doc AND o.i = b.i + 1)
      SELECT doc, t, verdict, version::INTEGER AS version FROM b""",
    "hourly_log": f"""WITH RECURSIVE {EV}, {_NUM.format(cols="s, k % 4 = 0 AS failed")},
      b AS (SELECT host, i, event_id, CASE WHEN failed THEN []::BIGINT[] ELSE [s::BIGINT] END AS log, true AS ok FROM o WHERE i = 1
        UNION ALL SELECT o.host, o.i, o.event_id, CASE WHEN len(t.l) < 8 AND NOT o.failed THEN list_append(t.l, o.s::BIGINT) ELSE t.l END, len(t.l) < 8 FROM b JOIN o ON o.host = b.host AND o.i = b.i + 1, LATERAL (SELECT list_filter(b.log, lambda x: o.s - x < 36000) AS l) t)
      SELECT host, event_id, ok, len(log)::INTEGER AS in_window FROM b""",
    "clock_pace": f"""WITH RECURSIVE {EV}, {_NUM.format(cols="s, s - 80000 + event_id * 3 AS e")},
      b AS (SELECT host, i, event_id, least(greatest(e, s - 86400), s) AS clock, s AS m0, least(greatest(e, s - 86400), s) AS m1, 1.0::DOUBLE AS pace FROM o WHERE i = 1
        UNION ALL SELECT o.host, o.i, o.event_id, c.c, CASE WHEN o.s > b.m0 THEN o.s ELSE b.m0 END, CASE WHEN o.s > b.m0 THEN c.c ELSE b.m1 END, CASE WHEN o.s > b.m0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, 0.5::DOUBLE * b.pace + 0.5::DOUBLE * (c.c - b.m1)::DOUBLE / (o.s - b.m0))) ELSE b.pace END
          FROM b JOIN o ON o.host = b.host AND o.i = b.i + 1, LATERAL (SELECT greatest(b.clock, least(greatest(o.e, o.s - 86400), o.s), o.s - 86400) AS c) c)
      SELECT host, event_id, clock, round(pace, 6) AS pace FROM b""",
}
