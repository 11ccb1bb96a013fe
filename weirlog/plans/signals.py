"""Abuse signals, rates and quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirlog.operators import windows
from weirlog.plans.fixtures import EV, events, sql_values, values

#: rule, kind, key, window s, limit; scaled to the rate of the given events
RULES = [("account_rejects_day", "reject", "user", 86_400, 3), ("account_rejects_week", "reject", "user", 604_800, 6), ("account_commits", "commit", "user", 3_600, 2), ("host_new_accounts", "account", "host", 86_400, 12), ("host_identity_churn", "identity", "host", 86_400, 15), ("host_off", "sync", "host", 3_600, 0)]
_RULE_COLUMNS = "rule string, kind string, by string, width long, limit long"
_RULES_SQL = sql_values("rules", RULES, "rule, kind, by_, width, lim")
SIGNALS_SQL = f"""{EV}, {_RULES_SQL},
sig AS (SELECT r.rule, CASE by_ WHEN 'user' THEN user_id::VARCHAR ELSE host END AS key, r.width, r.lim, event_id, s, s // r.width * r.width AS win FROM ev JOIN rules r ON ev.kind = r.kind),
tot AS (SELECT rule, key, win, count(*) AS n FROM sig GROUP BY 1, 2, 3),
est AS (SELECT sig.*, row_number() OVER (PARTITION BY sig.rule, sig.key, sig.win ORDER BY s, event_id) AS cur, coalesce(tot.n, 0) AS prev
  FROM sig LEFT JOIN tot ON tot.rule = sig.rule AND tot.key = sig.key AND tot.win = sig.win - sig.width),
num AS (SELECT *, (cur * width + prev * (width - (s - win)))::BIGINT AS numerator FROM est)"""


def _signals(spark, d):
    rules = F.broadcast(values(spark, RULES, _RULE_COLUMNS))
    key = F.when(F.col("by") == "user", F.col("user_id").cast("string")).otherwise(F.col("host"))
    return events(spark, d).join(rules, "kind").select("rule", key.alias("key"), "width", "limit", "event_id", "s")


def signal_trips(spark, d):
    """The first crossing of each rule, key and window."""
    return windows.first_crossings(windows.sliding(_signals(spark, d), ["rule", "key", "limit"]).drop("by"), ["rule", "key"])


def sliding_estimate(spark, d):
    counted = windows.sliding(_signals(spark, d), ["rule", "key"])
    return counted.select("rule", "key", "event_id", "cur", "prev", "numerator")


def signal_topk(spark, d):
    """The ten heaviest keys of each rule at the time of the last event."""
    rows = _signals(spark, d)
    last = events(spark, d).agg(F.max("s").alias("as_of"))
    at = windows.standing(rows.crossJoin(F.broadcast(last)).withColumn("as_of", F.col("as_of")), ["rule", "key"], F.col("as_of"))
    return windows.ranked(at, ["rule"], [(F.col("numerator") / F.col("width")).desc(), F.col("key")], 10).select("rule", "key", "numerator", F.col("rank").cast("long").alias("rank"))


def _per_host(spark, d):
    """Events and rejects of each host by day; a sample of the rings is a day here."""
    rows = events(spark, d).withColumn("t", F.floor(F.col("s") / 86_400))
    return windows.seconds_of(rows, ["host"], "t", {"events": F.count("*"), "rejects": F.count_if(F.col("kind") == "reject")})


_DAYS = f"""{EV}, sums AS (SELECT host, s // 86400 AS t, count(*) AS events, count(*) FILTER (kind = 'reject') AS rejects FROM ev GROUP BY 1, 2),
every AS (SELECT host, unnest(range(min(t), max(t) + 1)) AS t FROM sums GROUP BY host),
days AS (SELECT host, t, coalesce(events, 0) AS events, coalesce(rejects, 0) AS rejects FROM every LEFT JOIN sums USING (host, t))"""


def rolling_rate(spark, d):
    """Events in the last ten samples of each host."""
    return windows.rolling_sum(_per_host(spark, d), ["host"], "t", "events", 10, "events_10").select("host", "t", "events_10")


def reject_ratio(spark, d):
    """Rejects and events in the last 60 samples, and parts a million of rejects; 0 when there are no events."""
    rows = windows.rolling_sum(windows.rolling_sum(_per_host(spark, d), ["host"], "t", "events", 60, "e"), ["host"], "t", "rejects", 60, "r")
    return rows.select("host", "t", "e", "r", F.when(F.col("e") > 0, F.floor(F.col("r") * 1_000_000 / F.col("e"))).otherwise(0).cast("long").alias("ppm"))


def _counters(spark, d):
    """Cumulative counters of each host, scraped every six hours; one host restarts its counter."""
    rows = events(spark, d).groupBy("host", F.floor(F.col("s") / 21_600).alias("t")).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "reject").alias("failed"))
    from pyspark.sql import Window

    upto = Window.partitionBy("host", F.expr("case when host = 'host3' then floor(t / 20) else 0 end")).orderBy("t")
    return rows.select("host", "t", F.sum("events").over(upto).alias("events"), F.sum("failed").over(upto).alias("failed"))


_COUNTERS = f"""{EV}, per AS (SELECT host, s // 21600 AS t, count(*) AS events, count(*) FILTER (kind = 'reject') AS failed FROM ev GROUP BY 1, 2),
counters AS (SELECT host, t, (sum(events) OVER w)::BIGINT AS events, (sum(failed) OVER w)::BIGINT AS failed FROM per
  WINDOW w AS (PARTITION BY host, CASE WHEN host = 'host3' THEN t // 20 ELSE 0 END ORDER BY t)),
deltas AS (SELECT host, t, t - lag(t) OVER v AS dt, greatest(events - lag(events) OVER v, 0) AS d_events, greatest(failed - lag(failed) OVER v, 0) AS d_failed
  FROM counters WINDOW v AS (PARTITION BY host ORDER BY t))"""


def counter_rates(spark, d):
    return windows.rates(_counters(spark, d), ["host"], "t", ["events", "failed"]).select("host", "t", "dt", "d_events", "d_failed")


BUDGET_EVENTS, BUDGET_PART = 5, 2


def error_budget(spark, d):
    """Sweeps in which at least half of the frames failed, of those with enough frames."""
    rows = windows.rates(_counters(spark, d), ["host"], "t", ["events", "failed"])
    return rows.filter((F.col("d_events") >= BUDGET_EVENTS) & (F.col("d_failed") * BUDGET_PART >= F.col("d_events"))).select("host", "t", "d_events", "d_failed")


def ewma_rate(spark, d):
    rows = windows.rates(_counters(spark, d), ["host"], "t", ["events"])
    out = windows.decayed_rate(rows.withColumn("r", F.col("d_events") / F.col("dt")), ["host"], "t", "dt", "r", 15.0)
    return out.select("host", F.round("rate", 4).alias("rate"))


def latency_quantiles(spark, d):
    """Exact quantiles of an event's value, which stands for its latency."""
    rows = events(spark, d).withColumn("lat", F.floor(F.col("value") * 1000).cast("long"))
    return windows.quantile_rows(rows, ["host"], "lat", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).join(rows.groupBy("host").agg(F.max("lat").alias("max"), F.count("*").alias("n")), "host")


def signed_percentiles(spark, d):
    rows = events(spark, d).withColumn("x", F.floor((F.col("value") - 20) * 1000).cast("long"))
    return windows.indexed_quantiles(rows, ["kind"], "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99, "p999": 0.999})


BUCKETS = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 100_000]


def _histogram(spark, d):
    le = F.element_at(F.filter(F.array(*(F.lit(b) for b in BUCKETS)), lambda b: b >= F.col("value")), 1)
    return events(spark, d).groupBy("kind", le.alias("le")).agg(F.count("*").alias("n"))


_HISTOGRAM = f"""{EV}, {sql_values("edges", [(b,) for b in BUCKETS], "le")},
hist AS (SELECT kind, le, count(*) AS n FROM (SELECT kind, (SELECT min(le) FROM edges WHERE le >= value) AS le FROM ev) GROUP BY 1, 2)"""


def bucket_quantile(spark, d):
    out = windows.bucket_quantile(_histogram(spark, d), ["kind"], 0.5)
    return out.select("kind", F.col("total").cast("long").alias("total"), F.round("value", 3).alias("value"))


def histogram_merge(spark, d):
    """Histograms of every host added up by kind, with cumulative counts."""
    from pyspark.sql import Window

    rows = _histogram(spark, d)
    return rows.select("kind", F.col("le").cast("long").alias("le"), F.sum("n").over(Window.partitionBy("kind").orderBy("le")).alias("upto"))


def scrape_quantile(spark, d):
    """Median by upper bound of what two scrapes of cumulative buckets differ by."""
    from pyspark.sql import Window

    half = events(spark, d).withColumn("late", F.col("event_id") % 2)
    le = F.element_at(F.filter(F.array(*(F.lit(b) for b in BUCKETS)), lambda b: b >= F.col("value")), 1)
    second = half.groupBy("kind", le.alias("le")).agg(F.count("*").alias("b"), F.count_if(F.col("late") == 0).alias("a"))
    w = Window.partitionBy("kind")
    diff = second.withColumn("d", F.col("b") - F.col("a"))
    cum = diff.withColumn("upto", F.sum("d").over(w.orderBy("le"))).withColumn("total", F.sum("d").over(w))
    return cum.filter(F.col("upto") * 2 >= F.col("total")).groupBy("kind").agg(F.min("le").cast("long").alias("le"), F.max("total").alias("total"))


def per_second_rates(spark, d):
    """Distribution of events an hour, empty hours included."""
    rows = events(spark, d).withColumn("all", F.lit("all")).withColumn("h", F.floor(F.col("s") / 3600))
    every = windows.seconds_of(rows, ["all"], "h", {"n": F.count("*")})
    return windows.indexed_quantiles(every, ["all"], "n", {"p50": 0.5, "p99": 0.99}).select(F.col("n").alias("hours"), "p50", "p99")


QUERIES = {f.__name__: f for f in (signal_trips, sliding_estimate, signal_topk, rolling_rate, reject_ratio, counter_rates, error_budget, ewma_rate, latency_quantiles, signed_percentiles, bucket_quantile, histogram_merge, scrape_quantile, per_second_rates)}

SQL = {
    "signal_trips": f"WITH {SIGNALS_SQL} SELECT rule, key, win, lim::BIGINT AS \"limit\", event_id, s, numerator FROM num WHERE lim > 0 AND numerator >= lim * width QUALIFY row_number() OVER (PARTITION BY rule, key, win ORDER BY event_id) = 1",
    "sliding_estimate": f"WITH {SIGNALS_SQL} SELECT rule, key, event_id, cur, prev, numerator FROM num",
    "signal_topk": f"""WITH {SIGNALS_SQL}, now_ AS (SELECT max(s) AS a FROM ev),
      st AS (SELECT rule, key, width, sum(CASE WHEN win = a // width * width THEN width ELSE width - (a - a // width * width) END)::BIGINT AS numerator FROM sig, now_ WHERE win >= a // width * width - width GROUP BY 1, 2, 3)
      SELECT rule, key, numerator, row_number() OVER (PARTITION BY rule ORDER BY numerator / width DESC, key) AS rank FROM st QUALIFY rank <= 10""",
    "rolling_rate": f"WITH {_DAYS} SELECT host, t, (sum(events) OVER (PARTITION BY host ORDER BY t ROWS 9 PRECEDING))::BIGINT AS events_10 FROM days",
    "reject_ratio": f"""WITH {_DAYS}, r AS (SELECT host, t, (sum(events) OVER w)::BIGINT AS e, (sum(rejects) OVER w)::BIGINT AS r FROM days WINDOW w AS (PARTITION BY host ORDER BY t ROWS 59 PRECEDING))
      SELECT host, t, e, r, CASE WHEN e > 0 THEN r * 1000000 // e ELSE 0 END AS ppm FROM r""",
    "counter_rates": f"WITH {_COUNTERS} SELECT host, t, dt, d_events, d_failed FROM deltas WHERE dt IS NOT NULL",
    "error_budget": f"WITH {_COUNTERS} SELECT host, t, d_events, d_failed FROM deltas WHERE dt IS NOT NULL AND d_events >= {BUDGET_EVENTS} AND d_failed * {BUDGET_PART} >= d_events",
    "ewma_rate": f"""WITH {_COUNTERS}, s AS (SELECT host, t, dt, d_events / dt AS r, max(t) OVER (PARTITION BY host) AS last FROM deltas WHERE dt IS NOT NULL)
      SELECT host, round(sum((1 - exp(-dt / 15.0)) * exp(-(last - t) / 15.0) * r) / sum((1 - exp(-dt / 15.0)) * exp(-(last - t) / 15.0)), 4) AS rate FROM s GROUP BY host""",
    "latency_quantiles": f"WITH {EV}, r AS (SELECT host, floor(value * 1000)::BIGINT AS lat FROM ev) SELECT host, quantile_disc(lat, 0.5) AS p50, quantile_disc(lat, 0.9) AS p90, quantile_disc(lat, 0.99) AS p99, max(lat) AS max, count(*) AS n FROM r GROUP BY host",
    "signed_percentiles": f"""WITH {EV}, r AS (SELECT kind, floor((value - 20) * 1000)::BIGINT AS x FROM ev), l AS (SELECT kind, list(x ORDER BY x) AS l, count(*) AS n FROM r GROUP BY kind)
      SELECT kind, n, l[1 + floor((n - 1) * 0.1 + 0.5)::BIGINT] AS p10, l[1 + floor((n - 1) * 0.5 + 0.5)::BIGINT] AS p50, l[1 + floor((n - 1) * 0.99 + 0.5)::BIGINT] AS p99, l[1 + floor((n - 1) * 0.999 + 0.5)::BIGINT] AS p999 FROM l""",
    "bucket_quantile": f"""WITH {_HISTOGRAM}, c AS (SELECT kind, le, n, sum(n) OVER (PARTITION BY kind ORDER BY le) AS upto, sum(n) OVER (PARTITION BY kind) AS total, coalesce(lag(le) OVER (PARTITION BY kind ORDER BY le), 0) AS lower FROM hist)
      SELECT kind, total::BIGINT AS total, round(lower + (le - lower) * ((total * 0.5::DOUBLE - (upto - n)) / n), 3) AS value FROM c WHERE upto >= total * 0.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY kind ORDER BY le) = 1""",
    "histogram_merge": f"WITH {_HISTOGRAM} SELECT kind, le::BIGINT AS le, (sum(n) OVER (PARTITION BY kind ORDER BY le))::BIGINT AS upto FROM hist",
    "scrape_quantile": f"""WITH {EV}, {sql_values("edges", [(b,) for b in BUCKETS], "le")},
      h AS (SELECT kind, (SELECT min(le) FROM edges WHERE le >= value) AS le, event_id % 2 AS odd FROM ev), g AS (SELECT kind, le, count(*) FILTER (odd = 1) AS d FROM h GROUP BY 1, 2),
      c AS (SELECT kind, le, sum(d) OVER (PARTITION BY kind ORDER BY le) AS upto, sum(d) OVER (PARTITION BY kind) AS total FROM g)
      SELECT kind, min(le)::BIGINT AS le, max(total)::BIGINT AS total FROM c WHERE upto * 2 >= total GROUP BY kind""",
    "per_second_rates": f"""WITH {EV}, h AS (SELECT s // 3600 AS h, count(*) AS n FROM ev GROUP BY 1), e AS (SELECT unnest(range((SELECT min(h) FROM h), (SELECT max(h) FROM h) + 1)) AS h),
      f AS (SELECT coalesce(n, 0) AS n FROM e LEFT JOIN h USING (h)), l AS (SELECT list(n ORDER BY n) AS l, count(*) AS c FROM f)
      SELECT c AS hours, l[1 + floor((c - 1) * 0.5 + 0.5)::BIGINT] AS p50, l[1 + floor((c - 1) * 0.99 + 0.5)::BIGINT] AS p99 FROM l""",
}
