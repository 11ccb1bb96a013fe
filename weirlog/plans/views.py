"""Listings, facets, cases, tails, pages and document diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirlog.operators import views
from weirlog.operators.views import HostQuery
from weirlog.plans.fixtures import EV, events
from weirlog.session import table


def _hosts(spark, d):
    """A host row for each customer."""
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.col("c_name").alias("host"), F.element_at(F.array(F.lit("connected"), F.lit("throttled"), F.lit("backpressure"), F.lit("offline")), (c % 4 + 1).cast("int")).alias("status"), F.col("c_mktsegment").alias("tier"),
        F.when(c % 6 == 0, F.lit(None)).when(c % 6 == 1, F.lit("crawl:a")).when(c % 6 == 2, F.lit("crawl:b")).otherwise(F.lit("seed")).alias("source"), (c % 100).alias("accounts"), (c % 3 * 60).alias("max_accounts"),
        F.when(c % 10 == 0, c % 7).otherwise(0).alias("throttled_accounts"), (F.floor("c_acctbal") * 10).cast("double").alias("lag_ms"), ((c % 13) / 100.0).alias("error_rate"), (c % 50).cast("double").alias("events_per_sec"), (c * 7 % 1000).alias("last_seq"), (c * 31 % 977).alias("since"), (c % 5).alias("rule"),
    )


HOSTS_SQL = """h AS (SELECT c_name AS host, (['connected', 'throttled', 'backpressure', 'offline'])[c_custkey % 4 + 1] AS status, c_mktsegment AS tier, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'crawl:a' WHEN 2 THEN 'crawl:b' ELSE 'seed' END AS source,
  c_custkey % 100 AS accounts, c_custkey % 3 * 60 AS max_accounts, CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 7 ELSE 0 END AS throttled_accounts, floor(c_acctbal) * 10 AS lag_ms, (c_custkey % 13) / 100.0::DOUBLE AS error_rate, (c_custkey % 50)::DOUBLE AS events_per_sec, c_custkey * 7 % 1000 AS last_seq, c_custkey * 31 % 977 AS since, c_custkey % 5 AS rule FROM customer)"""
_SHOWN = ["host", "status", "tier", "source", "accounts", "events_per_sec", "total"]


def host_list_filtered(spark, d):
    """Several filtered listings, each named."""
    asked = {"q": HostQuery(q="00013"), "tier": HostQuery(tier="BUILDING", status="connected"), "prefix": HostQuery(source="crawl*"), "colon": HostQuery(source="crawl:", rule=2), "none": HostQuery(source="none", throttled=True), "exact": HostQuery(source="seed", flag="erroring"), "cap": HostQuery(flag="atCap"), "lag": HostQuery(flag="lagging"), "either": HostQuery(flag="throttledOrAtCap", tier="MACHINERY")}
    rows, out = _hosts(spark, d), None
    for name, q in asked.items():
        part = rows.filter(q.condition()).select(F.lit(name).alias("query"), "host")
        out = part if out is None else out.union(part)
    return out


def host_list_page(spark, d):
    """Pages in several orders; descending turns ties around too."""
    rows, out = _hosts(spark, d), None
    for name, q in {"default": HostQuery(limit=15, offset=5), "events": HostQuery(sort="events", desc=True, limit=20), "source": HostQuery(sort="source", limit=12), "accounts": HostQuery(sort="accounts", desc=True, offset=10, limit=10, flag="atCap")}.items():
        part = q.run(rows).select(F.lit(name).alias("query"), "host", "total")
        out = part if out is None else out.union(part)
    return out


def host_flags(spark, d):
    return _hosts(spark, d).select("host", *(c.alias(k) for k, c in views.flags().items()))


def _cases(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 20).alias("host"))


def case_facets(spark, d):
    """Counts by status ignoring the status filter, by kind ignoring the kind filter."""
    return views.facets(_cases(spark, d), {"status": F.col("status") == "O", "kind": F.col("kind").isin("1-URGENT", "2-HIGH")})


def case_list(spark, d):
    """Cases by severity, then newest."""
    rows = _cases(spark, d).withColumn("severity", 5 - F.substring("kind", 1, 1).cast("int"))
    return rows.filter("status = 'O'").orderBy(F.col("severity").desc(), F.col("id").desc()).offset(10).limit(25).select("id", "severity", "host")


def case_sessions(spark, d):
    """Rejects are trips of a host's case; an identity event whose number divides by 50 closes it."""
    e = events(spark, d).select("host", F.col("s").alias("at"), F.col("event_id").alias("id"), (F.col("k") % 4).alias("severity"), F.floor("value").alias("observed"), "kind")
    return views.case_sessions(e.filter("kind = 'reject'"), e.filter("kind = 'identity' AND id % 50 = 0"), ["host"])


def tail_merge(spark, d):
    """Rejects and passed events of one host after a time, newest first."""
    e = events(spark, d).filter("host = 'host3'").select(F.col("event_id").alias("id"), F.col("s").alias("at"), "kind")
    rejects, passed = (e.filter(c).withColumn("log", F.lit(n)) for c, n in (("kind = 'reject'", "reject"), ("kind = 'commit'", "passed")))
    return views.tail([rejects, passed], 1_705_000_000, 150)


def tail_sample(spark, d):
    """At most two events of an hour, the newest 300 of these."""
    e = events(spark, d).withColumn("hour", F.floor(F.col("s") / 3600))
    return views.sampled_tail(e, "hour", "event_id", 2, 300).select("event_id", "hour")


def keyset_page(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 16).alias("slot"), F.col("c_name").alias("host"))
    return views.keyset_page(rows, ["slot", "host"], (7, "Customer#000000600"), 40)


def last_evidence(spark, d):
    e = events(spark, d).filter("kind = 'reject'").select("host", "event_id", "s")
    return views.last_of_each(e, ["host"], ["event_id"], 20)


def handle_search(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("handle"))
    a, b = views.handle_search(rows, "Customer#000000012", 30), views.handle_search(rows, "customer#00000010*", 30)
    return a.select(F.lit("exact").alias("asked"), "handle").union(b.select(F.lit("star"), "handle"))


def settings_redacted(spark, d):
    n = table(spark, d, "nation")
    rows = n.select(F.concat(F.lower("n_name"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("_token")).when(F.col("n_nationkey") % 3 == 1, F.lit("_key")).otherwise(F.lit("_dir"))).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.col("n_name")).alias("value"))
    return views.redacted(rows)


def document_diff(spark, d):
    """Two versions of a document of every customer, leaf by leaf."""
    c = table(spark, d, "customer")
    leaf = lambda path, v: F.struct(F.lit(path).alias("path"), v.cast("string").alias("value"))
    k = F.col("c_custkey")
    before = c.select("c_custkey", F.explode(F.array(leaf("limits.eps", k % 7), leaf("limits.cap", k % 5), leaf("tier", F.col("c_mktsegment")))).alias("x")).select("c_custkey", "x.path", "x.value").filter("path <> 'limits.cap' OR c_custkey % 20 = 0")
    after = c.select("c_custkey", F.explode(F.array(leaf("limits.eps", k % 14 % 7), leaf("limits.cap", k % 5), leaf("tier", F.concat(F.col("c_mktsegment"), F.when(k % 30 == 0, F.repeat(F.lit("!"), F.lit(90))).otherwise(F.lit("")))))).alias("x")).select("c_custkey", "x.path", "x.value").filter("path <> 'tier' OR c_custkey % 50 <> 0")
    return views.leaf_diff(before, after, ["c_custkey"])


def public_projection(spark, d):
    """What the public may see of a host: named columns only."""
    return _hosts(spark, d).filter("status = 'connected'").select("host", "status", "accounts")


def tier_counts(spark, d):
    return _hosts(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "connected").alias("live"))


QUERIES = {f.__name__: f for f in (host_list_filtered, host_list_page, host_flags, case_facets, case_list, case_sessions, tail_merge, tail_sample, keyset_page, last_evidence, handle_search, settings_redacted, document_diff, public_projection, tier_counts)}

_CAP = "(max_accounts > 0 AND accounts >= max_accounts)"
_PAGES = {
    "default": ("true", "host", 5, 15), "events": ("true", "events_per_sec DESC, host DESC", 0, 20), "source": ("true", "source NULLS FIRST, host", 0, 12), "accounts": (_CAP, "accounts DESC, host DESC", 10, 10),
}
_FILTERS = {
    "q": "contains(host, '00013')", "tier": "tier = 'BUILDING' AND status = 'connected'", "prefix": "starts_with(coalesce(source, ''), 'crawl')", "colon": "starts_with(coalesce(source, ''), 'crawl:') AND rule = 2", "none": "source IS NULL AND throttled_accounts > 0",
    "exact": "source = 'seed' AND error_rate > 0.1", "cap": _CAP, "lag": "status <> 'offline' AND lag_ms > 60000", "either": f"(throttled_accounts > 0 OR {_CAP}) AND tier = 'MACHINERY'",
}
_CASES = "c AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS kind, o_custkey % 20 AS host FROM orders)"
SQL = {
    "host_list_filtered": f"WITH {HOSTS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS query, host FROM h WHERE {v}" for k, v in _FILTERS.items()),
    "host_list_page": f"WITH {HOSTS_SQL} " + " UNION ALL ".join(f"(SELECT '{k}' AS query, host, (SELECT count(*) FROM h WHERE {w}) AS total FROM h WHERE {w} ORDER BY {o} LIMIT {n} OFFSET {s})" for k, (w, o, s, n) in _PAGES.items()),
    "host_flags": f"WITH {HOSTS_SQL} SELECT host, {_CAP} AS \"atCap\", status <> 'offline' AND lag_ms > 60000 AS lagging, error_rate > 0.1 AS erroring, throttled_accounts > 0 OR {_CAP} AS \"throttledOrAtCap\" FROM h",
    "case_facets": f"WITH {_CASES} SELECT 'status' AS facet, status AS value, count(*) AS n FROM c WHERE kind IN ('1-URGENT', '2-HIGH') GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM c WHERE status = 'O' GROUP BY 2",
    "case_list": f"WITH {_CASES} SELECT id, (5 - substr(kind, 1, 1)::INTEGER)::INTEGER AS severity, host FROM c WHERE status = 'O' ORDER BY severity DESC, id DESC LIMIT 25 OFFSET 10",
    "case_sessions": f"""WITH {EV}, r AS (SELECT host, s AS t_, event_id AS id, k % 4 AS severity, floor(value)::BIGINT AS observed, 0 AS close FROM ev WHERE kind = 'reject' UNION ALL SELECT host, s, event_id, NULL, NULL, 1 FROM ev WHERE kind = 'identity' AND event_id % 50 = 0),
      t AS (SELECT *, coalesce(sum(close) OVER (PARTITION BY host ORDER BY t_, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM r)
      SELECT host, min(t_) FILTER (close = 0) AS opened, max(t_) FILTER (close = 0) AS updated, max(severity) AS severity, count(*) FILTER (close = 0) AS trips, arg_max(observed, id) FILTER (close = 0) AS observed,
        CASE WHEN max(close) = 1 THEN 'resolved' ELSE 'open' END AS status, least(count(*) FILTER (close = 0), 20) AS evidence FROM t GROUP BY host, n HAVING count(*) FILTER (close = 0) > 0""",
    "tail_merge": f"WITH {EV} SELECT event_id AS id, s AS \"at\", kind, CASE kind WHEN 'reject' THEN 'reject' ELSE 'passed' END AS log FROM ev WHERE host = 'host3' AND kind IN ('reject', 'commit') AND s > 1705000000 ORDER BY s DESC, event_id DESC LIMIT 150",
    "tail_sample": f"WITH {EV}, t AS (SELECT event_id, s // 3600 AS hour FROM ev QUALIFY row_number() OVER (PARTITION BY s // 3600 ORDER BY event_id) <= 2) SELECT * FROM t ORDER BY event_id DESC LIMIT 300",
    "keyset_page": "SELECT c_custkey % 16 AS slot, c_name AS host FROM customer WHERE (c_custkey % 16, c_name) > (7, 'Customer#000000600') ORDER BY 1, 2 LIMIT 40",
    "last_evidence": f"WITH {EV} SELECT host, event_id, s FROM ev WHERE kind = 'reject' QUALIFY row_number() OVER (PARTITION BY host ORDER BY event_id DESC) <= 20",
    "handle_search": "SELECT 'exact' AS asked, lower(c_name) AS handle FROM customer WHERE lower(c_name) = 'customer#000000012' UNION ALL (SELECT 'star', lower(c_name) FROM customer WHERE starts_with(lower(c_name), 'customer#00000010') ORDER BY 2 LIMIT 30)",
    "settings_redacted": "SELECT lower(n_name) || (['_token', '_key', '_dir'])[n_nationkey % 3 + 1] AS name, CASE WHEN n_nationkey % 3 < 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'unset' ELSE 'set' END WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS value FROM nation",
    "document_diff": """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m FROM customer),
      b AS (SELECT k, 'limits.eps' AS path, (k % 7)::VARCHAR AS v FROM c UNION ALL SELECT k, 'limits.cap', (k % 5)::VARCHAR FROM c WHERE k % 20 = 0 UNION ALL SELECT k, 'tier', m FROM c),
      a AS (SELECT k, 'limits.eps' AS path, (k % 14 % 7)::VARCHAR AS v FROM c UNION ALL SELECT k, 'limits.cap', (k % 5)::VARCHAR FROM c UNION ALL SELECT k, 'tier', m || CASE WHEN k % 30 = 0 THEN repeat('!', 90) ELSE '' END FROM c WHERE k % 50 <> 0),
      f AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.path, b.path) AS path, CASE WHEN length(a.v) > 80 THEN substr(a.v, 1, 80) || '…' ELSE a.v END AS av, CASE WHEN length(b.v) > 80 THEN substr(b.v, 1, 80) || '…' ELSE b.v END AS bv FROM b FULL JOIN a ON a.k = b.k AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v)
      SELECT k AS c_custkey, path, CASE WHEN bv IS NULL THEN path || ': added ' || av WHEN av IS NULL THEN path || ': removed ' || bv ELSE path || ': ' || bv || ' -> ' || av END AS line FROM f""",
    "public_projection": f"WITH {HOSTS_SQL} SELECT host, status, accounts FROM h WHERE status = 'connected'",
    "tier_counts": f"WITH {HOSTS_SQL} SELECT tier, count(*) AS n, count(*) FILTER (status = 'connected') AS live FROM h GROUP BY tier",
}
