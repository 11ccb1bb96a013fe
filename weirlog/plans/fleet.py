"""Roll-ups over nodes, histories, ownership, merges, change feeds, account moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirlog.operators import rollup
from weirlog.plans.fixtures import EV, events, sql_values, values
from weirlog.plans.views import HOSTS_SQL, _hosts
from weirlog.session import table

MEMBERS = [("n0", "leader", False, True), ("n1", "core", False, True), ("n2", "core", True, False), ("n3", "core", False, True)]
_MEMBERS_SQL = sql_values("members", MEMBERS, "node, role, stale, healthy")


def _members(spark):
    return values(spark, MEMBERS, "node string, role string, stale boolean, healthy boolean")


def _samples(spark, d):
    """A sample of each node and hour: events and bytes as rates, the slowest event as lag."""
    e = events(spark, d).withColumn("node", F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string"))).withColumn("t", F.floor(F.col("s") / 3600))
    return e.groupBy("node", "t").agg(F.count("*").alias("events"), F.sum(F.floor("value")).alias("bytes"), F.max(F.floor(F.col("value") * 1000)).alias("lag"), F.max("event_id").alias("seq"))


_SAMPLES = f"""{EV}, {_MEMBERS_SQL}, samples AS (SELECT 'n' || (user_id % 4) AS node, s // 3600 AS t, count(*) AS events, sum(floor(value))::BIGINT AS bytes, max(floor(value * 1000))::BIGINT AS lag, max(event_id) AS seq FROM ev GROUP BY 1, 2)"""


def fleet_overview(spark, d):
    reports = rollup.node_reports(_samples(spark, d), ["node"], ["events", "bytes"], ["lag", "seq"]).join(_members(spark), "node", "right")
    return rollup.fleet_overview(reports, ["events", "bytes"], ["lag"], "seq")


def history_merge(spark, d):
    """Node histories of different lengths: the newest 300 hours of n0, 200 of the others."""
    from weirlog.operators.windows import ranked

    rows = ranked(_samples(spark, d), ["node"], [F.col("t").desc()], 300).filter("node = 'n0' OR rank <= 200").drop("rank")
    return rollup.merge_history(rows, "node", "t", ["events", "bytes"], ["lag"])


def fleet_health(spark, d):
    return rollup.health(_members(spark))


def host_owner_rows(spark, d):
    hosts = _hosts(spark, d).select("host", "accounts", "status")
    owners = table(spark, d, "customer").select(F.col("c_name").alias("host"), F.concat(F.lit("n"), (F.col("c_custkey") % 4).cast("string")).alias("node")).filter("host <> 'Customer#000000100'")
    theirs = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("n"), (F.col("c_custkey") % 5).cast("string")).alias("node"), F.col("c_name").alias("host"), (F.col("c_custkey") % 140).alias("accounts"), F.lit("theirs").alias("status"))
    return rollup.owner_rows(hosts, owners, theirs)


OPS = ["get", "put", "list", "delete", "head", "mpu_abort", "get_range", "copy"]


def request_classes(spark, d):
    op = F.element_at(F.array(*(F.lit(o) for o in OPS)), (F.col("k") % len(OPS) + 1).cast("int"))
    rows = events(spark, d).groupBy(F.col("kind").alias("purpose"), op.alias("op")).agg(F.count("*").alias("n"))
    return rollup.request_classes(rows, "purpose")


def reject_top(spark, d):
    rows = events(spark, d).filter("kind = 'reject'").withColumn("node", F.concat(F.lit("n"), (F.col("k") % 3).cast("string"))).groupBy("node", F.col("user_id").alias("host")).agg(F.count_if(F.col("s") > 1_706_000_000).alias("rate"), F.count("*").alias("total"), F.max("s").alias("at"), F.max_by("event_id", "s").alias("sample"))
    return rollup.top_rejects(rows, "host", 25)


def newest_wins(spark, d):
    """The latest order of each customer, a larger number winning ties."""
    o = table(spark, d, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"), "o_orderkey", "o_orderstatus")
    return rollup.newest(o, ["o_custkey"], ["day", "o_orderkey"], ["o_orderstatus"])


def cursor_max_merge(spark, d):
    """Each day's log entry carries a map of host cursors; the largest of each host."""
    e = events(spark, d).groupBy(F.floor(F.col("s") / 86_400).alias("day"), "host").agg(F.max(F.col("event_id") * 7 % 5000).alias("c"))
    maps = e.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("host", "c"))).alias("cursors"))
    return rollup.largest_cursors(maps, "cursors")


def host_upsert(spark, d):
    base = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("host"), F.col("c_mktsegment").alias("tier"), F.when(F.col("c_custkey") % 4 == 0, "x").alias("extra"), F.when(F.col("c_custkey") % 6 == 0, "seed").alias("source"), F.lit("n1").alias("owner"), F.col("c_custkey").alias("cursor"))
    sent = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("host"), F.when(F.col("c_custkey") % 9 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("tier"), F.when(F.col("c_custkey") % 12 == 0, "x").alias("extra"), F.lit("crawl").alias("source"))
    return rollup.upsert_hosts(base, sent)


def cluster_ownership(spark, d):
    hosts = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("n"), (F.col("c_custkey") % 5).cast("string"))).alias("owner"))
    return rollup.ownership(hosts, _members(spark))


def host_assignment(spark, d):
    return rollup.rendezvous(table(spark, d, "customer").select(F.col("c_name").alias("host")), _members(spark).filter("healthy"))


def host_rebalance(spark, d):
    """One round after a member joined without hosts."""
    hosts = table(spark, d, "customer").select(F.col("c_name").alias("host"), F.concat(F.lit("n"), (F.col("c_custkey") % 3).cast("string")).alias("owner"))
    return rollup.rebalance_moves(hosts, ["n0", "n1", "n2", "n3"]).orderBy("step").select("host", "owner")


def account_moves(spark, d):
    """Users that write from one host, then another: the host is the day's."""
    e = events(spark, d).filter("kind IN ('commit', 'account')").select("user_id", "event_id", F.concat(F.lit("host"), (F.col("user_id") % 3 + F.floor(F.col("s") / 864_000) % 2).cast("string")).alias("host"))
    return rollup.moves(e, "user_id", ["event_id"])


def change_detect(spark, d):
    e = events(spark, d).select("user_id", "event_id", "kind", (F.col("k") % 3).alias("state"))
    return rollup.changes(e, ["user_id"], "event_id", ["kind", "state"])


def coalesce_touches(spark, d):
    """Touches by hour, kind and node; above five ids one event stands for all."""
    e = events(spark, d).select(F.floor(F.col("s") / 7200).alias("flush"), "kind", F.lit("n0").alias("node"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("at"), F.col("event_id").alias("version"))
    return rollup.coalesce_touches(e, 5)


def change_feed(spark, d):
    e = events(spark, d).select((F.col("event_id") + 1).alias("n"), "kind")
    return rollup.resume_feed(e, 9_900, 4_096).unionByName(rollup.resume_feed(e, 5, 4_096))


def distinct_accounts(spark, d):
    return events(spark, d).groupBy("host").agg(F.countDistinct("user_id").alias("accounts"), F.count_if(F.col("kind") == "reject").alias("failed"), F.count("*").alias("events"))


def top_hosts(spark, d):
    rows = _hosts(spark, d)
    return rows.orderBy(F.col("events_per_sec").desc(), "host").limit(10).select("host", "events_per_sec")


QUERIES = {f.__name__: f for f in (fleet_overview, history_merge, fleet_health, host_owner_rows, request_classes, reject_top, newest_wins, cursor_max_merge, host_upsert, cluster_ownership, host_assignment, host_rebalance, account_moves, change_detect, coalesce_touches, change_feed, distinct_accounts, top_hosts)}

_OPS_SQL = "[" + ", ".join(f"'{o}'" for o in OPS) + "]"
SQL = {
    "fleet_overview": f"""WITH {_SAMPLES}, r AS (SELECT m.node, stale, sum(events) AS events, sum(bytes) AS bytes, max(lag) AS lag, max(seq) AS seq FROM members m LEFT JOIN samples USING (node) GROUP BY 1, 2)
      SELECT coalesce(sum(events) FILTER (NOT stale), 0)::BIGINT AS events, coalesce(sum(bytes) FILTER (NOT stale), 0)::BIGINT AS bytes, coalesce(max(lag) FILTER (NOT stale), 0)::BIGINT AS lag, max(seq) FILTER (NOT stale) AS seq, count(*) FILTER (NOT stale) AS answered, count(*) AS members FROM r""",
    "history_merge": f"""WITH {_SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t DESC) AS n FROM samples QUALIFY n <= CASE node WHEN 'n0' THEN 300 ELSE 200 END), m AS (SELECT t, sum(events)::BIGINT AS events, sum(bytes)::BIGINT AS bytes, max(lag) AS lag FROM k GROUP BY t)
      SELECT * FROM m ORDER BY t DESC LIMIT (SELECT max(c) FROM (SELECT count(*) AS c FROM k GROUP BY node))""",
    "fleet_health": f"WITH {_MEMBERS_SQL} SELECT count(*) FILTER (NOT stale) AS up, count(*) AS all, bool_or(role = 'leader' AND NOT stale) AS leader, 'ok' AS health FROM members".replace(" AS all,", ' AS "all",'),
    "host_owner_rows": f"""WITH {HOSTS_SQL}, o AS (SELECT c_name AS host, 'n' || (c_custkey % 4) AS node FROM customer WHERE c_name <> 'Customer#000000100'), t AS (SELECT 'n' || (c_custkey % 5) AS node, c_name AS host, c_custkey % 140 AS a FROM customer WHERE c_custkey % 3 = 0)
      SELECT h.host, o.node, CASE WHEN t.a IS NOT NULL THEN greatest(t.a, accounts) ELSE accounts END AS accounts, CASE WHEN t.a IS NOT NULL THEN 'theirs' ELSE status END AS status FROM h LEFT JOIN o USING (host) LEFT JOIN t ON t.host = h.host AND t.node = o.node""",
    "request_classes": f"""WITH {EV}, c AS (SELECT kind, ({_OPS_SQL})[k % 8 + 1] AS op FROM ev), b AS (SELECT kind, CASE WHEN op IN ('get', 'get_range', 'head') THEN 'b' WHEN op IN ('delete', 'mpu_abort') THEN 'free' ELSE 'a' END AS class FROM c)
      SELECT coalesce(kind, 'total') AS purpose, count(*) FILTER (class = 'a') AS a, count(*) FILTER (class = 'b') AS b, count(*) FILTER (class = 'free') AS free FROM b GROUP BY ROLLUP (kind)""",
    "reject_top": f"""WITH {EV}, n AS (SELECT 'n' || (k % 3) AS node, user_id AS host, count(*) FILTER (s > 1706000000) AS rate, count(*) AS total, max(s) AS t_, arg_max(event_id, s) AS sample FROM ev WHERE kind = 'reject' GROUP BY 1, 2)
      SELECT host, sum(rate)::BIGINT AS rate, sum(total)::BIGINT AS total, max(t_) AS "at", arg_max(sample, (t_, node)) AS sample FROM n GROUP BY host ORDER BY rate DESC, total DESC, host LIMIT 25""",
    "newest_wins": "SELECT o_custkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS day, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) = 1",
    "cursor_max_merge": f"WITH {EV} SELECT host, max(event_id * 7 % 5000) AS cursor FROM ev GROUP BY host",
    "host_upsert": """WITH b AS (SELECT c_custkey AS host, c_mktsegment AS tier, CASE WHEN c_custkey % 4 = 0 THEN 'x' END AS extra, CASE WHEN c_custkey % 6 = 0 THEN 'seed' END AS source, c_custkey AS cursor FROM customer WHERE c_custkey % 2 = 0),
      s AS (SELECT c_custkey AS host, CASE WHEN c_custkey % 9 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS tier, CASE WHEN c_custkey % 12 = 0 THEN 'x' END AS extra FROM customer WHERE c_custkey % 3 = 0)
      SELECT coalesce(b.host, s.host) AS host, coalesce(s.tier, b.tier) AS tier, CASE WHEN s.host IS NOT NULL THEN s.extra ELSE b.extra END AS extra, coalesce(b.source, CASE WHEN s.host IS NOT NULL THEN 'crawl' END) AS source, CASE WHEN b.host IS NOT NULL THEN 'n1' END AS owner, coalesce(b.cursor, 0) AS cursor,
        s.host IS NOT NULL AND (b.host IS NULL OR s.tier <> b.tier OR s.extra IS DISTINCT FROM b.extra OR b.source IS NULL) AS changed FROM b FULL JOIN s ON b.host = s.host""",
    "cluster_ownership": "SELECT CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 5 IN (0, 1, 3) THEN 'n' || (c_custkey % 5) ELSE 'unowned' END AS owner, count(*) AS hosts FROM customer GROUP BY 1",
    "host_assignment": f"WITH {_MEMBERS_SQL} SELECT c_name AS host, node FROM customer, members WHERE healthy QUALIFY row_number() OVER (PARTITION BY c_name ORDER BY sha256(node || '/' || c_name) DESC) = 1",
    "account_moves": f"""WITH {EV}, a AS (SELECT user_id, event_id, 'host' || (user_id % 3 + s // 864000 % 2) AS host FROM ev WHERE kind IN ('commit', 'account')), b AS (SELECT host, lag(host) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM a), c AS (SELECT * FROM b WHERE was IS NULL OR was <> host)
      SELECT h AS host, sum(d)::BIGINT AS accounts FROM (SELECT host AS h, 1 AS d FROM c UNION ALL SELECT was, -1 FROM c WHERE was IS NOT NULL) GROUP BY h""",
    "change_detect": f"WITH {EV}, a AS (SELECT user_id, event_id, kind, k % 3 AS state, lag(kind || '/' || (k % 3)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ev) SELECT user_id, event_id, kind, state FROM a WHERE p IS DISTINCT FROM kind || '/' || state",
    "coalesce_touches": f"""WITH {EV}, l AS (SELECT s // 7200 AS flush, kind, user_id::VARCHAR AS id, max(event_id) AS version FROM ev GROUP BY 1, 2, 3), g AS (SELECT *, count(*) OVER (PARTITION BY flush, kind) AS n, max(version) OVER (PARTITION BY flush, kind) AS top FROM l)
      SELECT flush, kind, 'n0' AS node, id, version FROM g WHERE n <= 5 UNION ALL SELECT DISTINCT flush, kind, 'n0', '*', top FROM g WHERE n > 5""",
    "change_feed": f"WITH {EV}, h AS (SELECT max(event_id) + 1 AS head FROM ev), a AS (SELECT x FROM (VALUES (9900), (5)) t(x), h WHERE x <= head AND x >= greatest(head - 4096, 0)) SELECT event_id + 1 AS n, kind FROM ev, a WHERE event_id + 1 > x",
    "distinct_accounts": f"WITH {EV} SELECT host, count(DISTINCT user_id) AS accounts, count(*) FILTER (kind = 'reject') AS failed, count(*) AS events FROM ev GROUP BY host",
    "top_hosts": f"WITH {HOSTS_SQL} SELECT host, events_per_sec FROM h ORDER BY events_per_sec DESC, host LIMIT 10",
}
