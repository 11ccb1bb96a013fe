"""Stream reconciliation and log audits over fixtures derived from the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirlog.operators import audit, reconcile
from weirlog.operators.windows import indexed_quantiles
from weirlog.plans.fixtures import EV, events, sql_values, values
from weirlog.session import table


def _up(spark, d):
    return events(spark, d).filter("kind <> 'reject'").select(F.col("user_id").alias("did"), "kind", "event_id", F.col("us").alias("at"))


def _relay(spark, d):
    """The relay's copy: later by up to 2 s, some lost, some twice, some that no source sent, some out of order."""
    e = _up(spark, d).withColumn("at", F.col("at") + F.col("event_id") * 7919 % 2_000_000 + F.when(F.col("event_id") % 53 == 0, 40_000_000_000).otherwise(0))
    kept = e.filter("event_id % 89 <> 0")
    twice = e.filter("event_id % 97 = 0").withColumn("at", F.col("at") + 5)
    made = e.filter("event_id % 101 = 0").withColumn("event_id", -F.col("event_id") - 1)
    return kept.union(twice).union(made)


STREAMS = f"""{EV}, up AS (SELECT user_id AS did, kind, event_id, us AS t FROM ev WHERE kind <> 'reject'),
lat AS (SELECT did, kind, event_id, t + event_id * 7919 % 2000000 + CASE WHEN event_id % 53 = 0 THEN 40000000000 ELSE 0 END AS t FROM up),
rel AS (SELECT * FROM lat WHERE event_id % 89 <> 0 UNION ALL SELECT did, kind, event_id, t + 5 FROM lat WHERE event_id % 97 = 0 UNION ALL SELECT did, kind, -event_id - 1, t FROM lat WHERE event_id % 101 = 0),
fst AS (SELECT did, kind, event_id, min(t) AS t FROM rel GROUP BY 1, 2, 3),
pairs AS (SELECT did, kind, event_id, up.t AS l, fst.t AS r FROM up FULL JOIN fst USING (did, kind, event_id))"""
_KEY = ["did", "kind", "event_id"]


def _pairs(spark, d):
    relay = _relay(spark, d)
    return reconcile.matched(_up(spark, d), reconcile.first_copies([relay], _KEY, "at"), _KEY, "at")


LO, HI = 1_704_100_000_000_000, 1_706_500_000_000_000


def diff_report(spark, d):
    return reconcile.diff_summary(_pairs(spark, d), "kind", LO, HI)


def diff_missing(spark, d):
    return _pairs(spark, d).filter(F.col("r_at").isNull() & F.col("l_at").between(LO, HI)).select("did", "kind", "event_id")


def diff_extra(spark, d):
    return _pairs(spark, d).filter(F.col("l_at").isNull() & F.col("r_at").between(LO, HI)).select("did", "kind", "event_id")


def diff_latency(spark, d):
    return indexed_quantiles(_pairs(spark, d).filter("latency is not null"), ["kind"], "latency", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def occurrence_match(spark, d):
    """Events without an id: the n-th of an account and kind on one side pairs with the n-th on the other."""
    up = reconcile.occurrences(_up(spark, d), ["did", "kind"], "at")
    relay = reconcile.occurrences(reconcile.first_copies([_relay(spark, d)], _KEY, "at").filter("event_id >= 0"), ["did", "kind"], "at")
    pairs = reconcile.matched(up, relay, ["did", "kind", "occ"], "at")
    return pairs.groupBy("did", "kind").agg(F.count("latency").alias("matched"), F.count_if(F.col("r_at").isNull()).alias("missing"))


def order_inversions(spark, d):
    return reconcile.inversions(_pairs(spark, d).filter("latency is not null"), "did", "event_id", "r_at")


def greedy_match(spark, d):
    """Identity events matched to the nearest later relay event of the account; a grouped pass, since the rule depends on the order."""
    relay = reconcile.first_copies([_relay(spark, d)], _KEY, "at")
    pick = lambda f: f.filter("kind = 'identity'").select("did", "kind", F.col("at"), F.col("event_id"))
    return reconcile.greedy(pick(_up(spark, d)), pick(relay), ["did", "kind"], "at", "event_id")


def relay_only(spark, d):
    relay, up = _relay(spark, d), _up(spark, d)
    watched = table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("did"))
    return reconcile.only_for_watched(relay, watched, up.select(*_KEY), "did", _KEY).select(*_KEY)


def alias_pairs(spark, d):
    """Each source of documents as a host and its mirror, of which all but the first source's lack a text now and then."""
    docs = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("did"), F.col("doc_id").alias("seq"))
    a = docs.select(F.col("source").alias("pair"), "seq", "did")
    b = docs.filter("seq % 400 <> 0 or source = 'src0'").select(F.col("source").alias("pair"), "seq", "did")
    return reconcile.mirrored(a, b, 20)


def state_replay(spark, d):
    """Orders write to their customer's key; the state lost some keys, holds other values for some, and has some too many."""
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 50 != 0, F.concat("o_orderstatus", (F.col("o_orderkey") % 7).cast("string"))).alias("value"))
    # The state stands at four fifths of the log.
    replay = reconcile.replayed(log, log.agg(F.max("seq")).first()[0] * 4 // 5)
    state = replay.filter("key % 31 <> 0").withColumn("value", F.when(F.col("key") % 37 == 0, F.lit("?")).otherwise(F.col("value"))).union(table(spark, d, "customer").filter("c_custkey % 200 = 3").select((F.col("c_custkey") + 1_000_000).alias("key"), F.col("c_custkey").alias("seq"), F.lit("old")))
    return reconcile.state_differences(state, replay, 600).groupBy("verdict").agg(F.count("*").alias("n"), F.min("key").alias("first"))


def api_diff(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    b = c.filter("c_custkey % 97 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 89 == 0, 99).otherwise(F.col("c_nationkey"))).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 83 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")))
    extra = c.filter("c_custkey % 101 = 0").withColumn("c_custkey", -F.col("c_custkey"))
    return reconcile.field_diff(c, b.union(extra), "c_custkey", ["c_mktsegment", "c_nationkey"])


def stream_shape(spark, d):
    e = events(spark, d)
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("bytes"), F.max(F.floor("value")).alias("max_bytes"), F.countDistinct("user_id").alias("accounts"), F.count_if(F.col("value") > 200).alias("big"))


# --- audits ---

GAPS = [(900, 1_000), (1_000, 1_040), (5_000, 5_003), (7_777, 7_790)]
_GAPS_SQL = sql_values("gaps", GAPS, "after, upto")


def _gaps(spark):
    return values(spark, GAPS, "after long, upto long")


def _observed(spark, d):
    """Two streams of the log: one with holes, one with repeats and step backs; a few seqs carry two contents."""
    e = events(spark, d).select(F.col("event_id").alias("seq"), (F.col("event_id") * 31 % 1009).alias("content"), F.col("event_id").alias("did"), F.col("event_id").alias("pos"))
    hole = e.join(F.broadcast(_gaps(spark)), audit.in_gap(F.col("seq")), "left_anti").filter("seq % 701 <> 0")
    a = hole.withColumn("stream", F.lit("a")).withColumn("content", F.when(F.col("seq") % 907 == 0, -1).otherwise(F.col("content")))
    b = hole.withColumn("stream", F.lit("b")).withColumn("pos", F.col("pos") * 2)
    again = b.filter("seq % 409 = 0").withColumn("pos", F.col("pos") + 5)
    moved = hole.filter("seq % 307 = 0").withColumn("stream", F.lit("a")).withColumn("did", F.col("did") - 150).withColumn("content", F.when(F.col("seq") % 907 == 0, -1).otherwise(F.col("content"))).withColumn("pos", F.col("pos")).filter("seq < 0")
    cols = ["stream", "pos", "seq", "content", "did"]
    return a.select(*cols).union(b.select(*cols)).union(again.select(*cols)).union(moved.select(*cols)).withColumn("did", F.when(F.col("seq") % 211 == 0, F.col("did") - 190).otherwise(F.col("did")))


OBSERVED = f"""{EV}, {_GAPS_SQL}, hol AS (SELECT event_id AS seq, event_id * 31 % 1009 AS content, event_id AS pos, CASE WHEN event_id % 211 = 0 THEN event_id - 190 ELSE event_id END AS did FROM ev WHERE event_id % 701 <> 0 AND NOT EXISTS (SELECT 1 FROM gaps WHERE event_id > after AND event_id <= upto)),
obs AS (SELECT 'a' AS stream, pos, seq, CASE WHEN seq % 907 = 0 THEN -1 ELSE content END AS content, did FROM hol UNION ALL SELECT 'b', pos * 2, seq, content, did FROM hol UNION ALL SELECT 'b', pos * 2 + 5, seq, content, did FROM hol WHERE seq % 409 = 0),
stp AS (SELECT *, max(seq) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM obs)"""


def content_conflicts(spark, d):
    return audit.content_conflicts(_observed(spark, d))


def seq_holes(spark, d):
    """Repeats, steps back and skipped seqs of each stream."""
    s = audit.steps(_observed(spark, d))
    return s.groupBy("stream").agg(F.count_if("back").alias("backs"), F.coalesce(F.sum(F.col("to_") - F.col("from_") + 1), F.lit(0)).alias("skipped"), F.max("seq").alias("last"))


def gap_jumps(spark, d):
    return audit.jumps(audit.steps(_observed(spark, d)), _gaps(spark))


def acked_audit(spark, d):
    e = events(spark, d).filter("event_id % 3 = 0 AND event_id > 0").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 603 == 0, 5).otherwise(F.col("event_id") * 31 % 1009).alias("content"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(F.col("event_id") + 3_000).alias("did"))
    return audit.acknowledged(e, _observed(spark, d), _gaps(spark)).groupBy("fate").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def duplicate_events(spark, d):
    return audit.duplicates(_observed(spark, d), _gaps(spark))


def lost_events(spark, d):
    """Expected events that were never emitted outside a gap."""
    seen = audit.with_gap(_observed(spark, d), _gaps(spark)).filter(~F.col("gapped")).select("did")
    return events(spark, d).select(F.col("event_id").alias("did")).join(seen, "did", "left_anti")


def node_log_mismatch(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("seq"), (F.col("event_id") * 31 % 1009).alias("content"))
    node = lambda n, cond, bad: e.filter(cond).select(F.lit(n).alias("node"), "seq", F.when(F.col("seq") % bad == 0, 7).otherwise(F.col("content")).alias("content"))
    # One node stopped early, the other joined late; between them they should hold the whole log.
    last = e.agg(F.max("seq")).first()[0]
    return audit.log_mismatches(node("n0", F.col("seq") < last * 4 // 5, 1999).union(node("n1", F.expr(f"seq >= {last // 20} AND seq % 333 <> 0"), 2500)), _observed(spark, d).filter("stream = 'b'"), _gaps(spark))


def contiguous_prefix(spark, d):
    """Each host's own numbering of its users' events, with one lost at the 600th."""
    w = Window.partitionBy("host").orderBy("event_id")
    rows = events(spark, d).withColumn("n", F.row_number().over(w)).filter("n <> 600 + user_id % 10 * 20")
    return audit.contiguous_prefix(rows, "host", "n")


def _segments(spark, d):
    """A segment for every 100 orders, older the lower; two keep young copies, and a deposed leader's lie past the manifest."""
    o = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("ordinal")).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("bytes"))
    return o.withColumn("age", 10_000 - F.col("ordinal") * 60 + F.when(F.col("ordinal") == 77, -9_000).otherwise(0)).withColumn("first", F.when(F.col("ordinal") == 121, 11_000).otherwise(F.col("first"))).withColumn("last", F.when(F.col("ordinal") == 121, 11_050).otherwise(F.col("last"))).withColumn("first", F.when(F.col("ordinal") == 140, F.col("first") + 5).otherwise(F.col("first")))


_SEG = """seg AS (SELECT o_orderkey // 100 AS ordinal, CASE o_orderkey // 100 WHEN 121 THEN 11000 WHEN 140 THEN min(o_orderkey) + 5 ELSE min(o_orderkey) END AS first, CASE WHEN o_orderkey // 100 = 121 THEN 11050 ELSE max(o_orderkey) END AS last, count(*) AS bytes,
  10000 - o_orderkey // 100 * 60 + CASE WHEN o_orderkey // 100 = 77 THEN -9000 ELSE 0 END AS age FROM orders GROUP BY o_orderkey // 100)"""


def retention_prefix(spark, d):
    return audit.retention(_segments(spark, d), 120, 12_000, 3_000)


def orphan_adoption(spark, d):
    rows = _segments(spark, d).withColumn("first", F.when(F.col("ordinal") == 122, 12_000).otherwise(F.col("first")))
    return audit.adopted(rows, 121, 11_999)


def manifest_continuity(spark, d):
    """Segments whose first seq doesn't follow the last of the one before."""
    w = Window.orderBy("ordinal")
    return _segments(spark, d).withColumn("want", F.lag("last").over(w) + 1).filter("first <> want").select("ordinal", "first", "want")


def commit_index(spark, d):
    """Orders as logs: their lines are members with positions; three of five make a quorum."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("match"), F.max("l_suppkey").alias("sup"))
    rows = li.select("l_orderkey", F.col("l_linenumber").alias("node"), "match", F.when(F.col("sup") % 10 == 0, 1).otherwise(2).alias("epoch"), F.lit(2).alias("current"), F.lit(1_500).alias("reserve"))
    return audit.commit_index(rows, "l_orderkey", 3).select("l_orderkey", F.col("commit").cast("long").alias("commit"))


def ack_prefix(spark, d):
    state = F.when(F.col("event_id") % 499 == 0, "failed").when(F.col("event_id") % 613 == 5, "pending").otherwise("done")
    return audit.acked_prefix(events(spark, d).select("host", F.col("event_id").alias("seq"), state.alias("state")), "host")


def fault_sessions(spark, d):
    """Rejects are faults as long as their value; purchases above 150 are pauses."""
    e = events(spark, d)
    faults = e.filter("kind = 'reject'").select((F.col("k") % 3).cast("string").alias("kind"), F.col("s").alias("start"), (F.col("s") + F.floor("value")).alias("stop"))
    pauses = e.filter("kind = 'commit' AND value > 60").select((F.col("s") - 200).alias("start"), (F.col("s") + F.floor("value")).alias("stop"))
    return audit.fault_sessions(faults, pauses, 200)


def byte_budget(spark, d):
    rows = events(spark, d).select(F.col("event_id").alias("seq"), F.floor("value").alias("bytes"))
    return audit.byte_budget(rows, 4_000, 5_000)


def tiered_read(spark, d):
    return events(spark, d).groupBy(audit.tier_of(F.col("event_id"), 9_000, 6_500).alias("tier")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (diff_report, diff_missing, diff_extra, diff_latency, occurrence_match, order_inversions, greedy_match, relay_only, alias_pairs, state_replay, api_diff, stream_shape, content_conflicts, seq_holes, gap_jumps, acked_audit, duplicate_events, lost_events, node_log_mismatch, contiguous_prefix, retention_prefix, orphan_adoption, manifest_continuity, commit_index, ack_prefix, fault_sessions, byte_budget, tiered_read)}

_ISLES = """isl AS (SELECT min(after) AS after, max(upto) AS upto FROM (SELECT after, upto, sum(new) OVER (ORDER BY after, upto) AS n FROM (SELECT after, upto, CASE WHEN after <= max(upto) OVER (ORDER BY after, upto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM gaps)) GROUP BY n)"""
SQL = {
    "diff_report": f"WITH {STREAMS} SELECT kind, count(l) AS up, count(r) AS relay, count(r - l) AS matched, count(*) FILTER (r IS NULL AND l BETWEEN {LO} AND {HI}) AS missing, count(*) FILTER (l IS NULL AND r BETWEEN {LO} AND {HI}) AS extra FROM pairs GROUP BY kind",
    "diff_missing": f"WITH {STREAMS} SELECT did, kind, event_id FROM pairs WHERE r IS NULL AND l BETWEEN {LO} AND {HI}",
    "diff_extra": f"WITH {STREAMS} SELECT did, kind, event_id FROM pairs WHERE l IS NULL AND r BETWEEN {LO} AND {HI}",
    "diff_latency": f"WITH {STREAMS}, l AS (SELECT kind, list(r - l ORDER BY r - l) AS v, count(*) AS n FROM pairs WHERE r - l IS NOT NULL GROUP BY kind) SELECT kind, n, v[1 + floor((n - 1) * 0.5 + 0.5)::BIGINT] AS p50, v[1 + floor((n - 1) * 0.9 + 0.5)::BIGINT] AS p90, v[1 + floor((n - 1) * 0.99 + 0.5)::BIGINT] AS p99 FROM l",
    "occurrence_match": f"""WITH {STREAMS}, a AS (SELECT did, kind, row_number() OVER (PARTITION BY did, kind ORDER BY t) AS occ FROM up), b AS (SELECT did, kind, row_number() OVER (PARTITION BY did, kind ORDER BY t) AS occ, true AS have FROM fst WHERE event_id >= 0)
      SELECT did, kind, count(have) AS matched, count(*) FILTER (have IS NULL) AS missing FROM a LEFT JOIN b USING (did, kind, occ) GROUP BY 1, 2""",
    "order_inversions": f"WITH {STREAMS}, p AS (SELECT did, r, lag(r) OVER (PARTITION BY did ORDER BY event_id) AS q FROM pairs WHERE r - l IS NOT NULL) SELECT did, count(*) FILTER (r < q) AS inversions FROM p GROUP BY did HAVING count(*) FILTER (r < q) > 0",
    "greedy_match": f"""WITH RECURSIVE {STREAMS}, s AS (SELECT did, event_id, t, row_number() OVER (PARTITION BY did ORDER BY t, event_id) AS n FROM up WHERE kind = 'identity'),
      q AS (SELECT did, event_id, t, row_number() OVER (PARTITION BY did ORDER BY t, event_id) AS k FROM fst WHERE kind = 'identity'),
      m(did, n, k) AS (SELECT DISTINCT did, 0::BIGINT, 0::BIGINT FROM s UNION ALL SELECT m.did, s.n, min(q.k) FROM m JOIN s ON s.did = m.did AND s.n = m.n + 1 JOIN q ON q.did = m.did AND q.k > m.k AND q.t >= s.t GROUP BY m.did, s.n)
      SELECT did, 'identity' AS kind, s.event_id AS source, q.event_id AS relay, q.t - s.t AS latency FROM m JOIN s USING (did, n) JOIN q USING (did, k)""",
    "relay_only": f"WITH {STREAMS} SELECT did, kind, event_id FROM rel WHERE did IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) AND (did, kind, event_id) NOT IN (SELECT did, kind, event_id FROM up)",
    "alias_pairs": """WITH a AS (SELECT source AS pair, doc_id AS seq, sha256(text) AS did FROM documents), b AS (SELECT * FROM a WHERE seq % 400 <> 0 OR pair = 'src0'), e AS (SELECT pair, max(seq) AS z FROM b GROUP BY pair),
      f AS (SELECT a.pair, a.seq, b.seq AS other FROM a LEFT JOIN b USING (pair, seq, did)), g AS (SELECT pair, count(other) AS matches, count(*) FILTER (other IS NULL AND z >= seq) AS differ FROM f JOIN e USING (pair) GROUP BY pair)
      SELECT *, CASE WHEN differ > 0 THEN 'differ' WHEN matches >= 20 THEN 'same' ELSE 'open' END AS verdict FROM g""",
    "state_replay": """WITH r AS (SELECT o_custkey AS key, arg_max(CASE WHEN o_orderkey % 50 <> 0 THEN o_orderstatus || (o_orderkey % 7) ELSE '' END, o_orderkey) AS v FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) * 4 // 5 FROM orders) GROUP BY 1),
      q AS (SELECT key, CASE WHEN key % 31 = 0 THEN 'missing' WHEN key % 37 = 0 THEN 'different' ELSE 'equal' END AS verdict FROM r WHERE v <> '' UNION ALL SELECT c_custkey + 1000000, CASE WHEN c_custkey <= 600 THEN 'pruned' ELSE 'extra' END FROM customer WHERE c_custkey % 200 = 3)
      SELECT verdict, count(*) AS n, min(key) AS first FROM q GROUP BY verdict""",
    "api_diff": """SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'only_a' ELSE concat_ws(',', CASE WHEN c_custkey % 83 = 0 THEN 'c_mktsegment' END, CASE WHEN c_custkey % 89 = 0 THEN 'c_nationkey' END) END AS differs FROM customer WHERE c_custkey > 0 AND (c_custkey % 97 = 0 OR c_custkey % 83 = 0 OR c_custkey % 89 = 0)
      UNION ALL SELECT -c_custkey, 'only_b' FROM customer WHERE c_custkey > 0 AND c_custkey % 101 = 0""",
    "stream_shape": f"WITH {EV} SELECT kind, count(*) AS n, sum(floor(value))::BIGINT AS bytes, max(floor(value))::BIGINT AS max_bytes, count(DISTINCT user_id) AS accounts, count(*) FILTER (value > 200) AS big FROM ev GROUP BY kind",
    "content_conflicts": f"WITH {OBSERVED} SELECT seq, count(*) AS n FROM obs GROUP BY seq HAVING min(content) <> max(content)",
    "seq_holes": f"WITH {OBSERVED} SELECT stream, count(*) FILTER (seq <= last) AS backs, coalesce(sum(seq - last - 1) FILTER (seq > last + 1), 0)::BIGINT AS skipped, max(seq) AS last FROM stp GROUP BY stream",
    "gap_jumps": f"WITH {OBSERVED}, {_ISLES} SELECT stream, last + 1 AS from_, seq - 1 AS to_, EXISTS (SELECT 1 FROM isl WHERE after < last + 1 AND upto >= seq - 1) AS covered FROM stp WHERE seq > last + 1",
    "acked_audit": f"""WITH {OBSERVED}, {_ISLES}, ak AS (SELECT event_id AS seq, CASE WHEN event_id % 603 = 0 THEN 5 ELSE event_id * 31 % 1009 END AS content, CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id + 3000 END AS did FROM ev WHERE event_id % 3 = 0 AND event_id > 0),
      e AS (SELECT seq, min(content) AS c FROM obs GROUP BY seq), h AS (SELECT did, max(seq) AS top FROM obs GROUP BY did), f AS (SELECT ak.seq, CASE WHEN upto IS NOT NULL THEN CASE WHEN top > upto THEN 'reingested' ELSE 'lost' END WHEN c IS NULL THEN 'missing' WHEN c = content THEN 'ok' ELSE 'content' END AS fate
        FROM ak LEFT JOIN e USING (seq) LEFT JOIN h USING (did) LEFT JOIN isl ON ak.seq > after AND ak.seq <= upto) SELECT fate, count(*) AS n, min(seq) AS first FROM f GROUP BY fate""",
    "duplicate_events": f"WITH {OBSERVED}, s AS (SELECT did, count(DISTINCT seq) AS n, min(seq) AS lo, max(seq) AS hi FROM obs GROUP BY did) SELECT did, n, EXISTS (SELECT 1 FROM gaps WHERE lo <= upto AND hi > upto) AS across FROM s WHERE n > 1",
    "lost_events": f"WITH {OBSERVED} SELECT event_id AS did FROM ev WHERE event_id NOT IN (SELECT did FROM obs WHERE NOT EXISTS (SELECT 1 FROM gaps WHERE seq > after AND seq <= upto))",
    "node_log_mismatch": f"""WITH {OBSERVED}, lg AS (SELECT 'n0' AS node, event_id AS seq, CASE WHEN event_id % 1999 = 0 THEN 7 ELSE event_id * 31 % 1009 END AS content FROM ev WHERE event_id < (SELECT max(event_id) * 4 // 5 FROM ev) UNION ALL SELECT 'n1', event_id, CASE WHEN event_id % 2500 = 0 THEN 7 ELSE event_id * 31 % 1009 END FROM ev WHERE event_id >= (SELECT max(event_id) // 20 FROM ev) AND event_id % 333 <> 0),
      em AS (SELECT seq, min(content) AS c FROM obs WHERE stream = 'b' GROUP BY seq), rg AS (SELECT node, min(seq) AS lo, max(seq) AS hi FROM lg GROUP BY node)
      SELECT node, (SELECT count(*) FROM lg JOIN em USING (seq) WHERE lg.node = rg.node AND content <> c) AS other, (SELECT count(*) FROM em WHERE seq BETWEEN lo AND hi AND seq NOT IN (SELECT seq FROM lg l2 WHERE l2.node = rg.node)) AS lacking FROM rg""",
    "contiguous_prefix": f"WITH {EV}, n AS (SELECT host, user_id, row_number() OVER (PARTITION BY host ORDER BY event_id) AS n FROM ev), k AS (SELECT host, n, row_number() OVER (PARTITION BY host ORDER BY n) AS rn FROM n WHERE n <> 600 + user_id % 10 * 20) SELECT host, count(*) FILTER (n = rn) AS prefix FROM k GROUP BY host",
    "retention_prefix": f"""WITH {_SEG}, p AS (SELECT *, min((age >= 3000)::INT) OVER (ORDER BY ordinal) AS go FROM seg WHERE ordinal < 120)
      SELECT ordinal, first, last, bytes, 'old' AS why FROM p WHERE go = 1 UNION ALL SELECT ordinal, first, last, bytes, 'stale' FROM seg WHERE ordinal >= 120 AND first <= 12000""",
    "orphan_adoption": f"""WITH {_SEG}, s AS (SELECT ordinal, CASE WHEN ordinal = 122 THEN 12000 ELSE first END AS first, last FROM seg WHERE ordinal >= 121), t AS (SELECT *, min((ordinal - 121 = rn)::INT) OVER (ORDER BY ordinal) AS there FROM (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS rn FROM s)),
      f AS (SELECT *, coalesce(lag(last) OVER (ORDER BY ordinal), 11999) + 1 AS want FROM t WHERE there = 1 AND first > 11999) SELECT ordinal, first, last FROM f QUALIFY min((first = want)::INT) OVER (ORDER BY ordinal) = 1""",
    "manifest_continuity": f"WITH {_SEG}, w AS (SELECT ordinal, first, lag(last) OVER (ORDER BY ordinal) + 1 AS want FROM seg) SELECT * FROM w WHERE first <> want",
    "commit_index": """WITH li AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS m, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), c AS (SELECT l_orderkey, list(m ORDER BY m DESC) AS v FROM li WHERE s % 10 <> 0 GROUP BY 1)
      SELECT l_orderkey, CASE WHEN len(v) >= 3 THEN least(v[3], 1500) ELSE 0 END AS commit FROM c""",
    "ack_prefix": f"""WITH {EV}, q AS (SELECT host, event_id AS seq, CASE WHEN event_id % 499 = 0 THEN 'failed' WHEN event_id % 613 = 5 THEN 'pending' ELSE 'done' END AS state FROM ev), o AS (SELECT host, min(seq) FILTER (state <> 'done') AS open, count(*) FILTER (state = 'pending') AS pending FROM q GROUP BY host)
      SELECT host, (SELECT max(seq) FROM q WHERE q.host = o.host AND state = 'done' AND (open IS NULL OR seq < open)) AS cursor, pending FROM o""",
    "fault_sessions": f"""WITH {EV}, f AS (SELECT (k % 3)::VARCHAR AS kind, s AS a, s + floor(value)::BIGINT AS b FROM ev WHERE kind = 'reject'), p AS (SELECT s - 200 AS p0, s + floor(value)::BIGINT AS p1 FROM ev WHERE kind = 'commit' AND value > 60),
      g AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY kind ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 200 THEN 0 ELSE 1 END AS new FROM f), h AS (SELECT *, sum(new) OVER (PARTITION BY kind ORDER BY a, b) AS n FROM g), m AS (SELECT kind, n, min(a) AS start, max(b) AS stop, count(*) AS faults FROM h GROUP BY kind, n)
      SELECT kind, start, stop, faults, (SELECT max(p1 - p0) FROM p WHERE p0 <= stop AND p1 >= start) AS pause FROM m""",
    "byte_budget": f"WITH {EV}, b AS (SELECT event_id AS seq, floor(value)::BIGINT AS bytes, coalesce(sum(floor(value)::BIGINT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM ev WHERE event_id >= 4000) SELECT seq, bytes FROM b WHERE p + bytes <= 5000 OR p = 0",
    "tiered_read": f"WITH {EV} SELECT CASE WHEN event_id >= 9000 THEN 'ring' WHEN event_id >= 6500 THEN 'disk' ELSE 'bucket' END AS tier, count(*) AS n FROM ev GROUP BY 1",
}
