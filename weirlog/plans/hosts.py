"""Host names, domain rules, limits and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirlog.functions import hosts
from weirlog.operators import lookup, policy
from weirlog.plans.fixtures import EV, events, sql_values, values
from weirlog.session import table

RAW = [
    (1, " HTTPS://Pds.Example.COM/ "), (2, "pds.example.com:443"), (3, "pds.example.com:8443"), (4, "wss://a.b.c."), (5, ""), (6, "  "), (7, "10.0.0.1"), (8, "[::1]"), (9, "::1"), (10, "localhost"),
    (11, "box.local"), (12, "host.internal"), (13, "a..b"), (14, "-a.com"), (15, "a-.com"), (16, "ex_ample.com"), (17, "example.com/path"), (18, "user@example.com"), (19, "example.com?x=1"), (20, "com"),
    (21, "1.2.3.4.5"), (22, "a.123"), (23, "http://UPPER.example.net"), (24, "example.org:70000"), (25, "example.org:"), (26, "x" * 64 + ".com"), (27, ".".join(["abcdefghij"] * 26)), (28, "xn--bcher-kva.example.org"), (29, "a b.com"), (30, "h.example.com:0443"),
    (31, "ws://10.1.2.3:2583"), (32, "ftp://files.example.com"), (33, "https://localhost:2583/xrpc"), (34, "LOCALHOST"), (35, "*.Example.COM."), (36, "*.com"), (37, "256.1.1.1"), (38, "*.a.b-"), (39, "example.com:0"), (40, "https://m.example.com:8080/x#y"),
]
_RAW_SQL = sql_values("raw", RAW, "id, x")
#: id, pattern, effect, effect_tier, effect_eps
RULES = [(1, "*.example.com", "throttle", None, 10.0), (2, "m.example.com", "allow", None, None), (3, "*.casino-win.example.com", "ban", None, None), (4, "*.example.net", "tier", "trusted", None), (5, "blog.example.net", "tier", "default", None), (6, "www.example.org", "throttle", None, 2.5), (7, "*.free-bets.example.com", "ban", None, None), (8, "nowhere.test.org", "ban", None, None)]
_RULES_SQL = sql_values("rules", RULES, "id, pattern, effect, effect_tier, effect_eps")
TIERS = [("trusted", 5000.0, 0, 0, 10_000_000), ("default", 60.0, 12_500, 120_000, 10_000), ("new", 51.0, 3_500, 30_000, 1_000), ("throttled", 5.0, 500, 4_000, 100)]
_TIERS_SQL = sql_values("tiers", TIERS, "tier, eps, eph, epd, cap")
_LABELS = "len(list_filter(string_split({0}, '.'), lambda l: NOT regexp_full_match(l, '[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?'))) = 0 AND length({0}) <= 253"
_V4 = r"((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_RESERVED = ", ".join(f"'{x}'" for x in hosts.RESERVED)


def _raw(spark):
    return values(spark, RAW, "id long, x string")


def host_normalise(spark, d):
    return _raw(spark).select("id", hosts.normalized(F.col("x")).alias("n")).select("id", "n.host", "n.error")


def host_admissible(spark, d):
    return _raw(spark).select("id", hosts.admissible(F.col("x")).alias("n")).select("id", "n.host", "n.insecure", "n.error")


def pattern_normalise(spark, d):
    return _raw(spark).select("id", hosts.pattern(F.col("x")).alias("n")).select("id", "n.pattern", "n.error")


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", hosts.url_host(F.col("url")).alias("host"))


_PAGES = """pg AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)"""


def url_hosts(spark, d):
    return _pages(spark, d).groupBy("host").agg(F.count("*").alias("n"))


def _rules(spark):
    return values(spark, RULES, "id long, pattern string, effect string, effect_tier string, effect_eps double")


def rule_most_specific(spark, d):
    return lookup.most_specific(_pages(spark, d), _rules(spark)).select("page_id", "host", "rule", "effect")


def rule_match_counts(spark, d):
    decided = lookup.most_specific(_pages(spark, d).select("host").distinct(), _rules(spark)).groupBy("rule").agg(F.count("*").alias("hosts"))
    return _rules(spark).select(F.col("id").alias("rule")).join(decided, "rule", "left").select("rule", F.coalesce("hosts", F.lit(0)).alias("hosts"))


def rule_overridden(spark, d):
    return lookup.overridden(_pages(spark, d).select("host").distinct(), _rules(spark))


BANS, ALLOWS, EXACT = ["example.com", "casino-win.example.com"], ["example.com", "example.org", "m.example.com"], ["blog.example.com"]


def suffix_verdict(spark, d):
    names = _pages(spark, d).select("host").distinct()
    one = lambda xs: values(spark, [(x,) for x in xs], "base string")
    return lookup.suffix_verdict(names, one(EXACT), one(BANS), one(ALLOWS))


_CAND = f"""{_RULES_SQL}, {_PAGES}, names AS (SELECT DISTINCT host FROM pg),
cand AS (SELECT host, id, effect, CASE WHEN pattern = host THEN 1000 ELSE length(pattern) END AS w FROM names JOIN rules
  ON pattern = host OR (starts_with(pattern, '*.') AND (host = substr(pattern, 3) OR ends_with(host, substr(pattern, 2)))))"""


def alias_hops(spark, d):
    """Customers as hosts; one in three is another name of customer // 2, one of nine of one that follows it (a cycle)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("host"))
    aliases = c.filter("host % 3 = 0").select("host", F.when(F.col("host") % 9 == 0, F.col("host") + 9).otherwise(F.floor(F.col("host") / 2)).alias("alias_of"))
    return lookup.resolve_aliases(c, aliases).select("host", F.col("target").cast("long").alias("target"), "steps")


def _records(spark, d):
    """A record for each host of the pages."""
    return _pages(spark, d).groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("p")).select(
        "host", F.element_at(F.array(*(F.lit(t) for t in policy.TIERS)), (F.col("p") % 6 + 1).cast("int")).alias("tier"),
        F.when(F.col("n") % 2 == 0, F.lit(7.5)).alias("throttle_eps"), F.when(F.col("n") % 5 == 0, F.col("n") * 10).alias("max_override"),
        F.when(F.col("n") % 3 == 0, F.col("n") * 100).alias("seeded"), F.when(F.col("p") % 7 == 0, F.lit("other")).alias("alias_of"),
    )


_RECORDS = """rec AS (SELECT host, (['trusted', 'default', 'new', 'throttled', 'suspended', 'banned'])[min(page_id) % 6 + 1] AS tier, CASE WHEN count(*) % 2 = 0 THEN 7.5::DOUBLE END AS throttle_eps,
  CASE WHEN count(*) % 5 = 0 THEN count(*) * 10 END AS max_override, CASE WHEN count(*) % 3 = 0 THEN count(*) * 100 END AS seeded, CASE WHEN min(page_id) % 7 = 0 THEN 'other' END AS alias_of FROM pg GROUP BY host)"""


def effective_limits(spark, d):
    tiers = values(spark, TIERS, "tier string, events_per_sec double, events_per_hour long, events_per_day long, max_accounts long")
    return policy.effective_limits(_records(spark, d), _rules(spark), tiers)


def untrusted_limits(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return c.select("c_custkey", *(v.alias(k) for k, v in policy.untrusted(F.col("c_custkey")).items()))


TRUSTED = [("*.example.org",)]
A_DAY = 2


def admission_decision(spark, d):
    """Each page is a request for its host; days are ten pages long."""
    asks = table(spark, d, "pages").select(F.col("page_id").alias("id"), (F.floor(F.col("page_id") / 10) * 86_400 + F.col("page_id") % 10).alias("s"), F.col("url").alias("raw"), (F.col("page_id") % 17 == 0).alias("admin"))
    known = values(spark, [("m.example.net", "suspended"), ("www.example.com", "default")], "host string, tier string")
    out = policy.admission(asks, known, _rules(spark), values(spark, TRUSTED, "pattern string"), a_day=A_DAY)
    return out.select("id", "host", "verdict", "tier", "counted")


def policy_violations(spark, d):
    rows = _records(spark, d)
    checks = {
        "tier": F.col("tier").isin("trusted", "default", "new", "throttled"), "throttle.eps": F.col("throttle_eps").isNull() | (F.col("throttle_eps") > 8),
        "accounts.max": F.col("max_override") >= 100, "seeded": F.coalesce("seeded", F.lit(0)) < 500, "host": F.col("host").rlike("^[a-z0-9.-]+$"),
    }
    out = policy.violations(rows, checks)
    return out.select("host", F.array_join("violations", ",").alias("violations"), F.size("violations").cast("long").alias("n"))


def account_statuses(spark, d):
    rows = events(spark, d).select("event_id", (F.col("k") % 11 == 0).alias("takedown"), (F.col("k") % 7 == 0).alias("throttled"), (F.col("k") % 3 != 0).alias("active"), F.element_at(F.array(*(F.lit(x) for x in (*policy.INACTIVE, "gone"))), (F.col("event_id") % 7 + 1).cast("int")).alias("said"), F.when(F.col("event_id") % 5 == 0, "rev").alias("desync"))
    rows = rows.withColumn("upstream", policy.upstream_status(F.col("active"), F.col("said")))
    status = policy.account_status(F.col("takedown"), F.col("throttled"), F.col("upstream"), F.col("desync"))
    return rows.select("event_id", "upstream", status.alias("status"), policy.drops_commits(F.col("takedown"), F.col("throttled"), F.col("upstream")).alias("drops"), policy.latest_commit_error(status).alias("error"))


def host_statuses(spark, d):
    rows = _records(spark, d).withColumn("conn", F.element_at(F.array(F.lit("active"), F.lit("idle"), F.lit("offline")), (F.length("host") % 3 + 1)))
    return rows.select("host", policy.host_status(F.col("tier"), F.col("conn"), F.col("alias_of")).alias("status"))


def trip_severity(spark, d):
    action = F.element_at(F.array(F.lit("alert"), F.lit("case"), F.lit("throttle"), F.lit("throttle-and-case")), (F.col("event_id") % 4 + 1).cast("int"))
    rows = events(spark, d).withColumn("observed", F.floor("value")).withColumn("lim", F.lit(20.0))
    did = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string"))
    window = F.when(F.col("event_id") % 3 == 0, 60).when(F.col("event_id") % 3 == 1, 3600).otherwise(86_400)
    return rows.select("event_id", policy.severity(F.col("observed"), F.col("lim"), action).alias("severity"), policy.summary(F.col("kind"), F.col("host"), did, F.col("observed"), F.col("lim"), window).alias("summary"))


def host_keys(spark, d):
    return _pages(spark, d).select("host").distinct().select("host", F.substring(F.sha2("host", 256), 1, 16).alias("key"))


def seed_updates(spark, d):
    c = table(spark, d, "customer")
    rows = c.select("c_custkey", F.floor(F.col("c_acctbal")).alias("accounts"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("from_"), F.lit(100_000).alias("now"), F.when(F.col("c_custkey") % 5 != 0, F.floor(F.col("c_acctbal") * (F.col("c_custkey") % 3 + 9) / 10)).alias("cur_accounts"), F.when(F.col("c_custkey") % 5 != 0, F.when(F.col("c_custkey") % 3 == 0, "a").otherwise("b")).alias("cur_from"), F.when(F.col("c_custkey") % 5 != 0, 100_000 - F.col("c_custkey") * 50 % 100_000).alias("cur_at"))
    return policy.seed_update(rows, 40_000).select("c_custkey", "write")


QUERIES = {f.__name__: f for f in (host_normalise, host_admissible, pattern_normalise, url_hosts, rule_most_specific, rule_match_counts, rule_overridden, suffix_verdict, alias_hops, effective_limits, untrusted_limits, admission_decision, policy_violations, account_statuses, host_statuses, trip_severity, host_keys, seed_updates)}

_STRIP = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
_ADM = f"""t AS (SELECT id, {_STRIP} AS s FROM raw), u AS (SELECT id, CASE WHEN contains(s, '://') THEN lower(split_part(s, '://', 1)) END AS scheme, CASE WHEN contains(s, '://') THEN substr(s, strpos(s, '://') + 3) ELSE s END AS rest FROM t),
 v AS (SELECT id, scheme, lower(regexp_extract(rest, '^[^/?#]*')) AS a FROM u), w AS (SELECT id, scheme, CASE WHEN contains(a, ':') THEN regexp_extract(a, ':([^:]*)$', 1) END AS port, rtrim(CASE WHEN contains(a, ':') THEN regexp_replace(a, ':[^:]*$', '') ELSE a END, '.') AS name FROM v),
 y AS (SELECT *, CASE WHEN scheme IS NOT NULL AND scheme NOT IN ('https', 'wss', 'http', 'ws') THEN 'scheme' WHEN port IS NOT NULL AND NOT regexp_full_match(port, '[0-9]+') THEN 'syntax' WHEN name = 'localhost' THEN NULL WHEN port IS NOT NULL THEN 'port'
   WHEN NOT ({_LABELS.format("name")} AND contains(name, '.') AND NOT regexp_matches(name, '\\.[0-9]+$')) THEN 'syntax' END AS error FROM w)"""
SQL = {
    "host_normalise": f"""WITH {_RAW_SQL}, t AS (SELECT id, regexp_replace(regexp_replace(lower({_STRIP}), '^(https://|wss://|http://|ws://)', ''), '/$', '') AS s FROM raw),
      u AS (SELECT id, s, contains(s, ':') AS hp, regexp_extract(s, ':([^:]*)$', 1) AS port, regexp_replace(CASE WHEN contains(s, ':') THEN regexp_replace(s, ':[^:]*$', '') ELSE s END, '\\.$', '') AS name FROM t),
      v AS (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN length(s) > 260 THEN 'too_long' WHEN regexp_matches(s, '[/?#@\\\\%\\s]') THEN 'not_bare'
        WHEN starts_with(s, '[') THEN CASE WHEN NOT contains(s, ']') THEN 'not_bare' ELSE 'ip' END WHEN regexp_full_match(s, '[0-9a-f]*:[0-9a-f]*:[0-9a-f:]*') OR regexp_full_match(s, '{_V4}') THEN 'ip'
        WHEN hp AND NOT (regexp_full_match(port, '[0-9]{{1,9}}') AND try_cast(port AS BIGINT) <= 65535) THEN 'port' WHEN name = '' THEN 'empty' WHEN length(name) > 253 THEN 'too_long' WHEN hp AND try_cast(port AS BIGINT) <> 443 THEN 'port'
        WHEN regexp_full_match(name, '{_V4}') THEN 'ip' WHEN NOT ({_LABELS.format("name")}) THEN 'label' WHEN string_split(name, '.')[-1] IN ({_RESERVED}) THEN 'reserved' WHEN NOT contains(name, '.') THEN 'few_labels' WHEN regexp_matches(name, '\\.[0-9]+$') THEN 'label' END AS error FROM u)
      SELECT id::BIGINT AS id, CASE WHEN error IS NULL THEN name END AS host, error FROM v""",
    "host_admissible": f"""WITH {_RAW_SQL}, {_ADM} SELECT id::BIGINT AS id, CASE WHEN error IS NULL THEN CASE WHEN name = 'localhost' AND port IS NOT NULL THEN name || ':' || port ELSE name END END AS host, coalesce(scheme IN ('http', 'ws'), false) AS insecure, error FROM y""",
    "pattern_normalise": f"""WITH {_RAW_SQL}, t AS (SELECT id, lower(rtrim({_STRIP}, '.')) AS p FROM raw), u AS (SELECT id, p, substr(p, 3) AS base, CASE WHEN contains(p, ':') THEN regexp_extract(p, ':([^:]*)$', 1) END AS port, regexp_replace(p, ':[^:]*$', '') AS name FROM t),
      v AS (SELECT id, p, CASE WHEN starts_with(p, '*.') THEN {_LABELS.format("base")} AND contains(base, '.') AND NOT regexp_matches(base, '\\.[0-9]+$')
        ELSE (port IS NULL OR (regexp_full_match(port, '[0-9]{{1,5}}') AND try_cast(port AS BIGINT) BETWEEN 1 AND 65535)) AND (({_LABELS.format("name")} AND contains(name, '.') AND NOT regexp_matches(name, '\\.[0-9]+$')) OR name = 'localhost' OR regexp_full_match(name, '{_V4}')) END AS ok FROM u)
      SELECT id::BIGINT AS id, CASE WHEN ok THEN p END AS pattern, CASE WHEN NOT ok THEN 'pattern' END AS error FROM v""",
    "url_hosts": f"WITH {_PAGES} SELECT host, count(*) AS n FROM pg GROUP BY host",
    "rule_most_specific": f"WITH {_CAND}, best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY host ORDER BY w DESC) = 1) SELECT page_id, pg.host, id::BIGINT AS rule, effect FROM pg LEFT JOIN best USING (host)",
    "rule_match_counts": f"WITH {_CAND}, best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY host ORDER BY w DESC) = 1) SELECT r.id::BIGINT AS rule, count(best.host) AS hosts FROM rules r LEFT JOIN best ON best.id = r.id GROUP BY r.id",
    "rule_overridden": f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY w DESC) AS n FROM cand) SELECT host, max(id) FILTER (n = 1)::BIGINT AS winner, max(id) FILTER (n = 2)::BIGINT AS fallback FROM r GROUP BY host",
    "suffix_verdict": f"""WITH {_PAGES}, {sql_values("lists", [(x, 1) for x in BANS] + [(x, 0) for x in ALLOWS], "base, ban")}, names AS (SELECT DISTINCT host FROM pg),
      m AS (SELECT host, ban FROM names JOIN lists ON host = base OR ends_with(host, '.' || base) QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(base) DESC, ban DESC) = 1)
      SELECT host, CASE WHEN host IN ('{EXACT[0]}') THEN 'allow' WHEN ban = 1 THEN 'ban' WHEN ban = 0 THEN 'allow' ELSE 'unknown' END AS verdict FROM names LEFT JOIN m USING (host)""",
    "alias_hops": """WITH RECURSIVE al AS (SELECT c_custkey AS host, CASE WHEN c_custkey % 9 = 0 THEN c_custkey + 9 ELSE c_custkey // 2 END AS t FROM customer WHERE c_custkey % 3 = 0),
      walk AS (SELECT c_custkey AS host, c_custkey AS target, 0 AS steps FROM customer UNION ALL SELECT walk.host, al.t, steps + 1 FROM walk JOIN al ON al.host = walk.target WHERE steps < 4)
      SELECT host, target, steps::INTEGER AS steps FROM walk QUALIFY row_number() OVER (PARTITION BY host ORDER BY steps DESC) = 1""",
    "effective_limits": f"""WITH {_CAND}, {_RECORDS}, {_TIERS_SQL}, best AS (SELECT c.host, c.id, c.effect, r.effect_tier, r.effect_eps FROM cand c JOIN rules r USING (id) QUALIFY row_number() OVER (PARTITION BY c.host ORDER BY w DESC) = 1),
      a AS (SELECT rec.*, id, effect, CASE WHEN tier IN ('suspended', 'banned') THEN tier WHEN effect = 'ban' THEN 'banned' WHEN effect = 'tier' AND tier <> 'throttled' THEN effect_tier ELSE tier END AS now,
        CASE WHEN tier NOT IN ('suspended', 'banned') AND effect = 'throttle' THEN least(throttle_eps, effect_eps) ELSE throttle_eps END AS eps_cap FROM rec LEFT JOIN best USING (host)),
      b AS (SELECT a.*, t.*, CASE WHEN now IN ('new', 'default') THEN coalesce(seeded, 0) ELSE 0 END AS n FROM a LEFT JOIN tiers t ON t.tier = a.now)
      SELECT host, now AS tier, id::BIGINT AS rule, CASE WHEN eps IS NOT NULL THEN least(eps + n / 1000, eps_cap) END AS events_per_sec, (CASE WHEN eph > 0 THEN eph + n ELSE eph END)::BIGINT AS events_per_hour,
        (CASE WHEN epd > 0 THEN epd + 10 * n ELSE epd END)::BIGINT AS events_per_day, (CASE WHEN eps IS NOT NULL THEN coalesce(max_override, CASE WHEN cap > 0 THEN cap + n ELSE cap END) END)::BIGINT AS max_accounts, eps IS NOT NULL AND alias_of IS NULL AS connect FROM b""",
    "untrusted_limits": "SELECT c_custkey, 50 + c_custkey / 1000 AS events_per_sec, 2500 + c_custkey AS events_per_hour, 20000 + 10 * c_custkey AS events_per_day, c_custkey AS max_accounts FROM customer",
    "admission_decision": f"""WITH {_CAND}, best AS (SELECT c.host, c.id, c.effect, r.effect_tier FROM cand c JOIN rules r USING (id) QUALIFY row_number() OVER (PARTITION BY c.host ORDER BY w DESC) = 1),
      {sql_values("known", [("m.example.net", "suspended"), ("www.example.com", "default")], "host, tier")},
      a AS (SELECT page_id AS id, page_id // 10 AS day, page_id % 17 = 0 AS admin, starts_with(url, 'http:') AS insecure, pg.host, effect, effect_tier, known.tier AS have, pg.host = 'example.org' OR ends_with(pg.host, '.example.org') AS trusted
        FROM pages JOIN pg USING (page_id) LEFT JOIN best ON best.host = pg.host LEFT JOIN known ON known.host = pg.host),
      b AS (SELECT *, CASE WHEN insecure AND NOT admin THEN 'bad_hostname' WHEN effect = 'ban' THEN 'banned' WHEN have IN ('banned', 'suspended') AND NOT admin THEN 'banned' WHEN have IS NOT NULL THEN 'known' END AS early FROM a),
      c AS (SELECT *, early IS NULL AND NOT admin AND NOT (trusted OR coalesce(effect = 'allow', false)) AS spends FROM b),
      e AS (SELECT *, coalesce(early, CASE WHEN spends AND row_number() OVER (PARTITION BY day, spends ORDER BY id) > {A_DAY} THEN 'daily_limit' ELSE 'admit' END) AS verdict FROM c)
      SELECT id, CASE WHEN true THEN host END AS host, verdict, CASE WHEN verdict = 'known' THEN have WHEN verdict = 'admit' THEN CASE WHEN effect = 'tier' THEN effect_tier WHEN trusted THEN 'trusted' ELSE 'new' END END AS tier, verdict = 'admit' AND spends AS counted FROM e""",
    "policy_violations": f"""WITH {_PAGES}, {_RECORDS}, v AS (SELECT host, list_filter([CASE WHEN tier IN ('suspended', 'banned') THEN 'tier' END, CASE WHEN throttle_eps <= 8 THEN 'throttle.eps' END, CASE WHEN NOT coalesce(max_override >= 100, false) THEN 'accounts.max' END,
      CASE WHEN coalesce(seeded, 0) >= 500 THEN 'seeded' END, CASE WHEN NOT regexp_matches(host, '^[a-z0-9.-]+$') THEN 'host' END], lambda x: x IS NOT NULL) AS l FROM rec) SELECT host, array_to_string(l, ',') AS violations, len(l)::BIGINT AS n FROM v""",
    "account_statuses": f"""WITH {EV}, a AS (SELECT event_id, k % 11 = 0 AS td, k % 7 = 0 AS th, CASE WHEN k % 3 <> 0 THEN 'active' WHEN event_id % 7 = 6 THEN 'inactive' ELSE (['takendown', 'suspended', 'deleted', 'deactivated', 'desynchronized', 'throttled'])[event_id % 7 + 1] END AS upstream, event_id % 5 = 0 AS de FROM ev),
      b AS (SELECT *, CASE WHEN td THEN 'takendown' WHEN th THEN 'throttled' WHEN upstream <> 'active' THEN upstream WHEN de THEN 'desynchronized' ELSE 'active' END AS status FROM a)
      SELECT event_id, upstream, status, td OR th OR upstream IN ('takendown', 'suspended', 'deleted', 'deactivated', 'inactive') AS drops,
        CASE status WHEN 'active' THEN NULL WHEN 'takendown' THEN 'RepoTakendown' WHEN 'suspended' THEN 'RepoSuspended' WHEN 'deactivated' THEN 'RepoDeactivated' WHEN 'deleted' THEN 'RepoDeleted' ELSE 'RepoInactive' END AS error FROM b""",
    "host_statuses": f"""WITH {_PAGES}, {_RECORDS}, a AS (SELECT *, (['active', 'idle', 'offline'])[length(host) % 3 + 1] AS conn FROM rec)
      SELECT host, CASE WHEN tier = 'banned' THEN 'banned' WHEN alias_of IS NOT NULL THEN 'offline' WHEN tier = 'throttled' THEN 'throttled' WHEN tier = 'suspended' THEN 'offline' ELSE conn END AS status FROM a""",
    "trip_severity": f"""WITH {EV} SELECT event_id, CASE WHEN floor(value) / 20 >= 5 THEN 'critical' WHEN event_id % 4 >= 2 THEN 'high' WHEN event_id % 4 = 1 THEN 'warn' ELSE 'info' END AS severity,
      CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR || ' on ' || host ELSE host END || ': ' || kind || ' ' || floor(value)::BIGINT::VARCHAR || CASE event_id % 3 WHEN 0 THEN '/min' WHEN 1 THEN '/h' ELSE ' per 86400 s' END || ' (threshold 20)' AS summary FROM ev""",
    "host_keys": f"WITH {_PAGES} SELECT DISTINCT host, substr(sha256(host), 1, 16) AS key FROM pg",
    "seed_updates": """WITH r AS (SELECT c_custkey, floor(c_acctbal)::BIGINT AS n, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS f, c_custkey % 5 <> 0 AS have, floor(c_acctbal * (c_custkey % 3 + 9) / 10)::BIGINT AS cn, CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS cf, c_custkey * 50 % 100000 AS age FROM customer)
      SELECT c_custkey, n > 0 AND NOT (have AND age < 40000 AND cf <> f AND cn >= n) AND NOT (have AND age < 40000 AND cf = f AND abs(cn - n) * 10 <= cn AND age < 20000) AS write FROM r""",
}
