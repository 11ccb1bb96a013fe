"""Policy decisions as columns: limits, admission, severity, statuses, document checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.functions import hosts
from weirlog.operators.lookup import most_specific

# Tiers, mildest first, and the order of severities.
TIERS = ("trusted", "default", "new", "throttled", "suspended", "banned")
SEVERITIES = ("info", "warn", "high", "critical")


def untrusted(accounts: Column) -> dict[str, Column]:
    """Limits of an untrusted host by the accounts it may have."""
    return {"events_per_sec": 50 + accounts / 1000, "events_per_hour": 2_500 + accounts, "events_per_day": 20_000 + 10 * accounts, "max_accounts": accounts}


def effective_limits(rows: DataFrame, rules: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tier and limits of each host from its record, the rule that decides it, its tier's limits and its own overrides.

    rows: host, tier, throttle_eps, max_override, seeded, alias_of. rules: id, pattern, effect, effect_tier, effect_eps.
    tiers: tier, events_per_sec, events_per_hour, events_per_day, max_accounts. Suspended and banned hosts have no limits.
    """
    named = rules.select("id", F.col("effect_tier"), F.col("effect_eps"))
    found = most_specific(rows, rules).join(F.broadcast(named), F.col("rule") == F.col("id"), "left").drop("id")
    fixed = F.col("tier").isin("suspended", "banned")
    tier = F.when(~fixed & (F.col("effect") == "ban"), "banned").when(~fixed & (F.col("effect") == "tier") & (F.col("tier") != "throttled"), F.col("effect_tier")).otherwise(F.col("tier"))
    cap = F.when(~fixed & (F.col("effect") == "throttle"), F.least("throttle_eps", "effect_eps")).otherwise(F.col("throttle_eps"))
    out = found.withColumn("now", tier).withColumn("cap", cap).drop("tier").withColumnRenamed("now", "tier").join(F.broadcast(tiers), "tier", "left")
    n = F.when(F.col("tier").isin("new", "default"), F.coalesce("seeded", F.lit(0))).otherwise(0)
    raised = lambda c, k: F.when(F.col(c) > 0, F.col(c) + k * n).otherwise(F.col(c))
    eps = F.col("events_per_sec") + n / 1000
    return out.select(
        "host", "tier", "rule",
        F.when(F.col("events_per_sec").isNotNull(), F.least(eps, "cap")).alias("events_per_sec"),
        raised("events_per_hour", 1).alias("events_per_hour"), raised("events_per_day", 10).alias("events_per_day"),
        F.when(F.col("events_per_sec").isNotNull(), F.coalesce("max_override", raised("max_accounts", 1))).alias("max_accounts"),
        (F.col("events_per_sec").isNotNull() & F.col("alias_of").isNull()).alias("connect"),
    )


def admission(requests: DataFrame, known: DataFrame, rules: DataFrame, trusted: DataFrame, *, crawl: bool = True, insecure: bool = False, allowlist_only: bool = False, initial: str = "new", a_day: int = 1 << 31) -> DataFrame:
    """Verdict on each request, the first failing check naming it; new hosts that nothing allows spend the day's budget in order of arrival.

    requests: id, s, raw, admin. known: host, tier. rules: id, pattern, effect, effect_tier. trusted: pattern.
    """
    parsed = requests.select("*", hosts.admissible(F.col("raw")).alias("p")).select(*requests.columns, "p.host", "p.insecure", F.col("p.error").alias("bad"))
    have = known.select("host", F.col("tier").alias("known"))
    ruled = most_specific(parsed, rules).join(F.broadcast(rules.select(F.col("id").alias("rule"), "effect_tier")), "rule", "left").join(have, "host", "left")
    trust = most_specific(ruled.select("host").distinct(), trusted.select(F.monotonically_increasing_id().alias("id"), "pattern", F.lit("trust").alias("effect"))).select(F.col("host").alias("__host"), (F.col("effect") == "trust").alias("trusted"))
    rows = ruled.join(trust, F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    admin = F.col("admin")
    allowed = F.col("trusted") | F.coalesce(F.col("effect") == "allow", F.lit(False))
    early = (
        F.when(F.lit(not crawl) & ~admin, "crawl_disabled").when(F.col("bad").isNotNull(), "bad_hostname").when(F.col("insecure") & F.lit(not insecure) & ~admin, "bad_hostname")
        .when(F.col("host").startswith("localhost") & ~admin, "localhost").when(F.col("effect") == "ban", "banned")
        .when(F.col("known").isin("banned", "suspended") & ~admin, "banned").when(F.col("known").isNotNull(), "known")
        .when(F.lit(allowlist_only) & ~allowed & ~admin, "not_allowed")
    )
    rows = rows.withColumn("early", early).withColumn("spends", F.col("early").isNull() & ~admin & ~allowed)
    # Of a host that asks again only its first admission is new; every request here is taken as the host's first.
    today = Window.partitionBy(F.floor(F.col("s") / 86_400), "spends").orderBy("s", "id")
    rows = rows.withColumn("place", F.row_number().over(today))
    verdict = F.coalesce("early", F.when(F.col("spends") & (F.col("place") > a_day), "daily_limit").otherwise("admit"))
    tier = F.when(F.col("effect") == "tier", F.col("effect_tier")).when(F.col("trusted"), "trusted").otherwise(initial)
    return rows.select("id", "host", verdict.alias("verdict"), F.when(verdict == "known", F.col("known")).when(verdict == "admit", tier).alias("tier"), (F.coalesce("early", F.lit("")) == "").alias("is_new"), F.when(verdict == "admit", F.col("spends")).otherwise(False).alias("counted"))


def severity(observed: Column, limit: Column, action: Column) -> Column:
    """Five times over the limit is critical whatever the action."""
    over = F.when(limit > 0, observed / limit).otherwise(1.0)
    return F.when(over >= 5, "critical").when(action.isin("throttle", "throttle-and-case"), "high").when(action == "case", "warn").otherwise("info")


def summary(rule: Column, host: Column, account: Column, observed: Column, limit: Column, window: Column) -> Column:
    """One line about a trip."""
    per = F.when(window == 60, "/min").when(window == 3600, "/h").otherwise(F.concat(F.lit(" per "), window.cast("string"), F.lit(" s")))
    who = F.when(account.isNotNull(), F.concat(account, F.lit(" on "), host)).otherwise(host)
    return F.concat(who, F.lit(": "), rule, F.lit(" "), F.round(observed).cast("long").cast("string"), per, F.lit(" (threshold "), F.round(limit).cast("long").cast("string"), F.lit(")"))


# What an inactive account's host may say, by the words it uses.
INACTIVE = ("takendown", "suspended", "deleted", "deactivated", "desynchronized", "throttled")


def upstream_status(active: Column, status: Column) -> Column:
    return F.when(active, "active").when(status.isin(*INACTIVE), status).otherwise("inactive")


def account_status(takedown: Column, throttled: Column, upstream: Column, desync: Column) -> Column:
    """The relay's own takedown, then its throttle, then what upstream says, then a broken chain."""
    return F.when(takedown, "takendown").when(throttled, "throttled").when(upstream != "active", upstream).when(desync.isNotNull(), "desynchronized").otherwise("active")


def drops_commits(takedown: Column, throttled: Column, upstream: Column) -> Column:
    return takedown | throttled | upstream.isin("takendown", "suspended", "deleted", "deactivated", "inactive")


def host_status(tier: Column, conn: Column, alias: Column) -> Column:
    """Status of a host for listings; an alias that isn't banned is offline."""
    own = F.when(tier == "banned", "banned").when(tier == "throttled", "throttled").when(tier == "suspended", "offline").otherwise(conn)
    return F.when(alias.isNotNull() & (tier != "banned"), "offline").otherwise(own)


def latest_commit_error(status: Column) -> Column:
    """The error that a lookup of the latest commit gives, null for an active account."""
    return (
        F.when(status == "takendown", "RepoTakendown").when(status == "suspended", "RepoSuspended").when(status == "deactivated", "RepoDeactivated")
        .when(status == "deleted", "RepoDeleted").when(status != "active", "RepoInactive")
    )


def violations(documents: DataFrame, checks: dict[str, Column], name: str = "violations") -> DataFrame:
    """Adds the list of the violated rules of each document, in order of the checks. A check that is null counts as violated."""
    every = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(path)) for path, ok in checks.items()))
    return documents.withColumn(name, F.filter(every, lambda x: x.isNotNull()))


def seed_update(reports: DataFrame, ttl: int) -> DataFrame:
    """Whether a report of a host's account count is written over what is stored.

    reports: accounts, from_, now, cur_accounts, cur_from, cur_at (nulls: nothing stored).
    """
    fresh = F.col("cur_at").isNotNull() & (F.col("now") - F.col("cur_at") < ttl)
    other_higher = fresh & (F.col("cur_from") != F.col("from_")) & (F.col("cur_accounts") >= F.col("accounts"))
    close = F.abs(F.col("cur_accounts") - F.col("accounts")) * 10 <= F.col("cur_accounts")
    recent = fresh & (F.col("cur_from") == F.col("from_")) & close & (F.col("now") - F.col("cur_at") < ttl // 2)
    return reports.withColumn("write", (F.col("accounts") > 0) & ~F.coalesce(other_higher, F.lit(False)) & ~F.coalesce(recent, F.lit(False)))


def backpressure(used: Column, cap: Column, held: Column) -> Column:
    """Whether reading stops: at the cap it does, and goes on again below nine tenths of it."""
    return F.when(used >= cap, True).when(used * 10 < cap * 9, False).otherwise(held)
