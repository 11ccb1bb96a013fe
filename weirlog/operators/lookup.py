"""Rules, priorities and aliases: joins that pick one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.functions import hosts
from weirlog.operators.windows import ranked


def rule_candidates(names: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Every rule (id, pattern, effect) that covers a host, with `place`: 0 for the exact name, 1 for the name without its port, then by wildcards from the longest.

    Hosts are exploded into their suffixes and met by equality, so no pattern is compared with every host. Rules are
    operator-written and few; the optimizer decides how to ship them.
    """
    wild = rules.filter(F.col("pattern").startswith("*.")).withColumn("name", F.regexp_replace("pattern", r"^\*\.", ""))
    exact = rules.filter(~F.col("pattern").startswith("*.")).withColumn("name", F.col("pattern"))
    bare = F.element_at(F.split(F.col(host), ":"), 1)
    keys = F.array(F.struct(F.col(host).alias("name"), F.lit(0).alias("place")), F.struct(bare.alias("name"), F.lit(1).alias("place")))
    by_name = names.withColumn("__k", F.explode(keys)).select("*", "__k.name", "__k.place").drop("__k").join(exact, "name")
    by_suffix = names.select("*", F.posexplode(hosts.suffixes(F.col(host))).alias("__i", "name")).withColumn("place", F.col("__i") + 2).drop("__i").join(wild, "name")
    return by_name.unionByName(by_suffix).drop("name")


def most_specific(names: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """The rule that decides each host; hosts without one have nulls."""
    best = rule_candidates(names.select(host).distinct(), rules, host).groupBy(host).agg(F.min(F.struct("place", "id", "pattern", "effect")).alias("r"))
    return names.join(best, host, "left").select(*names.columns, F.col("r.id").alias("rule"), F.col("r.pattern").alias("pattern"), F.col("r.effect").alias("effect"))


def overridden(names: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """For each decided host the winner and the rule it would fall to without the winner."""
    found = rule_candidates(names.select(host).distinct(), rules, host).groupBy(host, "id").agg(F.min("place").alias("place"))
    order = ranked(found, [host], [F.col("place"), F.col("id")], 2)
    return order.groupBy(host).agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("winner"), F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("fallback"))


def suffix_verdict(names: DataFrame, allow: DataFrame, bans: DataFrame, allows: DataFrame, host: str = "host") -> DataFrame:
    """Exact allow list first; then the longest suffix, a ban before an allow of one length; else unknown."""
    name = names.select(host).distinct()
    suffix = name.select(host, F.explode(hosts.suffixes(F.col(host))).alias("base"))
    lists = bans.select("base", F.lit(1).alias("ban")).union(allows.select("base", F.lit(0).alias("ban")))
    best = suffix.join(lists, "base").groupBy(host).agg(F.max(F.struct(F.length("base").alias("n"), "ban"))["ban"].alias("ban"))
    listed = allow.select(F.col("base").alias(host), F.lit(True).alias("exact")).distinct()
    verdict = F.when(F.col("exact"), "allow").when(F.col("ban") == 1, "ban").when(F.col("ban") == 0, "allow").otherwise("unknown")
    return names.join(best, host, "left").join(listed, host, "left").select(*names.columns, verdict.alias("verdict"))


def resolve_aliases(names: DataFrame, aliases: DataFrame, hops: int = 4) -> DataFrame:
    """Follows `alias_of` up to `hops` steps; adds `target` and `steps`. A cycle ends where the hops do."""
    out = names.withColumn("target", F.col("host")).withColumn("steps", F.lit(0))
    for _ in range(hops):
        step = aliases.select(F.col("host").alias("__h"), F.col("alias_of").alias("__to"))
        out = out.join(step, F.col("target") == F.col("__h"), "left").withColumn("steps", F.col("steps") + F.col("__to").isNotNull().cast("int"))
        out = out.withColumn("target", F.coalesce("__to", "target")).drop("__h", "__to")
    return out


def first_known(keys: DataFrame, sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Values from the first source that has the key, and `source`, its place from 0 (null: none)."""
    out = keys
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.struct(*columns).alias(f"__s{i}")), key, "left")
    pick = F.coalesce(*(F.col(f"__s{i}") for i in range(len(sources))))
    place = F.coalesce(*(F.when(F.col(f"__s{i}").isNotNull(), F.lit(i)) for i in range(len(sources))))
    return out.select(*keys.columns, *(pick[c].alias(c) for c in columns), place.alias("source"))
