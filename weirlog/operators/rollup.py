"""Partial and final roll-ups over nodes, merges that keep the newest, ownership, change feeds."""

from __future__ import annotations

from array import array
from heapq import heapify, heapreplace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.shipping import ship

# What an object-store request is billed as; every other one is class A.
REQUEST_CLASS = {"get": "b", "get_range": "b", "head": "b", "delete": "free", "mpu_abort": "free"}
STAR_AT = 256


def node_reports(samples: DataFrame, by: list[str], rates: list[str], worst: list[str]) -> DataFrame:
    """Partial aggregates of a node: sums of its rates, the worst of its latencies and lags."""
    return samples.groupBy(*by).agg(*(F.sum(c).alias(c) for c in rates), *(F.max(c).alias(c) for c in worst))


def fleet_overview(reports: DataFrame, rates: list[str], worst: list[str], newest: str) -> DataFrame:
    """The cluster from its nodes' reports; nodes that are stale don't count but are counted."""
    fresh = ~F.col("stale")
    return reports.agg(
        *(F.coalesce(F.sum(F.when(fresh, F.col(c))), F.lit(0)).alias(c) for c in rates), *(F.coalesce(F.max(F.when(fresh, F.col(c))), F.lit(0)).alias(c) for c in worst),
        F.max(F.when(fresh, F.col(newest))).alias(newest), F.count_if(fresh).alias("answered"), F.count("*").alias("members"),
    )


def merge_history(samples: DataFrame, node: str, t: str, rates: list[str], worst: list[str]) -> DataFrame:
    """Samples of all nodes by time: rates add up, latencies take the worst. As many of the newest times stay as the longest node history has."""
    keep = samples.groupBy(node).agg(F.count("*").alias("n")).agg(F.max("n").alias("keep"))
    merged = samples.groupBy(t).agg(*(F.sum(c).alias(c) for c in rates), *(F.max(c).alias(c) for c in worst))
    # Times are few (a ring a node), so their rank is one small sort.
    ranked = merged.withColumn("__n", F.row_number().over(Window.orderBy(F.col(t).desc())))
    return ranked.join(F.broadcast(keep)).filter(F.col("__n") <= F.col("keep")).drop("__n", "keep")


def health(members: DataFrame) -> DataFrame:
    """Whether a leader answers and most members do."""
    return members.agg(F.count_if(~F.col("stale")).alias("up"), F.count("*").alias("all"), F.bool_or((F.col("role") == "leader") & ~F.col("stale")).alias("leader")).select("up", "all", "leader", F.when(F.col("leader") & (F.col("up") * 2 > F.col("all")), "ok").when(F.col("up") * 2 > F.col("all"), "degraded").otherwise("down").alias("health"))


def owner_rows(rows: DataFrame, owners: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each host as its owner has it; the account count is the larger of both copies. A host whose owner didn't answer keeps this node's copy.

    rows: host, accounts, status. owners: host, node. theirs: node, host, accounts, status.
    """
    t = theirs.select(F.col("node"), "host", F.col("accounts").alias("t_accounts"), F.col("status").alias("t_status"))
    return rows.join(owners, "host", "left").join(t, ["host", "node"], "left").select("host", "node", F.when(F.col("t_status").isNotNull(), F.greatest("accounts", "t_accounts")).otherwise(F.col("accounts")).alias("accounts"), F.coalesce("t_status", "status").alias("status"))


def request_classes(counts: DataFrame, by: str) -> DataFrame:
    """Requests billed as a, b and free, by purpose, and their total."""
    table = F.create_map(*(F.lit(x) for pair in REQUEST_CLASS.items() for x in pair))
    kind = F.coalesce(F.element_at(table, F.col("op")), F.lit("a"))
    classed = counts.withColumn("class", kind)
    sums = [F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).cast("long").alias(c) for c in ("a", "b", "free")]
    return classed.rollup(by).agg(*sums).withColumn(by, F.coalesce(by, F.lit("total")))


def top_rejects(rows: DataFrame, host: str, limit: int) -> DataFrame:
    """Per host the sums over nodes and the newest sample, most rejects a second first."""
    merged = rows.groupBy(host).agg(F.sum("rate").alias("rate"), F.sum("total").alias("total"), F.max("at").alias("at"), F.max_by("sample", F.struct("at", "node")).alias("sample"))
    return merged.orderBy(F.col("rate").desc(), F.col("total").desc(), host).limit(max(1, min(500, limit)))


def commonest(rows: DataFrame, by: list[str], what: str, order: str, last: int, since: Column, index: Column) -> DataFrame:
    """The most frequent value among each group's last rows after a time; of equally frequent ones the last in `index` order."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    recent = rows.withColumn("__n", F.row_number().over(w)).filter((F.col("__n") <= last) & (F.col("at") >= since))
    counts = recent.groupBy(*by, what).agg(F.count("*").alias("n"), F.max(index).alias("i"))
    return counts.groupBy(*by).agg(F.max(F.struct("n", "i", what))[what].alias(what))


def newest(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key; partial aggregates merge in any order."""
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *columns)).alias("r")).select(*key, *(f"r.{c}" for c in [*order, *columns]))


def largest_cursors(maps: DataFrame, column: str) -> DataFrame:
    """Largest cursor of each host over all maps."""
    return maps.select(F.explode(column).alias("host", "cursor")).groupBy("host").agg(F.max("cursor").alias("cursor"))


def upsert_hosts(table: DataFrame, submitted: DataFrame) -> DataFrame:
    """A host table after a submission: tier and extra from the submitter, owner and cursor kept, source set once; `changed` says whether a row would be written."""
    s = submitted.select("host", F.col("tier").alias("s_tier"), F.col("extra").alias("s_extra"), F.col("source").alias("s_source"), F.lit(True).alias("sent"))
    both = table.join(s, "host", "full")
    new = both.select("host", F.coalesce("s_tier", "tier").alias("new_tier"), F.when(F.col("sent"), F.col("s_extra")).otherwise(F.col("extra")).alias("new_extra"), F.coalesce("source", "s_source").alias("new_source"), "owner", F.coalesce("cursor", F.lit(0)).alias("cursor"), "tier", "extra", "source", "sent")
    changed = F.coalesce(F.col("sent"), F.lit(False)) & ~(F.col("new_tier").eqNullSafe(F.col("tier")) & F.col("new_extra").eqNullSafe(F.col("extra")) & F.col("new_source").eqNullSafe(F.col("source")))
    return new.select("host", F.col("new_tier").alias("tier"), F.col("new_extra").alias("extra"), F.col("new_source").alias("source"), "owner", "cursor", changed.alias("changed"))


def ownership(hosts: DataFrame, members: DataFrame) -> DataFrame:
    """Hosts by owner; those whose owner is missing or unhealthy are unowned."""
    ok = members.filter("healthy").select(F.col("node").alias("owner"), F.lit(True).alias("ok"))
    return hosts.join(ok, "owner", "left").groupBy(F.when(F.col("ok"), F.col("owner")).otherwise("unowned").alias("owner")).agg(F.count("*").alias("hosts"))


def rendezvous(hosts: DataFrame, members: DataFrame) -> DataFrame:
    """The member of the highest affinity of each host. Members are a cluster's nodes, so each host meets each of them.

    The affinity is sha-256 of member and host: other engines compute the same placement.
    """
    pairs = hosts.join(F.broadcast(members.select("node")))
    affinity = F.sha2(F.concat_ws("/", "node", "host"), 256)
    return pairs.groupBy("host").agg(F.max_by("node", affinity).alias("node"))


def moves(accepted: DataFrame, account: str, order: list[str]) -> DataFrame:
    """Accounts a host gains and loses: the first acceptance adds one, a later one from another host moves it."""
    w = Window.partitionBy(account).orderBy(*order)
    last = accepted.select(account, "host", F.lag("host").over(w).alias("was"))
    changed = last.filter(F.col("was").isNull() | (F.col("was") != F.col("host")))
    each = changed.select(F.explode(F.array(F.struct(F.col("host").alias("h"), F.lit(1).alias("d")), F.struct(F.col("was").alias("h"), F.lit(-1).alias("d")))).alias("x"))
    return each.filter("x.h is not null").groupBy(F.col("x.h").alias("host")).agg(F.sum("x.d").alias("accounts"))


def changes(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows that differ from the one before of their key; the first always does."""
    w = Window.partitionBy(*key).orderBy(order)
    seen = rows.withColumn("__last", F.lag(F.struct(*columns)).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    return seen.filter(F.col("__first") | ~F.col("__last").eqNullSafe(F.struct(*columns))).drop("__last", "__first")


def coalesce_touches(touches: DataFrame, star_at: int = STAR_AT) -> DataFrame:
    """One event an id, the last touch's; above `star_at` ids of a kind and node one event for all, of the highest version.

    touches: flush, kind, node, id, at, version.
    """
    last = touches.groupBy("flush", "kind", "node", "id").agg(F.max_by("version", F.struct("at", "version")).alias("version"))
    groups = last.groupBy("flush", "kind", "node").agg(F.count("*").alias("ids"), F.max("version").alias("top"))
    many = groups.filter(F.col("ids") > star_at)
    few = last.join(groups.filter(F.col("ids") <= star_at).select("flush", "kind", "node"), ["flush", "kind", "node"])
    return few.select("flush", "kind", "node", "id", "version").union(many.select("flush", "kind", "node", F.lit("*"), "top"))


def resume_feed(feed: DataFrame, after: int, capacity: int) -> DataFrame:
    """Events after a position, and whether the ring no longer holds them all (then the reader must start over)."""
    ends = feed.agg(F.max("n").alias("head")).withColumn("floor", F.greatest(F.col("head") - capacity, F.lit(0)))
    state = ends.select("head", "floor", F.when(F.lit(after) > F.col("head"), "unknown").when(F.lit(after) < F.col("floor"), "expired").otherwise("ok").alias("state"))
    return feed.join(F.broadcast(state)).filter((F.col("state") == "ok") & (F.col("n") > after)).select(*feed.columns)


def rebalance(hosts: DataFrame, members: list[str], most: int | None = None) -> list[tuple[str, str]]:
    """The moves (host, new owner) of `rebalance_moves` in order, on the driver."""
    return [(r["host"], r["owner"]) for r in rebalance_moves(hosts, members, most).orderBy("step").collect()]


def rebalance_moves(hosts: DataFrame, members: list[str], most: int | None = None) -> DataFrame:
    """Moves (step, host, owner: the new one) that even out owned hosts among members until no two differ by more than one.

    Each takes from the member with the most (of equals the last by name) to the one with the fewest (the first by
    name), the host of the receiver's highest affinity; a round makes at most a 64th of all hosts, at least 4.

    Who gives and who receives follows from the counts alone, and no member does both. So a giver's hosts are chosen
    in a task of its own, from those that can be: of each receiver's ranking as many of the first as the giver gives.
    """
    names = sorted(set(members))
    ranked = hosts.select("host", "owner").filter(F.col("owner").isin(names))
    total = hosts.count() if most is None else 0
    held = dict.fromkeys(names, 0) | {r["owner"]: r["count"] for r in ranked.groupBy("owner").count().collect()}
    gives, takes = _even_out([held[m] for m in names], max(total // 64, 4) if most is None else most)
    schema = f"step long, host {hosts.schema['host'].dataType.simpleString()}, owner string"
    if not len(gives):
        return hosts.sparkSession.createDataFrame([], schema)
    turns = {names[g]: (at := np.flatnonzero(gives == g), takes[at]) for g in np.unique(gives).tolist()}
    needs = F.create_map(*(F.lit(x) for g, (at, _) in turns.items() for x in (g, len(at))))
    receivers = F.array(*(F.lit(names[t]) for t in np.unique(takes).tolist()))
    pairs = ranked.filter(F.col("owner").isin(list(turns))).select("host", "owner", F.explode(receivers).alias("receiver"))
    pairs = pairs.withColumn("affinity", F.sha2(F.concat("receiver", F.lit("/"), F.coalesce(F.col("host").cast("string"), F.lit("None"))), 256))
    # The bucket in which a receiver's ranking has as many hosts as the giver gives; at most 4,096 a pair.
    bucket = F.conv(F.substring("affinity", 1, 3), 16, 10).cast("int")
    sums = pairs.groupBy("owner", "receiver", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("owner", "receiver").orderBy(F.col("bucket").desc())) - F.col("n")
    edge = sums.withColumn("above", above).filter(F.col("above") < F.element_at(needs, F.col("owner"))).groupBy("owner", "receiver").agg(F.min("bucket").alias("low"))
    able = pairs.join(F.broadcast(edge), ["owner", "receiver"]).filter(bucket >= F.col("low")).groupBy("owner", "receiver", "affinity", "host").agg(F.count("*").alias("copies"))

    def choose(key, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.sort_by([("affinity", "descending")]).combine_chunks()
        host = pc.dictionary_encode(table["host"].combine_chunks(), null_encoding="encode")
        code, receiver = host.indices.to_numpy(), table["receiver"].to_numpy(zero_copy_only=False)
        left = np.zeros(len(host.dictionary), np.int64)
        left[code] = table["copies"].to_numpy()
        left = left.tolist()
        ranking = {r: iter(code[receiver == r].tolist()) for r in set(receiver)}
        first = {r: next(x) for r, x in ranking.items()}
        steps, to = turns[key[0].as_py()]
        chosen = []
        for r in (names[t] for t in to.tolist()):
            while not left[first[r]]:
                first[r] = next(ranking[r])
            left[first[r]] -= 1
            chosen.append(first[r])
        return pa.table({"step": pa.array(steps, pa.int64()), "host": host.dictionary.take(pa.array(chosen)), "owner": pa.array([names[t] for t in to.tolist()])})

    ship(hosts.sparkSession)
    return able.groupBy("owner").applyInArrow(choose, schema)


def _even_out(counts: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Giver and receiver of each move, by place.

    A member that received has one more than the fewest at most, and one that gave has one less than the most at
    least: neither can change sides while two still differ by more than one, so each side keeps its own counts.
    """
    high, low = [(-n, -i) for i, n in enumerate(counts)], [(n, i) for i, n in enumerate(counts)]
    heapify(high)
    heapify(low)
    gives, takes = array("l"), array("l")
    while high and len(gives) < most and -high[0][0] > low[0][0] + 1:
        (n, i), (m, j) = high[0], low[0]
        heapreplace(high, (n + 1, i))
        heapreplace(low, (m + 1, j))
        gives.append(-i)
        takes.append(j)
    return np.array(gives, np.int64), np.array(takes, np.int64)
