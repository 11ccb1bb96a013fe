"""Small keyed operators over accounts, hosts, documents and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def start_positions(hosts: DataFrame, backfill: bool = False) -> DataFrame:
    """Where reading begins: at the head when that was asked for (once), else at the saved cursor, else at the head, or at 0 when backfilling.

    hosts: host, cursor, head, asked_head.
    """
    begin = F.when(F.col("asked_head"), F.col("head")).otherwise(F.coalesce("cursor", F.lit(0) if backfill else F.col("head")))
    return hosts.select("host", begin.alias("start"))


def authority(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Who may send an event: the host that the account's document names; anyone may pass an identity event on.

    events: id, did, host, kind. accounts: did, pds. Of an unknown account the document has to be looked up first.
    """
    joined = events.join(accounts, "did", "left")
    verdict = F.when(F.col("pds").isNull(), "resolve").when(F.col("pds") == F.col("host"), "ok").when(F.col("kind") == "identity", "pass").otherwise("wrong_host")
    return joined.select("id", "did", "host", "kind", verdict.alias("authority"))


def paired(left: DataFrame, right: DataFrame, key: str, at: str, within: int) -> DataFrame:
    """Receive and emit of one seq, whichever comes first; halves further apart than `within` don't pair."""
    both = left.select(key, F.col(at).alias("a")).join(right.select(key, F.col(at).alias("b")), key)
    return both.filter(F.abs(F.col("b") - F.col("a")) <= within).select(key, (F.col("b") - F.col("a")).alias("took"))


def once(rows: DataFrame, key: list[str], order: str, span: int | None = None) -> DataFrame:
    """The first row of each key; with a span, a repeat that much later counts again."""
    w = Window.partitionBy(*key).orderBy(order)
    if span is None:
        return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return rows.withColumn("__gap", F.col(order) - F.lag(order).over(w)).filter(F.col("__gap").isNull() | (F.col("__gap") > span)).drop("__gap")


def in_scope(relay: DataFrame, seen: DataFrame, at: str, hold: int) -> DataFrame:
    """Relay events of accounts that the source has shown, before or within `hold` after the event."""
    first = seen.groupBy("did").agg(F.min(at).alias("__first"))
    return relay.join(first, "did").filter(F.col("__first") <= F.col(at) + hold).drop("__first")


def operator_effects(accounts: DataFrame, actions: DataFrame) -> DataFrame:
    """Accounts after their latest action: a takedown, its reversal (which lifts a throttle too), or the release of a throttle.

    accounts: did, takedown, throttled. actions: did, at, action.
    """
    last = actions.groupBy("did").agg(F.max_by("action", "at").alias("action"))
    a = F.col("action")
    takedown = F.when(a == "takedown", True).when(a == "untakedown", False).otherwise(F.col("takedown"))
    throttled = F.when(a.isin("untakedown", "release"), False).otherwise(F.col("throttled"))
    out = accounts.join(last, "did", "left").withColumn("t", takedown).withColumn("h", throttled)
    changed = (F.col("t") != F.col("takedown")) | (F.col("h") != F.col("throttled"))
    return out.select("did", F.col("t").alias("takedown"), F.col("h").alias("throttled"), changed.alias("changed"))


def throttled_accounts(indexed: DataFrame, held: DataFrame, records: DataFrame, host: str) -> DataFrame:
    """Throttled accounts of a host: those of the index and those in memory, kept if their record still says so."""
    both = indexed.filter(F.col("host") == host).select("did").union(held.filter(F.col("host") == host).select("did")).distinct()
    return both.join(records.filter("throttled AND NOT takedown"), "did", "left_semi")


def changed_rows(table: DataFrame, reader: DataFrame) -> DataFrame:
    """Rows that a reader doesn't hold at the same epoch and version. reader: key, epoch, version."""
    have = reader.select("key", F.col("epoch").alias("__e"), F.col("version").alias("__v"))
    return table.join(have, "key", "left").filter(~(F.col("__e").eqNullSafe(F.col("epoch")) & F.col("__v").eqNullSafe(F.col("version")))).drop("__e", "__v")


def merged_policy(current: DataFrame, patch: DataFrame) -> DataFrame:
    """A document (path, value) with the named fields changed; a null takes a field out, the rest stays."""
    p = patch.select("path", F.col("value").alias("__new"), F.lit(True).alias("__named"))
    both = current.join(p, "path", "full")
    return both.select("path", F.when(F.col("__named"), F.col("__new")).otherwise(F.col("value")).alias("value")).filter("value is not null")


def rebased(base: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """A draft on a newer version: fields that both sides changed differently conflict, others take whichever side changed. All: path, value."""
    b, m, t = (f.select("path", F.col("value").alias(n)) for f, n in ((base, "b"), (mine, "m"), (theirs, "t")))
    both = b.join(m, "path", "full").join(t, "path", "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    conflict = ~same("m", "b") & ~same("t", "b") & ~same("m", "t")
    return both.select("path", F.when(same("m", "b"), F.col("t")).otherwise(F.col("m")).alias("value"), conflict.alias("conflict")).filter("value is not null or conflict")


def appended(items: DataFrame, by: str, order: str) -> DataFrame:
    """A batch's outcomes: appended items get the next seqs, and the batch's cursors ride on its first one.

    items: by (batch), order, outcome, cursor (a map). Outcomes other than `append` get no seq.
    """
    w = Window.partitionBy(by, F.col("outcome") == "append").orderBy(order)
    counts = items.filter("outcome = 'append'").groupBy(by).agg(F.count("*").alias("n"), F.max("cursor").alias("ride"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy(by)) - F.col("n"))
    rows = items.withColumn("rn", F.row_number().over(w)).join(before, by, "left")
    appended_ = F.col("outcome") == "append"
    return rows.select(by, order, "outcome", F.when(appended_, F.col("before") + F.col("rn")).alias("seq"), F.when(appended_ & (F.col("rn") == 1), F.col("ride")).alias("cursor"))


def leader_view(reports: DataFrame) -> DataFrame:
    """The export's state over members: the leader's counters, everyone's errors, the newest checkpoint. reports: node, leader, ops, errors, checkpoint, windows."""
    return reports.agg(
        F.max_by("node", F.when(F.col("leader"), F.lit(1))).alias("leader"), F.max(F.when(F.col("leader"), F.col("ops"))).alias("ops"), F.sum("errors").alias("errors"), F.max(F.when(F.col("windows") > 0, F.col("checkpoint"))).alias("checkpoint"),
        F.max_by("windows", F.when(F.col("windows") > 0, F.col("checkpoint"))).alias("windows"),
    )


def shortened(c: Column, most: int) -> Column:
    """Text cut after so many characters, marked with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def human(n: Column) -> Column:
    """A count as a short text: 999, 1.2k, 3.4M, 5.6G."""
    step = lambda unit, name: F.concat(F.format_string("%.1f", F.floor(n / (unit / 10)) / 10.0), F.lit(name))
    return F.when(n < 1_000, n.cast("string")).when(n < 1_000_000, step(1_000, "k")).when(n < 1_000_000_000, step(1_000_000, "M")).otherwise(step(1_000_000_000, "G"))


def report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows as lines of JSON, for report files."""
    rest = [c for c in rows.columns if c not in by]
    return rows.select(*by, F.to_json(F.struct(*rest)).alias("report"))


def host_detail(hosts: DataFrame, rejects: DataFrame, cases: DataFrame, recent: int) -> DataFrame:
    """A host with its reject counts by class, its newest rejects and its open cases. rejects: host, id, class; cases: host, case."""
    w = Window.partitionBy("host").orderBy(F.col("id").desc())
    newest = rejects.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= recent).groupBy("host").agg(F.sort_array(F.collect_list("id"), asc=False).alias("recent"))
    counts = rejects.groupBy("host", "class").agg(F.count("*").alias("n")).groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "class", "n"))), ",").alias("classes"))
    open_ = cases.groupBy("host").agg(F.sort_array(F.collect_set("case")).alias("cases"))
    return hosts.join(counts, "host", "left").join(newest, "host", "left").join(open_, "host", "left")
