"""Routing, limits, first failing reason, reject classes, net operations, sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a frame.
FRAME_BYTES, COMMIT_CAR_BYTES, COMMIT_OPS, COMMIT_BLOCKS, SYNC_CAR_BYTES, FUTURE_S = 5 << 20, 2_000_000, 200, 8_192, 10_000, 300

# The class of each reason; every other reason is an invalid commit.
REJECT_CLASS = {
    "bad_signature": "bad_signature", "no_signing_key": "bad_signature",
    "frame_too_big": "too_large", "blocks_too_big": "too_large", "too_many_ops": "too_large", "too_many_blocks": "too_large",
    "bad_header": "malformed", "bad_frame": "malformed", "missing_field": "malformed", "bad_field": "malformed", "bad_seq": "malformed", "bad_did": "malformed", "bad_rev": "malformed",
    "stale": "rev_out_of_order", "rev_not_newer": "rev_out_of_order",
    "prev_data_mismatch": "prev_data_mismatch", "inversion_mismatch": "prev_data_mismatch", "desynchronized": "prev_data_mismatch", "chain": "prev_data_mismatch",
    "wrong_host": "wrong_host",
    "unknown_did": "unknown_did", "no_identity": "unknown_did", "identity_unavailable": "unknown_did",
    "inactive": "inactive",
    "rate_limited": "rate_limited", "new_account_deferred": "rate_limited",
}
# Failures that a second try may mend.
RETRYABLE = ("identity_unavailable", "store", "not_owner")


def first_failing(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check, in order, whose condition for failing holds; null if none does. A null condition doesn't fail."""
    return F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in checks))


def reject_class(reason: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in REJECT_CLASS.items() for x in pair))
    return F.when(reason.isNotNull(), F.coalesce(F.element_at(table, reason), F.lit("invalid_commit")))


def retryable(reason: Column) -> Column:
    return F.coalesce(reason.isin(*RETRYABLE), F.lit(False))


def commit_checks(seq: str = "seq", size: str = "size", did: str = "did", rev_s: str = "rev_s", now: str = "now", ops: str = "ops") -> list[tuple[str, Column]]:
    """Stateless checks of a commit, in their order. `ops`: array of struct(action, path, cid, prev)."""
    bad_op = lambda o: ~o["action"].isin("create", "update", "delete") | ~o["path"].rlike(r"^[A-Za-z0-9.]+/[A-Za-z0-9._:~-]+$") | (o["action"].isin("create", "update") & o["cid"].isNull()) | ((o["action"] == "delete") & o["cid"].isNotNull())
    return [
        ("frame_too_big", F.col(size) > FRAME_BYTES), ("bad_seq", F.col(seq) <= 0), ("bad_did", ~F.col(did).rlike("^did:[a-z]+:[a-zA-Z0-9._:%-]*[a-zA-Z0-9._-]$")),
        ("blocks_too_big", F.col(size) > COMMIT_CAR_BYTES), ("too_many_ops", F.size(ops) > COMMIT_OPS), ("future_rev", F.col(rev_s) > F.col(now) + FUTURE_S), ("bad_op", F.exists(ops, bad_op)),
    ]


def net_ops(ops: DataFrame, group: list[str], order: str = "i") -> DataFrame:
    """One row a group and path: before, needs_before, after, last, and whether the group's operations contradict one another.

    ops: group columns, order, action, path, cid, prev. A create fits only where the operation before left nothing; an
    update or delete only where it left a record, and that record if `prev` names one.
    """
    w = Window.partitionBy(*group, "path").orderBy(order)
    rows = ops.withColumn("left", F.lag("cid").over(w)).withColumn("first", F.row_number().over(w) == 1)
    fits = F.when(F.col("first"), True).when(F.col("action") == "create", F.col("left").isNull()).otherwise(F.col("left").isNotNull() & (F.col("prev").isNull() | (F.col("prev") == F.col("left"))))
    net = rows.withColumn("fits", fits).groupBy(*group, "path").agg(
        F.min(F.struct(order, "prev", (F.col("action") != "create").alias("needs"))).alias("a"), F.max(F.struct(order, "cid")).alias("z"), F.bool_and("fits").alias("fits")
    )
    return net.select(*group, "path", F.col("a.prev").alias("before"), F.col("a.needs").alias("needs_before"), F.col("z.cid").alias("after"), F.col(f"z.{order}").alias("last"), "fits")


def regressions(frames: DataFrame, socket: list[str], arrival: str, seq: str = "seq") -> DataFrame:
    """Adds `advances`: whether the sequence is above every earlier one on its socket."""
    w = Window.partitionBy(*socket).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("advances", F.col(seq) > F.coalesce(F.max(seq).over(w), F.lit(-1)))


def generations(frames: DataFrame, host: list[str], arrival: str, seq: str = "seq", drop: int = 0) -> DataFrame:
    """Adds `generation`: how often the host's sequence started over (fell by more than `drop`) so far, and `gap`: seqs skipped within it."""
    w = Window.partitionBy(*host).orderBy(arrival)
    last = F.lag(seq).over(w)
    rows = frames.withColumn("__fell", F.coalesce((last - F.col(seq) > drop).cast("int"), F.lit(0)))
    rows = rows.withColumn("generation", F.sum("__fell").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("gap", F.when(F.col("__fell") == 1, 0).otherwise(F.greatest(F.coalesce(F.col(seq) - last - 1, F.lit(0)), F.lit(0)))).drop("__fell")


def without_taken_down(events: DataFrame, takedowns: DataFrame, account: str = "did", kinds: tuple[str, ...] = ("commit", "sync")) -> DataFrame:
    """Drops commits and syncs of accounts whose latest action is a takedown; identity and account events pass.

    takedowns: account, at, id, active.
    """
    latest = takedowns.groupBy(account).agg(F.max(F.struct("at", "id", "active"))["active"].alias("active")).filter("active").select(account)
    held = events.filter(F.col("kind").isin(*kinds)).join(latest, account, "left_anti")
    return held.unionByName(events.filter(~F.col("kind").isin(*kinds)))
