"""Two streams of the same events: occurrences, missing and extra, latency, order, greedy matches, mirrored hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrences(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds `occ`: the place among rows of one key, so that events without an id of their own pair off."""
    return rows.withColumn("occ", F.row_number().over(Window.partitionBy(*key).orderBy(order)))


def first_copies(streams: list[DataFrame], key: list[str], at: str) -> DataFrame:
    """The union of several streams; of each event the first copy counts."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.groupBy(*key).agg(F.min(at).alias(at))


def matched(left: DataFrame, right: DataFrame, key: list[str], at: str) -> DataFrame:
    """Full join of two streams on their key: `l_at`, `r_at` and the latency where both have the event."""
    both = left.select(*key, F.col(at).alias("l_at")).join(right.select(*key, F.col(at).alias("r_at")), key, "full")
    return both.withColumn("latency", F.col("r_at") - F.col("l_at"))


def diff_summary(pairs: DataFrame, by: str, lo: int, hi: int) -> DataFrame:
    """Per kind: both sides' counts, matches, what is missing or extra within the window."""
    inside = lambda c: F.col(c).between(lo, hi)
    return pairs.groupBy(by).agg(
        F.count("l_at").alias("up"), F.count("r_at").alias("relay"), F.count("latency").alias("matched"),
        F.count_if(F.col("r_at").isNull() & inside("l_at")).alias("missing"), F.count_if(F.col("l_at").isNull() & inside("r_at")).alias("extra"),
    )


def inversions(pairs: DataFrame, account: str, source: str, relay: str) -> DataFrame:
    """Adjacent events of an account, in source order, whose relay order is the other way round."""
    w = Window.partitionBy(account).orderBy(source)
    return pairs.withColumn("__last", F.lag(relay).over(w)).groupBy(account).agg(F.count_if(F.col(relay) < F.col("__last")).alias("inversions")).filter("inversions > 0")


def greedy(source: DataFrame, relay: DataFrame, key: list[str], at: str, ident: str) -> DataFrame:
    """For each source event in order, the first relay event of its key that is not earlier and not yet taken.

    Source events wait in a queue, and a relay event takes the longest waiting one. It finds the queue empty whenever
    relay events so far outnumber source events more than ever before; so running counts tell which relay events are
    taken, and the n-th of these goes to the n-th source event. A key's rows are sorted in one task and streamed.
    """
    both = source.select(*key, at, ident, F.lit(0).alias("side")).unionByName(relay.select(*key, at, ident, F.lit(1).alias("side")))
    upto = Window.partitionBy(*key).orderBy(at, "side", ident).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("__s", F.sum(1 - F.col("side")).over(upto)).withColumn("__r", F.sum("side").over(upto))
    idle = counted.withColumn("__idle", F.greatest(F.lit(0), F.max(F.col("__r") - F.col("__s")).over(upto)))
    left = idle.filter("side = 0").select(*key, F.col("__s").alias("__n"), F.col(ident).alias("source"), F.col(at).alias("__at"))
    # A relay event that finds none waiting raises the idle count; it shares its place with the taken one before it.
    right = idle.filter("side = 1").groupBy(*key, (F.col("__r") - F.col("__idle")).alias("__n")).agg(F.min(F.struct(at, ident)).alias("__taken"))
    found = left.join(right, [*key, "__n"])
    return found.select(*key, "source", F.col(f"__taken.{ident}").alias("relay"), (F.col(f"__taken.{at}") - F.col("__at")).alias("latency"))


def only_for_watched(relay: DataFrame, watched: DataFrame, matched_keys: DataFrame, account: str, key: list[str]) -> DataFrame:
    """Relay events of watched accounts that no source event matched."""
    return relay.join(watched, account, "left_semi").join(matched_keys, key, "left_anti")


def mirrored(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Whether two hosts send one sequence: pairs of names and the verdict.

    a, b: pair, seq, did. Events match by (seq, did); one that the other side has passed without sending tells them apart.
    """
    ends = a.groupBy("pair").agg(F.max("seq").alias("a_end")).join(b.groupBy("pair").agg(F.max("seq").alias("b_end")), "pair")
    both = a.select("pair", "seq", "did", F.lit(1).alias("in_a")).distinct().join(b.select("pair", "seq", "did", F.lit(1).alias("in_b")).distinct(), ["pair", "seq", "did"], "full").join(ends, "pair")
    counts = both.groupBy("pair").agg(
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("matches"),
        F.count_if((F.col("in_b").isNull() & (F.col("b_end") >= F.col("seq"))) | (F.col("in_a").isNull() & (F.col("a_end") >= F.col("seq")))).alias("differ"),
    )
    return counts.withColumn("verdict", F.when(F.col("differ") > 0, "differ").when(F.col("matches") >= least, "same").otherwise("open"))


def replayed(log: DataFrame, upto: int) -> DataFrame:
    """State at a position: the last write of each key. A null value is a deletion."""
    last = log.filter(F.col("seq") <= upto).groupBy("key").agg(F.max(F.struct("seq", "value")).alias("w"))
    return last.select("key", F.col("w.seq").alias("seq"), F.col("w.value").alias("value")).filter("value is not null")


def state_differences(state: DataFrame, replay: DataFrame, floor: int) -> DataFrame:
    """Keys of a state table against the replayed log: equal, different, missing (in the state) or extra; keys last written at or below the pruned floor can't be judged."""
    s, r = state.select("key", F.col("value").alias("s"), F.col("seq").alias("s_seq")), replay.select("key", F.col("value").alias("r"), F.col("seq").alias("r_seq"))
    both = s.join(r, "key", "full")
    verdict = F.when(F.col("r").isNull() & (F.col("s_seq") <= floor), "pruned").when(F.col("s").isNull(), "missing").when(F.col("r").isNull(), "extra").when(F.col("s") == F.col("r"), "equal").otherwise("different")
    return both.select("key", verdict.alias("verdict"))


def field_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of two servers that differ: the differing fields, or which side lacks the row."""
    both = a.select(key, *(F.col(f).alias(f"a_{f}") for f in fields), F.lit(True).alias("in_a")).join(b.select(key, *(F.col(f).alias(f"b_{f}") for f in fields), F.lit(True).alias("in_b")), key, "full")
    names = F.filter(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    what = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise(F.array_join(names, ","))
    return both.select(key, what.alias("differs")).filter("differs <> ''")
