"""Audits of a log: holes, gaps, prefixes, retention, commit index, acknowledgements, orphans, faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_gaps(gaps: DataFrame) -> DataFrame:
    """Recovery gaps (after, upto], those that touch or overlap made one. Gaps are as few as recoveries."""
    w = Window.orderBy("after", "upto")
    rows = gaps.withColumn("reach", F.max("upto").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("isle", F.sum(F.when(F.col("reach").isNull() | (F.col("after") > F.col("reach")), 1).otherwise(0)).over(w))
    return rows.groupBy("isle").agg(F.min("after").alias("after"), F.max("upto").alias("upto")).drop("isle")


def in_gap(seq: Column) -> Column:
    return (seq > F.col("after")) & (seq <= F.col("upto"))


def with_gap(rows: DataFrame, gaps: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds `gapped`: whether a row lies in one of the merged gaps, which are few and go to every task."""
    spans = merged_gaps(gaps).agg(F.collect_list(F.struct("after", "upto")).alias("spans"))
    return rows.join(F.broadcast(spans)).withColumn("gapped", F.exists("spans", lambda g: (F.col(seq) > g["after"]) & (F.col(seq) <= g["upto"]))).drop("spans")


def content_conflicts(observed: DataFrame) -> DataFrame:
    """Sequence numbers seen with more than one content."""
    return observed.groupBy("seq").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("seq", "n")


def steps(observed: DataFrame) -> DataFrame:
    """How each stream moves: the highest seq before, repeats and steps back, and the range that a step skips."""
    w = Window.partitionBy("stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = observed.withColumn("last", F.max("seq").over(w))
    return rows.withColumn("back", F.col("seq") <= F.col("last")).withColumn("from_", F.when(F.col("seq") > F.col("last") + 1, F.col("last") + 1)).withColumn("to_", F.when(F.col("seq") > F.col("last") + 1, F.col("seq") - 1))


def jumps(stepped: DataFrame, gaps: DataFrame) -> DataFrame:
    """Skipped ranges, each with whether recovery gaps cover it from end to end."""
    spans = merged_gaps(gaps).agg(F.collect_list(F.struct("after", "upto")).alias("spans"))
    rows = stepped.filter("from_ is not null").join(F.broadcast(spans))
    return rows.select("stream", "from_", "to_", F.exists("spans", lambda g: (g["after"] < F.col("from_")) & (g["upto"] >= F.col("to_"))).alias("covered"))


def acknowledged(acked: DataFrame, observed: DataFrame, gaps: DataFrame) -> DataFrame:
    """What became of each acknowledged event: ok, content (emitted with another), missing, reingested or lost (in a gap).

    acked: seq, content, did. observed: seq, content, did.
    """
    seen = observed.groupBy("seq").agg(F.min("content").alias("emitted"))
    highest = observed.groupBy("did").agg(F.max("seq").alias("top"))
    spans = merged_gaps(gaps).agg(F.collect_list(F.struct("after", "upto")).alias("spans"))
    rows = acked.join(seen, "seq", "left").join(highest, "did", "left").join(F.broadcast(spans))
    ends = F.transform(F.filter("spans", lambda g: (F.col("seq") > g["after"]) & (F.col("seq") <= g["upto"])), lambda g: g["upto"])
    rows = rows.withColumn("end", F.try_element_at(ends, F.lit(1)))
    fate = F.when(F.col("end").isNotNull(), F.when(F.col("top") > F.col("end"), "reingested").otherwise("lost")).when(F.col("emitted").isNull(), "missing").when(F.col("emitted") == F.col("content"), "ok").otherwise("content")
    return rows.select("seq", "did", fate.alias("fate"))


def duplicates(observed: DataFrame, gaps: DataFrame) -> DataFrame:
    """Events emitted under more than one seq, and whether a gap lies between."""
    spread = observed.groupBy("did").agg(F.countDistinct("seq").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).filter("n > 1")
    ends = gaps.agg(F.collect_list("upto").alias("ends"))
    return spread.join(F.broadcast(ends)).select("did", "n", F.exists("ends", lambda u: (F.col("lo") <= u) & (F.col("hi") > u)).alias("across"))


def log_mismatches(node_log: DataFrame, observed: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per node: seqs held with other content than emitted, and emitted seqs within its range that it lacks."""
    seen = with_gap(observed.groupBy("seq").agg(F.min("content").alias("emitted")), gaps)
    other = node_log.join(seen, "seq").filter(F.col("content") != F.col("emitted")).groupBy("node").agg(F.count("*").alias("other"))
    span = node_log.groupBy("node").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.countDistinct("seq").alias("held"))
    # Lacking = emitted seqs in the range outside gaps, less those held: two aggregates and a join per node, no list of seqs.
    covered = seen.filter(~F.col("gapped")).select("seq").join(F.broadcast(span), F.col("seq").between(F.col("lo"), F.col("hi"))).groupBy("node").agg(F.count("*").alias("due"))
    have = node_log.select("node", "seq").distinct().join(seen.filter(~F.col("gapped")).select("seq"), "seq", "left_semi").groupBy("node").agg(F.count("*").alias("have"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return span.join(other, "node", "left").join(covered, "node", "left").join(have, "node", "left").select("node", zero("other").alias("other"), (zero("due") - zero("have")).alias("lacking"))


def contiguous_prefix(rows: DataFrame, by: str, n: str, start: int = 1) -> DataFrame:
    """How far each group's numbers run on without a hole from `start`."""
    w = Window.partitionBy(by).orderBy(n)
    inside = rows.filter(F.col(n) >= start).select(by, n).distinct().withColumn("rn", F.row_number().over(w) - 1)
    return inside.groupBy(by).agg(F.count_if(F.col(n) == F.col("rn") + start).alias("prefix"))


def running_all(ok: Column, order: list[str], by: list[str] | None = None) -> Column:
    """Whether everything so far holds."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    return F.min(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1


def retention(segments: DataFrame, next_ordinal: int, flushed: int, horizon: int) -> DataFrame:
    """What may go: the longest prefix of old ordinals below the manifest's next, and stale segments past it.

    segments: ordinal, first, last, bytes, age. Segments are listed by one node, so one ordered pass serves.
    """
    named = segments.filter(F.col("ordinal") < next_ordinal).withColumn("go", running_all(F.col("age") >= horizon, ["ordinal"]))
    past = segments.filter((F.col("ordinal") >= next_ordinal) & (F.col("first") <= flushed))
    return named.filter("go").select("ordinal", "first", "last", "bytes", F.lit("old").alias("why")).union(past.select("ordinal", "first", "last", "bytes", F.lit("stale")))


def adopted(segments: DataFrame, next_ordinal: int, flushed: int) -> DataFrame:
    """Segments past the manifest that carry the log on: each begins where the last ended, at consecutive ordinals; those at or below the flushed position are stale and skipped."""
    w = Window.orderBy("ordinal")
    past = segments.filter(F.col("ordinal") >= next_ordinal).withColumn("__there", F.col("ordinal") - next_ordinal == F.row_number().over(w) - 1)
    past = past.withColumn("there", running_all(F.col("__there"), ["ordinal"])).filter("there")
    fresh = past.filter(F.col("first") > flushed)
    fresh = fresh.withColumn("on", running_all(F.col("first") == F.coalesce(F.lag("last").over(w), F.lit(flushed)) + 1, ["ordinal"]))
    return fresh.filter("on").select("ordinal", "first", "last")


def commit_index(matches: DataFrame, by: str, quorum: int) -> DataFrame:
    """The quorum-th largest matched position of each group, capped by its reserve; only matches of the current epoch count.

    matches: by, node, match, epoch, current, reserve.
    """
    own = matches.filter(F.col("epoch") == F.col("current"))
    top = own.groupBy(by).agg(F.sort_array(F.collect_list("match"), asc=False).alias("m"), F.max("reserve").alias("reserve"))
    return top.select(by, F.when(F.size("m") >= quorum, F.least(F.try_element_at("m", F.lit(quorum)), F.col("reserve"))).otherwise(0).alias("commit"))


def acked_prefix(seqs: DataFrame, by: str) -> DataFrame:
    """The highest done seq below the lowest that isn't (pending or failed); null where the first isn't done."""
    lows = seqs.groupBy(by).agg(F.min(F.when(F.col("state") != "done", F.col("seq"))).alias("open"), F.count_if(F.col("state") == "pending").alias("pending"))
    ahead = seqs.filter("state = 'done'").join(lows.select(by, "open"), by).filter("open is null or seq < open").groupBy(by).agg(F.max("seq").alias("cursor"))
    return lows.join(ahead, by, "left").select(by, "cursor", "pending")


def fault_sessions(faults: DataFrame, pauses: DataFrame, within: int) -> DataFrame:
    """Faults of one kind closer than `within` are one; each gets the longest pause that overlaps it.

    faults: kind, start, stop. pauses: start, stop.
    """
    w = Window.partitionBy("kind").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = faults.withColumn("new", F.when(reach.isNull() | (F.col("start") - reach > within), 1).otherwise(0)).withColumn("n", F.sum("new").over(w))
    merged = rows.groupBy("kind", "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("faults"))
    # A range join on buckets of a width: each side goes to the buckets it touches, and pairs meet by equality.
    width = 3600
    spread = lambda f, a, b: f.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    p = spread(pauses.select(F.col("start").alias("p0"), F.col("stop").alias("p1")), "p0", "p1")
    hit = spread(merged, "start", "stop").join(p, "bucket").filter((F.col("p0") <= F.col("stop")) & (F.col("p1") >= F.col("start")))
    best = hit.groupBy("kind", "n").agg(F.max(F.col("p1") - F.col("p0")).alias("pause"))
    return merged.join(best, ["kind", "n"], "left").select("kind", "start", "stop", "faults", "pause")


#: Seqs whose bytes are summed as one.
STRETCH = 4096


def byte_budget(entries: DataFrame, start: int, budget: int) -> DataFrame:
    """Entries from a seq while their bytes fit a budget; the first always comes."""
    # Bytes are summed in two levels: by stretch of seqs, then inside the stretches that the budget reaches.
    rows = entries.filter(F.col("seq") >= start).withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    sums = rows.groupBy("stretch").agg(F.sum("bytes").alias("sum"))
    earlier = sums.select("stretch", (F.sum("sum").over(Window.orderBy("stretch")) - F.col("sum")).alias("earlier")).filter(F.col("earlier") <= budget)
    inside = Window.partitionBy("stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(earlier, "stretch").withColumn("before", F.col("earlier") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    return placed.filter((F.col("before") + F.col("bytes") <= budget) | (F.col("before") == 0)).select(*entries.columns)


def tier_of(seq: Column, ring_from: int, disk_from: int) -> Column:
    """Where an entry is read from."""
    return F.when(seq >= ring_from, "ring").when(seq >= disk_from, "disk").otherwise("bucket")
