"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with one text are linked. Every document starts in a random shard, its label. Linked documents
move as a unit: all documents of a text, or, where they exceed a shard, parts of a quarter of a shard.
In each round every unit that has not moved yet asks for the shard, among those with room for it, that
holds most of its text's documents. Each shard admits units, large ones first, up to its quota; what an
admitted unit displaces takes the places that it left, so loads stay even. Rounds end when no unit is
admitted any more. Units left over fill the free places one after another, so that each free stretch
cuts one of them at most; unlinked documents fill the rest, and shard counts differ by at most one (law
`rows`). Rounds work on one row for each unit, never on documents. Only DataFrame operations are used.

Defined results: a null text has no bytes and is linked like an empty one; a text of any length counts
whole; a null doc_id is a row as any other; repeated rows are linked rows; ties between shards or units
go by hash; fewer rows than shards leave shards empty; an empty table gives no rows; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.common import text_or_empty
from weirlog.scratch import Scratch

SHARDS, OVERHEAD = 40, 16
#: Parts of a shard that a unit of a larger group fills; groups above one in HOT of all rows are few enough to broadcast.
UNITS_A_SHARD, HOT = 4, 1024
#: Rows are ranked in so many buckets; units of one size asking for one shard are admitted in so many.
BUCKETS, STEPS = 1024, 256


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), at + 1)


def _ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds a gapless rank from 0 among rows with one `by`, in two levels, so that no task sorts a whole shard."""
    placed = rows.withColumn("__bucket", F.pmod(F.xxhash64("row", F.lit(name)), F.lit(BUCKETS)))
    keys = [*by, "__bucket"]
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("__bucket") if by else Window.orderBy("__bucket")
    # At most BUCKETS rows for each value of `by`.
    before = sizes.select(*keys, (F.sum("n").over(upto) - F.col("n")).alias("__before"))
    numbered = placed.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy("row")))
    return numbered.join(before, keys).withColumn(name, F.col("__before") + F.col("__nth") - 1).drop("__bucket", "__before", "__nth")


def _summed(units: DataFrame, by: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds the sum of `n` of all units before this one with the same `by`, by bucket, then size and hash; in two levels."""
    placed = units.withColumn("__bucket", bucket)
    keys = [*by, "__bucket"]
    sizes = placed.groupBy(*keys).agg(F.sum("n").alias("__sum"))
    upto = Window.partitionBy(*by).orderBy("__bucket") if by else Window.orderBy("__bucket")
    before = sizes.select(*keys, (F.sum("__sum").over(upto) - F.col("__sum")).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.xxhash64("unit"), "unit")
    return placed.withColumn("__upto", F.sum("n").over(inside)).join(before, keys).withColumn(name, F.col("__before") + F.col("__upto") - F.col("n")).drop("__bucket", "__before", "__upto")


def _goal(room: list[int], turn: int) -> Column:
    """The shard a unit asks for: of those with room for it the one with most of its neighbours, where units of one large group take turns; without any such, one by hash; null if none has room."""
    order = sorted(range(len(room)), key=lambda s: (-room[s], s))
    fits = lambda shard: _pick(room, shard) >= F.col("n")
    votes = F.transform(F.filter("votes", lambda v: fits(v["shard"])), lambda v: F.struct(v["n"].alias("n"), F.xxhash64(F.col("gid"), v["shard"]).alias("tie"), v["shard"].alias("shard")))
    best = F.sort_array(votes, asc=False)
    turn_ = (F.col("part") / UNITS_A_SHARD).cast("int")
    many = F.size(F.filter(F.array(*(F.lit(room[s]).cast("long") for s in order)), lambda r: r >= F.col("n")))
    any_ = F.when(many > 0, _pick(order, F.pmod(F.xxhash64("unit", F.lit(turn)), many).cast("int")))
    return F.coalesce(F.try_element_at(best, turn_ + 1)["shard"], F.try_element_at(best, F.lit(1))["shard"], any_).cast("int")


def propagate(units: DataFrame, quota: list[int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """units: unit, gid, part, n, votes (array of shard and how many of the text's documents start there). Units with their shard, and units that no shard has room for."""
    room, left, admitted, turn = [*quota], scratch.write(units), [], 0
    # Large units first; the many of one size go by hash.
    size_class = F.lit(63) - F.floor(F.log2(F.col("n").cast("double")))
    bucket = size_class * STEPS + F.when(F.col("n") > 64, 0).otherwise(F.pmod(F.xxhash64("unit"), F.lit(STEPS)))
    while True:
        asked = left.withColumn("goal", _goal(room, turn))
        before = _summed(asked.filter("goal is not null"), ["goal"], bucket, "before")
        told = scratch.write(before.withColumn("in", F.col("before") + F.col("n") <= _pick(room, F.col("goal"))).unionByName(asked.filter("goal is null").withColumns({"before": F.lit(None).cast("long"), "in": F.lit(False)})))
        got = told.filter("in").groupBy("goal").agg(F.sum("n").alias("n")).collect()
        if turn:
            scratch.drop(left)
        if not got:
            break
        for r in got:
            room[r["goal"]] -= r["n"]
        admitted.append(told.filter("in").select("unit", F.col("goal").alias("shard"), "n"))
        left, turn = scratch.write(told.filter("not in").select("unit", "gid", "part", "n", "votes")), turn + 1
    whole = admitted[0] if admitted else units.limit(0).select("unit", F.lit(0).alias("shard"), "n")
    for more in admitted[1:]:
        whole = whole.unionByName(more)
    return whole, told.select("unit", "n")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), copies (documents of that text)."""
    scratch = Scratch(docs.sparkSession)
    text = text_or_empty()
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("gid"))
    rows = scratch.write(told.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = scratch.write(rows.groupBy("gid").agg(F.count("*").alias("copies")).filter("copies > 1"))
    # Fewer than HOT groups can hold more than one in HOT of all rows each: they are broadcast, the others meet in a shuffle.
    hot = F.broadcast(groups.filter(F.col("copies") * HOT > total).select("gid", F.col("copies").alias("many")))
    few = groups.filter(F.col("copies") * HOT <= total)
    seen = rows.join(hot, "gid", "left")
    rare = seen.filter("many is null").drop("many").join(few, "gid", "left")
    counted = rare.unionByName(seen.filter("many is not null").withColumnRenamed("many", "copies"))
    start = F.pmod(F.xxhash64("row", F.lit("start")), F.lit(shards)).cast("int")
    columns = ["row", "doc_id", "size", "text_crc32", "copies"]
    placed = scratch.write(counted.select(*columns[:-1], F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "gid", start.alias("start")))
    alone, linked = placed.filter("copies = 1"), placed.filter("copies > 1")
    # Groups above a shard are cut into parts of equal size, the others stay whole.
    most, part_size = max(2, total // shards), max(1, total // (shards * UNITS_A_SHARD))
    large = _ranked(linked.filter(F.col("copies") > most), ["gid"], "place").withColumn("part", (F.col("place") / part_size).cast("long")).drop("place")
    parted = scratch.write(linked.filter(F.col("copies") <= most).withColumn("part", F.lit(0).cast("long")).unionByName(large).withColumn("unit", F.xxhash64("gid", "part")))
    votes = parted.groupBy("gid", "start").agg(F.count("*").alias("n")).groupBy("gid").agg(F.collect_list(F.struct(F.col("start").alias("shard"), "n")).alias("votes"))
    units = parted.groupBy("unit", "gid", "part").agg(F.count("*").alias("n")).join(votes, "gid").select("unit", "gid", "part", "n", "votes")
    whole, over = propagate(units, quota, scratch)
    settled = parted.select(*columns, "unit").join(whole.select("unit", "shard"), "unit")
    stay = _ranked(settled, ["shard"], "slot")
    kept = [0] * shards
    for r in whole.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        kept[r["shard"]] = r["n"]
    # Units left over are consecutive in rank, so a shard's free places cut one of them at most.
    begun = _summed(over, [], F.pmod(F.xxhash64("unit"), F.lit(BUCKETS)), "begin")
    rest = _ranked(parted.select(*columns, "unit").join(begun.select("unit", "begin"), "unit"), ["unit"], "place").withColumn("rank", F.col("begin") + F.col("place"))
    used = over.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    pool = rest.select(*columns, "rank").unionByName(_ranked(alone.select(*columns), [], "rank").withColumn("rank", F.col("rank") + used))
    ends, upto = [], 0
    for k, q in zip(kept, quota, strict=True):
        upto += q - k
        ends.append(upto)
    free = F.array(*(F.lit(e).cast("long") for e in ends))
    into = pool.withColumn("shard", F.size(F.filter(free, lambda e: e <= F.col("rank"))).cast("int"))
    filled = into.withColumn("slot", _pick(kept, F.col("shard")) + F.col("rank") - _pick([0, *ends[:-1]], F.col("shard")))
    both = stay.select(*columns, "shard", "slot").union(filled.select(*columns, "shard", "slot"))
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "copies")
