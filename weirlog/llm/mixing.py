"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash; a source takes the documents whose hash lies below its threshold. The
threshold is found from histograms: tokens by source and hash bucket, the bucket in which the
budget runs out, and then the histogram of that bucket alone, until it holds one hash value. No
rows are sorted; thresholds are nested, so a larger budget takes all that a smaller one takes.
Documents with one hash are copies; of those at the threshold as many are taken as come nearest to the
target. A target above the source's size takes whole passes over the source and a part of the next.
Sources are rows of a table throughout; none of it is collected.

Defined results: a null text has size 0; a text of any length counts whole; null is a source of its
own, ordered last; a source without words has target 0; repeated rows are taken by their number; a tie
between two numbers of them goes to the smaller; an empty table gives no rows; further columns, whatever
their names, are not read, or, in `mixed`, come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.common import WORD, text_or_empty
from weirlog.scratch import Scratch

WEIGHTS, MOST = (1, 2, 3), 3
#: A hash has 60 bits; a level of the histogram refines the boundary bucket by so many.
BITS, STEP = 60, 12


def key():
    """60 bits of md5 over id, source and text; the same in other engines. The text enters by its own md5."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", part("doc_id"), part("source"), F.md5(text_or_empty())).cast("binary")), 1, 15), 16, 10).cast("long")


def numbered(names: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds `w`, the weight by place in order (null last). No task sees all names."""
    spread = scratch.write(names.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))
    # As many rows as partitions.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) + F.col("before") - 1
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    return spread.join(before, "part").withColumn("w", F.element_at(weights, (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))).drop("part", "before")


def targets(names: DataFrame, scratch: Scratch) -> DataFrame:
    """source, n, target, passes of sources (source, n): the share of each by weight; what exceeds a source's limit is shared again among the others.

    Sources below their limit get one amount per weight. Each round takes those over the limit out of it, and only three sums reach the driver.
    """
    weighed = scratch.write(numbered(names, scratch))
    total = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    whole = "cast({} as decimal(19,0))".format
    share, weight, fixed, last = total, None, F.lit(False), -1
    while True:
        r = weighed.agg(F.coalesce(F.sum(F.when(fixed, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~fixed, F.col("w"))), F.lit(0)).alias("w"), F.count_if(fixed).alias("fixed")).first()
        if r["fixed"] == last:
            break
        share, weight, last = total - MOST * r["n"], r["w"], r["fixed"]
        # share / weight is the amount per weight, compared in whole numbers.
        fixed = F.expr(f"{whole(share)} * w > {whole(MOST)} * n * {whole(weight)}") if weight else F.lit(True)
    if not weight:
        return weighed.select("source", "n", (F.col("n") * float(MOST)).alias("target"), F.lit(MOST).cast("long").alias("passes"))
    free = F.col("w").cast("double") * float(share) / float(weight)
    times = F.when(F.col("n") == 0, 0).otherwise(F.expr(f"{whole(share)} * w div ({whole(weight)} * n)"))
    return weighed.select("source", "n", F.when(fixed, F.col("n") * float(MOST)).otherwise(free).alias("target"), F.when(fixed, MOST).otherwise(F.least(times, F.lit(MOST))).cast("long").alias("passes"))


def _measured(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), key().alias("key"), *more)


def _of_source(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of their source; null is a source too. Spark broadcasts the sources if they are small, else splits the largest ones."""
    named = sources.withColumnRenamed("source", "__source")
    return rows.join(named, rows["source"].eqNullSafe(named["__source"]), how).drop("__source")


def thresholds(rows: DataFrame, goals: DataFrame, scratch: Scratch) -> DataFrame:
    """source, low, used: the hash at which a source's documents (source, key, size) run over `budget`, and what those below it hold. Sources that take no part of a pass are left out.

    A level has 2**STEP buckets a source and looks only into the boundary bucket of the level before.
    """
    now = goals.filter("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("used"))
    inside = rows.select("source", "key", "size")
    for left in range(BITS - STEP, -1, -STEP):
        bucket = F.expr(f"shiftright(key, {left})")
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").cast("long").alias("here"))
        upto = F.sum("here").over(Window.partitionBy("source").orderBy("bucket")) + F.col("used")
        edge = _of_source(sums, now).withColumn("upto", upto).filter("upto > budget").groupBy("source", "budget").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("here")).alias("used"))).alias("e"))
        now = scratch.write(edge.select("source", "budget", F.expr(f"shiftleft(e.bucket, {left})").alias("low"), F.col("e.used").alias("used")))
        if left:
            inside = _of_source(inside, now.select("source", "low")).filter(F.expr(f"shiftright(key, {left}) = shiftright(low, {left})")).select("source", "key", "size")
            if left == BITS - STEP:
                inside = scratch.write(inside)
    return now


def plan(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, target, passes, low, take of measured rows: whole passes, and of another pass all documents with a hash below `low` and `take` of those at it."""
    sizes = scratch.write(rows.groupBy("source").agg(F.sum("size").cast("long").alias("n")))
    goals = scratch.write(targets(sizes, scratch).withColumn("budget", F.col("target") - F.col("passes") * F.col("n")))
    found = thresholds(rows, goals, scratch)
    # Documents with one hash are equal, so some of them may be taken: as many as come nearest to the target.
    at = _of_source(rows, found.select("source", "low")).filter("key = low").groupBy("source").agg(F.sum("size").alias("here"), F.count("*").alias("m"))
    nearest = F.ceil((F.col("budget") - F.col("used")) / (F.col("here") / F.col("m")) - 0.5)
    edges = _of_source(found, at).select("source", "low", F.greatest(F.lit(0), F.least("m", nearest)).cast("long").alias("take"))
    known = _of_source(goals, edges, "left")
    return scratch.write(known.select("source", F.col("n").alias("source_size"), F.round("target", 6).alias("target"), "passes", F.coalesce("low", F.lit(-1)).cast("long").alias("low"), F.coalesce("take", F.lit(0)).cast("long").alias("take")))


def _decided(rows: DataFrame, sources: DataFrame, scratch: Scratch, tie) -> DataFrame:
    """Adds `times` to rows with the columns of `plan`. Only those at a source's boundary are ranked, by `tie`, in two levels, so that no task sees more of them than its part of the input."""
    joined = _of_source(rows, sources, "left")
    below = joined.filter("key <> low or take = 0").withColumn("times", F.col("passes") + (F.col("key") < F.col("low")).cast("long"))
    edge = joined.filter("key = low and take > 0").withColumn("__tie", tie).withColumn("__part", F.spark_partition_id())
    keys = ["source", "__tie", "__part"]
    counts = edge.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("source").orderBy("__tie", "__part")) - F.col("__n")).drop("__n")
    same = before.select(F.col("source").alias("__s"), F.col("__tie").alias("__t"), F.col("__part").alias("__p"), "__before")
    placed = edge.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy("__tie")))
    ranked = placed.join(same, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__tie") == F.col("__t")) & (F.col("__part") == F.col("__p"))).drop("__s", "__t", "__p")
    chosen = ranked.withColumn("times", F.col("passes") + (F.col("__before") + F.col("__place") <= F.col("take")).cast("long"))
    return below.unionByName(chosen.drop("__tie", "__part", "__place", "__before"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, times for every document."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(_measured(docs))
    decided = _decided(rows, plan(rows, scratch), scratch, F.lit(0))
    return decided.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, all columns, each as many times as it is taken. Of equal documents that differ in other columns the same ones are taken on every run."""
    scratch = Scratch(docs.sparkSession)
    sources = plan(scratch.write(_measured(docs)), scratch)
    packed = docs.select(F.col("source").cast("string").alias("source"), key().alias("key"), F.struct("*").alias("__row"))
    taken = _decided(packed, sources, scratch, F.xxhash64(F.to_json("__row"))).withColumn("__n", F.explode(F.expr("array_repeat(0, cast(times as int))")))
    return taken.select("__row.*")


SQL = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(source, chr(0)), md5(coalesce(text, '')))), 1, 15))::BIGINT AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM rows_ GROUP BY source),
share(round, source, n, w, target, fixed) AS (
  SELECT 0, source, n, w, (sum(n) OVER ())::DOUBLE * w / sum(w) OVER (), false FROM sizes
  UNION ALL
  SELECT round + 1, source, n, w,
    CASE WHEN fixed OR target > 3 * n THEN 3.0 * n
         ELSE ((sum(n) OVER ()) - sum(CASE WHEN fixed OR target > 3 * n THEN 3.0 * n ELSE 0 END) OVER ()) * w
              / sum(CASE WHEN fixed OR target > 3 * n THEN 0 ELSE w END) OVER () END,
    fixed OR target > 3 * n
  FROM share WHERE round < 40),
goal AS (SELECT source, n, target, least(3, floor(target / n)) AS passes FROM share WHERE round = 40),
run AS (SELECT r.*, g.n, g.target, g.passes, g.target - g.passes * g.n AS budget,
    sum(size) OVER (PARTITION BY r.source ORDER BY key) AS upto, row_number() OVER (PARTITION BY r.source, key) AS place FROM rows_ r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source),
group_ AS (SELECT source, key, sum(size) AS here, count(*) AS m FROM rows_ GROUP BY 1, 2),
edge AS (SELECT source, min(key) AS key FROM run WHERE upto > budget GROUP BY source),
told AS (SELECT doc_id, run.size, n, target, passes + CASE WHEN upto <= budget THEN 1
      WHEN run.key = edge.key AND place <= ceil((budget - (upto - here)) / (here / m) - 0.5) THEN 1 ELSE 0 END AS times
  FROM run LEFT JOIN edge ON run.source IS NOT DISTINCT FROM edge.source
    JOIN group_ g2 ON g2.source IS NOT DISTINCT FROM run.source AND g2.key = run.key)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target, (size * times)::BIGINT AS taken, times::BIGINT AS times FROM told
"""
