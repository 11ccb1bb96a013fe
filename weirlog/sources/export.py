"""Identity exports: JSON lines of operations, read in time windows, deduplicated at page borders, newest kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.functions.hosts import url_host
from weirlog.functions.ids import valid_did

# Fixed value: the type that a service entry must have.
PDS_TYPE = "AtprotoPersonalDataServer"
SCHEMA = (
    "did string, cid string, createdAt string, nullified boolean, operation struct<type string, prev string, sig string, alsoKnownAs array<string>, verificationMethods map<string, string>, "
    "services map<string, struct<type string, endpoint string>>, signingKey string, service string, handle string>"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an export as `line`, with the file they come from."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def millis(rfc3339: Column) -> Column:
    """Milliseconds of a UTC timestamp, whatever the session's zone is; null if it isn't one."""
    plain = F.regexp_extract(rfc3339, r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(\.\d{1,6})?Z$", 0)
    stamp = F.concat(F.substring(plain, 1, 10), F.lit(" "), F.regexp_replace(F.substring(plain, 12, 16), "Z$", ""))
    days = F.unix_date(stamp.substr(1, 10).try_cast("date"))
    part = lambda i: F.substring(stamp, i, 2).try_cast("long")
    fraction = F.rpad(F.regexp_extract(stamp, r"\.(\d{1,6})$", 1), 3, "0").substr(1, 3).try_cast("long")
    return days.cast("long") * 86_400_000 + part(12) * 3_600_000 + part(15) * 60_000 + part(18) * 1_000 + fraction


def parse(lines: DataFrame) -> DataFrame:
    """A row for each line: did, created_ms, tombstone, key, pds, and `problem` for lines that give no operation.

    Current operations name key and service by map, the oldest ones by plain fields; a tombstone has neither. A bad
    line still has its time if that can be read, so a reader's position moves on past it.
    """
    # An exploded array of one keeps each line parsed once: a plain column would be copied into every field that reads it.
    once = lambda x: F.explode(F.array(x))
    r = lines.select("*", once(F.from_json("line", SCHEMA)).alias("r"))
    op = F.col("r.operation")
    listed = op["services"]["atproto_pds"]
    endpoint = F.coalesce(F.when(listed["type"] == PDS_TYPE, listed["endpoint"]), F.when(op["type"] == "create", op["service"]))
    told = F.struct(
        F.col("r.did").alias("did"), millis(F.col("r.createdAt")).alias("created_ms"), F.coalesce("r.nullified", F.lit(False)).alias("nullified"), (op["type"] == "plc_tombstone").alias("tombstone"),
        F.coalesce(op["verificationMethods"]["atproto"], op["signingKey"]).alias("key"), url_host(F.when(endpoint.startswith("http"), endpoint)).alias("pds"),
    )
    out = r.select(*lines.columns, once(told).alias("__told")).select(*lines.columns, "__told.*")
    problem = F.when(F.col("did").isNull() | F.col("created_ms").isNull(), "unreadable").when(~valid_did(F.col("did")), "bad_did").when(F.col("nullified"), "nullified")
    return out.withColumn("problem", problem)


def page_border(rows: DataFrame, after_ms: int, seen_dids: list[str]) -> DataFrame:
    """Drops what a reader that stopped at `after_ms` has read: older operations, and those of that instant whose account it saw."""
    again = (F.col("created_ms") == after_ms) & F.col("did").isin(seen_dids) if seen_dids else F.lit(False)
    return rows.filter((F.col("created_ms") >= after_ms) & ~again)


def newest(rows: DataFrame) -> DataFrame:
    """The last operation of each account. Merges in any order; equal times go to the larger row."""
    usable = rows.filter("problem is null")
    return usable.groupBy("did").agg(F.max(F.struct("created_ms", "tombstone", "key", "pds")).alias("r")).select("did", "r.*")


def choose(records: DataFrame, seeds: DataFrame, now_s: int, ttl_s: int) -> DataFrame:
    """For each account whether the stored record, the export's row, or a new lookup answers.

    records: did, key, pds, fetched_s (0: an identity event that hasn't been looked up since). seeds: did, key, pds,
    created_ms, tombstone. A record looked up within the time to live wins unless the row's operation is newer. A row
    of any age serves, unless it is older than the time to live and the account shows a change since.
    """
    r = records.select("did", F.col("key").alias("r_key"), F.col("pds").alias("r_pds"), "fetched_s")
    usable = seeds.filter(~F.col("tombstone") & F.col("key").isNotNull() & F.col("pds").isNotNull())
    s = usable.select("did", F.col("key").alias("s_key"), F.col("pds").alias("s_pds"), F.floor(F.col("created_ms") / 1000).alias("seed_s"))
    both = r.join(s, "did", "full").join(seeds.select("did").distinct().withColumn("listed", F.lit(True)), "did", "full")
    fresh = F.coalesce(F.col("r_key").isNotNull() & F.col("r_pds").isNotNull() & (F.col("fetched_s") != 0) & (now_s - F.col("fetched_s") < ttl_s), F.lit(False))
    moved = ~(F.col("r_key").eqNullSafe(F.col("s_key")) & F.col("r_pds").eqNullSafe(F.col("s_pds")))
    unless = F.col("fetched_s").isNotNull() & (now_s - F.col("seed_s") >= ttl_s) & ((F.col("fetched_s") == 0) | ((F.col("fetched_s") > F.col("seed_s")) & moved))
    what = F.when(F.col("seed_s").isNull(), F.when(fresh, "record").otherwise("resolve")).when(fresh, F.when(F.col("fetched_s") > F.col("seed_s"), "record").otherwise("seed")).when(unless, "resolve").otherwise("seed")
    return both.select("did", what.alias("use"))


def host_list(pages: DataFrame) -> DataFrame:
    """Hosts of paged listings (`body`): an account count only counts when the host is active, idle or says nothing."""
    r = pages.select(F.explode(F.from_json("body", "hosts array<struct<hostname string, accountCount long, status string>>").getField("hosts")).alias("h"))
    counts = F.col("h.status").isNull() | F.col("h.status").isin("active", "idle")
    return r.select(F.col("h.hostname").alias("host"), F.when(counts, F.col("h.accountCount")).alias("accounts"), F.col("h.status").alias("status"))


def queue(hosts: DataFrame, limit: int) -> DataFrame:
    """The discovery queue: most accounts first, equal ones in list order (`place`)."""
    return hosts.orderBy(F.coalesce("accounts", F.lit(0)).desc(), "place").limit(limit)
