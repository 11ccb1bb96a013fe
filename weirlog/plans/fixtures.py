"""How the given tables stand for the event log: a Spark frame and the SQL of the same rows, side by side.

An event of `events` is a frame of the host its user maps to; purchases are commits, sign-ups account
events, views identity events, clicks syncs, and errors rejected frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.session import table

HOSTS = 10
KIND = {"purchase": "commit", "signup": "account", "view": "identity", "click": "sync", "error": "reject"}


def micros(column: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS TIMESTAMP_NTZ))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us, s, user_id, host, kind, value, k."""
    kind = F.create_map(*(F.lit(x) for pair in KIND.items() for x in pair))
    rows = table(spark, sf_dir, "events").withColumn("us", micros("ts"))
    return rows.select(
        "event_id", "us", F.floor(F.col("us") / 1_000_000).alias("s"), "user_id", F.concat(F.lit("host"), (F.col("user_id") % HOSTS).cast("string")).alias("host"),
        F.element_at(kind, F.col("event_type")).alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EV = """ev AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s, user_id, 'host' || (user_id % 10) AS host,
  CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'account' WHEN 'view' THEN 'identity' WHEN 'click' THEN 'sync' ELSE 'reject' END AS kind,
  value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small inline table."""
    return spark.createDataFrame(rows, schema)


def sql_values(name: str, rows: list[tuple], columns: str) -> str:
    """The same inline table in SQL."""
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"
