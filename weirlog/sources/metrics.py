"""Prometheus text: samples of name, labels and value, and generators of synthetic input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, labels (map), value of every sample line; comments and blank lines are left out."""
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+([0-9eE.+-]+|NaN|[+-]Inf)\s*(?:\d+)?$"
    rows = lines.filter(~F.col(column).startswith("#") & F.col(column).rlike(pattern))
    body = F.regexp_extract(column, pattern, 2)
    names, values = (F.regexp_extract_all(body, F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), F.lit(g)) for g in (1, 2))
    return rows.select(F.regexp_extract(column, pattern, 1).alias("name"), F.map_from_arrays(names, values).alias("labels"), F.regexp_extract(column, pattern, 3).cast("double").alias("number"))


def synthetic_events(spark: SparkSession, rows: int, hosts: int, accounts: int, seed: int = 1) -> DataFrame:
    """A fleet's events without any input: seeded hashes decide host, account, kind and size, so every run is alike.

    Of a thousand events two are identity, two account, one sync, the rest commits; one host in ten sends bad signatures.
    """
    r = lambda tag, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(tag)), F.lit(n))
    base = spark.range(rows).select("id", r("host", hosts).alias("h"), r("account", accounts).alias("did"), r("kind", 1000).alias("k"), (r("size", 10_000) / 10_000.0).alias("u"))
    kind = F.when(F.col("k") < 2, "identity").when(F.col("k") < 4, "account").when(F.col("k") < 5, "sync").otherwise("commit")
    # A long-tailed size: the quantile of a log-normal approximated by a power of the uniform.
    size = F.least(F.greatest(F.floor(5_200 * F.pow(F.lit(4.0), F.col("u") * 2 - 1)), F.lit(300)), F.lit(16_000))
    return base.select("id", F.concat(F.lit("host"), F.col("h").cast("string")).alias("host"), "did", kind.alias("kind"), size.alias("bytes"), ((F.col("h") % 10 == 1) & (F.col("k") % 10 < 6)).alias("bad_signature"))
