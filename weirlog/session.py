"""Session settings and table access shared by every query."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("weirlog")
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g"} | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
