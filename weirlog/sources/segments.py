"""A log as Parquet segments under a manifest: written once, committed last, read by range."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def flush(log: DataFrame, root: str, ordinal: int, rows_a_file: int = 1_000_000) -> dict:
    """Writes entries (seq, ...) as the segment of an ordinal, sorted by seq so that files hold narrow ranges; gives its reference."""
    path = f"{root}/segment={ordinal:010d}"
    log.repartitionByRange("seq").sortWithinPartitions("seq").write.option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").mode("errorifexists").parquet(path)
    r = log.sparkSession.read.parquet(path).agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    return {"ordinal": ordinal, "first": r[0], "last": r[1], "rows": r[2]}


def commit(spark: SparkSession, root: str, segments: list[dict], version: int) -> None:
    """Publishes a manifest version. The rename is the commit: it fails if another writer has published that version."""
    jvm, temporary, fs = _fs(spark, f"{root}/_manifest/.{version}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps({"version": version, "segments": segments}).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest/{version:010d}.json")
    if fs.exists(final) or not fs.rename(temporary, final):
        raise RuntimeError(f"manifest version {version} exists")


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest; segments that it doesn't name are not part of the log."""
    _, at, fs = _fs(spark, f"{root}/_manifest")
    if not fs.exists(at):
        return None
    names = sorted(str(f.getPath()) for f in fs.listStatus(at) if str(f.getPath()).endswith(".json"))
    return json.loads(spark.read.text(names[-1], wholetext=True).first()[0]) if names else None


def scan(spark: SparkSession, root: str, after: int = 0, upto: int = (1 << 63) - 1) -> DataFrame:
    """Committed entries in (after, upto]; only segments that overlap are opened, and the filter reaches the files."""
    named = (manifest(spark, root) or {"segments": []})["segments"]
    paths = [f"{root}/segment={s['ordinal']:010d}" for s in named if s["last"] > after and s["first"] <= upto]
    if not paths:
        raise FileNotFoundError(f"no committed segment of {root} overlaps ({after}, {upto}]")
    return spark.read.parquet(*paths).filter((F.col("seq") > after) & (F.col("seq") <= upto))


def changed_since(spark: SparkSession, path: str, millis: int) -> DataFrame:
    """Files of a folder modified after a time, with their content; unchanged ones are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.unix_millis("modificationTime") > millis).select("path", "modificationTime", "content")
