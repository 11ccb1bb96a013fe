"""Streams over files: windowed counts, deduplication, pairing, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, name: str, schema, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder whose names match; few at a time, as back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(path)


def window_counts(rows: DataFrame, at: str, width: str, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """Counts by window and key, emitted once the watermark has passed the window."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def deduplicated(rows: DataFrame, at: str, keys: list[str], within: str) -> DataFrame:
    """The first of each key; a repeat within the watermark's span is dropped."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def paired(left: DataFrame, right: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """Receive and emit of one seq, whichever comes first; halves older than `within` are let go."""
    a = left.select(F.col(key).alias("a_key"), F.col(at).alias("a_at")).withWatermark("a_at", within)
    b = right.select(F.col(key).alias("b_key"), F.col(at).alias("b_at")).withWatermark("b_at", within)
    close = F.expr(f"a_key = b_key AND b_at BETWEEN a_at - INTERVAL {within} AND a_at + INTERVAL {within}")
    return a.join(b, close).select(F.col("a_key").alias(key), "a_at", "b_at")


def drain(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Takes everything that is there now, batch after batch, into an idempotent sink; restarts resume at the checkpoint."""
    query: StreamingQuery = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch has a folder of its own, overwritten when it comes again: at-least-once batches, rows once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def upsert_sink(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A table of the newest row of each key, rewritten as a new version per batch; readers take the highest one."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number > 0:
            new = new.unionByName(spark.read.parquet(f"{path}/version={number - 1}"))
        value = [c for c in new.columns if c not in key and c not in order]
        newest = new.groupBy(*key).agg(F.max(F.struct(*order, *value)).alias("r")).select(*key, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/version={number}")

    return write
