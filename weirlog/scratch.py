"""Tables written to the shared checkpoint folder to cut lineage.

Executors may be lost at any time, so an intermediate that is read more than once is written as
Parquet to the folder that the cluster names in ``spark.checkpoint.dir``. Where that setting is
absent, a local session (tests, a laptop) takes a temporary folder and any other is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weirlog-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_roots: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Removes the tables of all queries so far. A lazy result of one of them can't be computed after that; it is called when Python ends."""
    while _roots:
        _delete(*_roots.pop())


atexit.register(release)


@contextmanager
def lifetime():
    """Tables made inside are removed at its end; results must have been written or collected by then."""
    mark = len(_roots)
    try:
        yield
    finally:
        while len(_roots) > mark:
            _delete(*_roots.pop())


class Scratch:
    """Tables of one query. Frames derived from them are lazy and may be used at any later time, so only what drop() names goes before the end of a lifetime() or release()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/weirlog-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        _roots.append((spark, self.root))

    def write(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """The table, read back. It has a file for each task of the stage that makes it; adaptive execution sizes those tasks by bytes."""
        path = f"{self.root}/{len(self.paths)}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    try:
        if sc._jsc is None or sc._jsc.sc().isStopped():
            return
    except Exception:  # noqa: BLE001  the JVM has gone, with it the way to the folder
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
