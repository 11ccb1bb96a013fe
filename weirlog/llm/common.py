"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.shipping import ship

__all__ = ["WORD", "documents", "id_bucket", "lean", "ship", "slices", "text_or_empty"]

#: Fixed: what separates words, as a regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (null: empty) and source of the documents, other columns left behind."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_bucket(mod: int, name: str = "doc_id") -> Column:
    """crc32(id as text) mod a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % mod


def slices(lengths: list[int], most: int):
    """Ranges of consecutive items whose lengths sum to about `most`; a longer item stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def lean(work):
    """A batch function whose worker gives free memory back to the system after each task, so that reused workers stay small."""

    @functools.wraps(work)
    def run(batches):
        import pyarrow as pa

        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass

    return run
