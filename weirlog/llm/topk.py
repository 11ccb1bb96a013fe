"""Exact top-k inner products: tiled matrix products, partial selection in each tile, tree merging.

Queries come in blocks of bounded size, each broadcast once. A task multiplies the block with one
tile of its candidates after another, selects each tile's best by partition, and merges them into
its running best; the tasks' lists are then merged in lanes and finally by query.

Components become floor(256 x) and products are exact: in doubles where every partial sum stays
below 2**53, in whole numbers of any size otherwise (scores beyond 64 bits are held at their limits).

Defined results: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; vectors are compared with those of their own length; rows with the query's id are
its own and no candidates of it; a query id that repeats asks once, with its least vector; repeated
candidates each count; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.common import lean, ship
from weirlog.scratch import Scratch

SCALE, EVERY, K = 256, 50, 5
BLOCK, TILE, LANES = 2048, 1024, 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact scores of two integer-valued double matrices; int64."""
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= 2.0**53:
        whole = [[int(x) for x in row] for row in c.tolist()]
        return np.array([[min(_HIGH, max(_LOW, sum(a * b for a, b in zip(map(int, row), other, strict=True)))) for other in whole] for row in q.tolist()], np.int64)
    return (q @ c.T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row by score, then smaller id, in order: scores, ids, and whether there is one. `ids` ascend along a row."""
    n = scores.shape[1]
    held = np.where(allowed, scores, _LOW)
    if n > k:
        edge = np.partition(held, n - k, axis=1)[:, n - k, None]
        above, at = held > edge, held == edge
        # At the edge a candidate that is allowed comes before one that is not.
        at_ok = at & allowed
        need = k - above.sum(1, keepdims=True)
        take = above | (at_ok & (np.cumsum(at_ok, 1) <= need))
    else:
        take = allowed
    order = np.argsort(~take, axis=1, kind="stable")[:, : min(k, n)]
    row = np.arange(len(scores))[:, None]
    s, i, ok = held[row, order], ids[row, order] if ids.ndim == 2 else ids[order], take[row, order]
    place = np.lexsort((i, ~s, ~ok), axis=1)  # ~s orders as -s without overflow
    return s[row, place], i[row, place], ok[row, place]


def _partial(block: list[tuple[int, list[float]]], k: int):
    by_length: dict[int, list] = {}
    for q, v in block:
        by_length.setdefault(len(v), []).append((q, v))
    asked = {n: (np.array([q for q, _ in x], np.int64), np.floor(SCALE * np.array([v for _, v in x], np.float64)).reshape(len(x), n)) for n, x in by_length.items()}

    def tile(state, ids, q, matrix, c):
        order = np.argsort(ids, kind="stable")
        ids, c = ids[order], c[order]
        found = best(products(matrix, c), ids, q[:, None] != ids[None, :], k)
        if state is None:
            return found
        s, i, ok = (np.concatenate(x, axis=1) for x in zip(state, found, strict=True))
        row, place = np.arange(len(s))[:, None], np.lexsort((i, ~s, ~ok), axis=1)[:, :k]
        return s[row, place], i[row, place], ok[row, place]

    def go(batches):
        state = dict.fromkeys(asked)
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            values, starts = np.floor(SCALE * column.values.to_numpy()), column.offsets.to_numpy()
            for n, (q, matrix) in asked.items():
                rows = np.flatnonzero(lengths == n)
                for a in range(0, len(rows), TILE):
                    part = rows[a : a + TILE]
                    state[n] = tile(state[n], ids[part], q, matrix, values[starts[part][:, None] + np.arange(n)])
        for n, found in state.items():
            if found is not None:
                s, i, ok = found
                names = np.repeat(asked[n][0], s.shape[1]).reshape(s.shape)
                yield pa.RecordBatch.from_arrays([pa.array(names[ok]), pa.array(i[ok]), pa.array(s[ok])], names=["query_id", "vec_id", "score"])

    return lean(go)


def _merged(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    candidates = scratch.write(usable(vectors))
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = asked.count()
    # Blocks by hash: a block is a bounded share of the queries, and each block meets all candidates.
    blocks = max(1, math.ceil(n / BLOCK))
    asked = scratch.write(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "block")
    out = None
    for b in range(blocks):
        block = [(r["vec_id"], list(r["embedding"])) for r in asked.filter(F.col("block") == b).collect()]
        partial = candidates.mapInArrow(_partial(block, k), "query_id long, vec_id long, score long")
        lanes = _merged(partial.withColumn("lane", F.spark_partition_id() % LANES), ["query_id", "lane"], k)
        found = _merged(lanes.drop("rank"), ["query_id"], k).select("query_id", "rank", "vec_id", "score")
        found = scratch.write(found) if blocks > 1 else found
        out = found if out is None else out.union(found)
    return out


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
