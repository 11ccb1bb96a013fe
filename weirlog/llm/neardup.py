"""N-gram Jaccard join by chosen paths.

Documents become sets of five-word shingles. Documents with one set collapse to a representative.
Each representative is embedded by min-wise hashing; a run samples one coordinate and puts the
representative into the bucket of its value there. Runs repeat until a pair at the threshold shares
a bucket with the target recall. A bucket above `BUCKET` members is split again on sampled
coordinates, down to `DEPTH` levels. Buckets are compared by brute force on sketches, which only
unites documents into families (with a wide margin below the threshold). At the first and the last level a
large bucket is compared with one of its members and those close to it are settled. The others are
compared by blocks where that is less work than splitting, and at the last level; no documents are
united without a comparison. Inside each family every pair is then verified on the
exact sets, large families in blocks, bounded in members and in shingles, so that no task sees a
whole one. Nothing is capped: a family of any size is compared in full.

Defined results: a text without words (null, empty) has no shingles, no link, and its own id as
class; one to four words make one shingle; equal sets are copies (similarity 1) and count as links;
repeated rows count as documents; a null doc_id takes part, and a class of null ids has a null class.
"""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog.llm.common import lean, ship, slices, text_or_empty
from weirlog.llm.components import components
from weirlog.scratch import Scratch

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity of at least 4 / 5
COORDINATES, RECALL = 64, 0.999999999
#: Agreeing coordinates of 64 from which two sketches are united; at the threshold fewer have a chance of about 3e-8.
UNITE = 30
#: Members up to which a bucket is compared by brute force; levels; coordinates sampled at the second level and below it,
#: as many as keep a pair at the threshold together in some run whose buckets split at every level (a miss of 5e-8).
BUCKET, DEPTH, BRANCH = 1024, 4, (3, 2, 2)
#: Blocks of BUCKET members up to which a large bucket is compared block by block: as long as that sends a member fewer
#: times than splitting it down all levels does (3 + 6 + 12). Larger ones are split.
DIRECT = 8
#: Sketches that agree with a large bucket's first member in so many coordinates are settled by it.
CLOSE = 54
#: Members of a block; of a family that is compared whole; shingles of a block, which ends sooner where texts are long.
BLOCK, WHOLE, SHINGLES = 256, 512, 1 << 18
#: Edges that a task holds before it merges them.
PENDING = 1 << 17
#: Bits for each member of a family in the bitmap that spares other texts the shuffle, and the bitmap's least and largest size (32 MB).
BITS, BITMAPS = 8, (1 << 20, 1 << 28)
_M = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240101)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def runs(recall: float = RECALL) -> list[int]:
    """The coordinates sampled by the runs that reach the recall at the threshold similarity."""
    n = math.ceil(math.log(1 - recall) / math.log(1 - NUMERATOR / DENOMINATOR))
    return random.Random(7).sample(range(COORDINATES), n)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and the size of each set."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    n = max(0, len(h) - WORDS + 1)
    acc = h[:n].copy()
    for k in range(1, WORDS):
        acc = (acc ^ (acc >> np.uint64(32))) * _M + h[k : k + n]
    acc = _mix(acc)
    sets = []
    for i, size in enumerate(sizes):
        a = starts[i]
        if size >= WORDS:
            sets.append(np.unique(acc[a : a + size - WORDS + 1]))
        elif size:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i]), seed=1)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.fromiter(map(len, sets), np.int64, len(sets))


def embed(texts: list[bytes]) -> tuple[list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
    """Digest of each set (None: no words), its size, bucket keys of the runs, sketch of a byte a coordinate."""
    tokens, sizes = shingle_sets(texts)
    full = sizes > 0
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    keys, sketch, at = np.zeros((len(texts), len(chosen := runs())), np.int64), np.zeros((len(texts), COORDINATES), np.uint8), {c: j for j, c in enumerate(runs())}
    if full.any():
        for c in range(COORDINATES):
            low = np.minimum.reduceat(tokens * _A[c] + _B[c], starts[full])
            mixed = _mix(low + _A[c])
            sketch[full, c] = (mixed >> np.uint64(56)).astype(np.uint8)
            if c in at:
                keys[full, at[c]] = mixed.view(np.int64)
    assert len(chosen) == len(at)
    digests = [xxhash.xxh3_128_digest(tokens[a : a + n].tobytes()) if n else None for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return digests, sizes, keys, sketch


def _embedded(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, row hash, set digest, set size, bucket keys, sketch."""

    def go(batches):
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(pc.binary_length(texts).to_pylist(), 1 << 21):
                part = batch.slice(a, b - a)
                digests, sizes, keys, sketch = embed(part.column(2).to_pylist())
                flat = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sizes), flat, pa.array([r.tobytes() for r in sketch], pa.binary())], names=["doc_id", "h", "digest", "n", "keys", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(lean(go), "doc_id long, h long, digest binary, n long, keys array<long>, sketch binary")


def row_hash():
    return F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()).alias("h")


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def joined(root: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The roots after further edges."""
    moved = np.flatnonzero(root != np.arange(len(root)))
    return local_roots(np.concatenate([moved, *a]), np.concatenate([root[moved], *b]), len(root))


def _unite(batches):
    """Buckets arrive whole and sorted; each yields a star of edges for every group of like sketches, groups that share a member as one."""
    key, rep, sk = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, COORDINATES), np.uint8)

    def edges(key, rep, sk):
        node, at = np.unique(rep, return_inverse=True)
        root, a, b = np.arange(len(node)), [], []
        for d in range(1, len(key)):
            i = np.flatnonzero(key[:-d] == key[d:])
            if not len(i):
                break
            i = i[(sk[i] == sk[i + d]).sum(1) >= UNITE]
            a.append(at[i])
            b.append(at[i + d])
            if sum(map(len, a)) > PENDING:
                root, a, b = joined(root, a, b), [], []
        root = joined(root, a, b)
        moved = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["a", "b"])

    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy()))
        rep = np.concatenate((rep, batch.column(1).to_numpy()))
        sk = np.concatenate((sk, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)))
        if len(key) and key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))
            yield edges(key[:cut], rep[:cut], sk[:cut])
            key, rep, sk = key[cut:], rep[cut:], sk[cut:]
    if len(key):
        yield edges(key, rep, sk)


def _family_edges(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges that unite representatives into families: chosen paths, then sketches in small buckets."""
    rows = reps.select(F.explode("keys").alias("key"), "rep", "sketch")
    found, leaves = [], []
    for level in range(1, DEPTH + 1):
        shared = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("first")).filter("members > 1")
        rows = scratch.write(rows.join(shared, "key"))
        leaves.append(rows.filter(F.col("members") <= BUCKET).select("key", "rep", "sketch"))
        large = rows.filter(F.col("members") > BUCKET)
        if large.isEmpty():
            break
        if level in (1, DEPTH):
            stars, large = _settled(large, scratch)
            found.append(stars)
        direct = F.lit(level == DEPTH) | (F.col("members") <= DIRECT * BUCKET)
        leaves.append(_in_blocks(large.filter(direct)))
        large = large.filter(~direct)
        if level < DEPTH:
            # Coordinates are sampled by the bucket's path; the child's path is the parent's and the value there.
            child = [F.pmod(F.xxhash64("key", F.lit(level), F.lit(j)), F.lit(COORDINATES)) + 1 for j in range(BRANCH[level - 1])]
            value = [F.xxhash64("key", c, F.substring("sketch", c.cast("int"), F.lit(1))) for c in child]
            rows = large.select(F.explode(F.array_distinct(F.array(*value))).alias("key"), "rep", "sketch")
    buckets = reduce(DataFrame.union, leaves)
    return reduce(DataFrame.union, found, buckets.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_unite), "a long, b long"))


def _settled(large: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of large buckets (key, rep, sketch, members, first): edges to their first member, and (key, rep, sketch, members) of those not settled by it.

    Coordinates in which two sketches differ obey the triangle inequality. So a sketch that agrees with one
    close to the first in UNITE coordinates agrees with the first in UNITE - (COORDINATES - CLOSE); all of those
    get an edge to the first, and those close to it need no further comparison.
    """
    centre = large.filter("rep = first").select("key", F.col("sketch").alias("centre")).dropDuplicates(["key"])
    agree = reduce(Column.__add__, [(F.substring("sketch", c, 1) == F.substring("centre", c, 1)).cast("int") for c in range(1, COORDINATES + 1)])
    seen = scratch.write(large.join(centre, "key").select("key", "rep", "sketch", "members", "first", agree.alias("agree")))
    stars = seen.filter(F.col("agree") >= UNITE - COORDINATES + CLOSE).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    return stars, seen.filter(F.col("agree") < CLOSE).select("key", "rep", "sketch", "members")


def _in_blocks(far: DataFrame) -> DataFrame:
    """Buckets (key, rep, sketch) of two blocks each, in which all of a bucket (key, rep, sketch, members) meet."""
    blocks = F.ceil(F.col("members") / BUCKET)
    return _paired(far.select("key", "rep", "sketch", blocks.alias("blocks"))).select(F.xxhash64("key", "i", "j").alias("key"), "rep", "sketch")


def _paired(members: DataFrame) -> DataFrame:
    """Each member (rep, blocks) once for every pair (i, j) of blocks that its own block is in."""
    placed = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def _verify(batches):
    """Groups (family, block pair) arrive whole and sorted; for each member its root, and the copies that it links to, within the group."""
    held: list[dict] = []

    def group(rows):
        seen, keep = set(), []
        for r in rows:
            if r["rep"] not in seen:
                seen.add(r["rep"])
                keep.append(r)
        m = len(keep)
        tokens, sizes = shingle_sets([r["text"] for r in keep])
        owner = np.repeat(np.arange(m), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        fresh = np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, bool)
        column = np.cumsum(fresh) - 1
        used = np.bincount(column)[column] > 1
        owner, column = owner[used], column[used]
        if len(column):
            column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64))))
        inter, width = np.zeros((m, m), np.float64), int(column[-1]) + 1 if len(column) else 0
        for c in range(0, width, 4096):
            a, b = np.searchsorted(column, (c, c + 4096))
            part = np.zeros((m, min(4096, width - c)), np.float32)
            part[owner[a:b], column[a:b] - c] = 1
            inter += part @ part.T
        linked = DENOMINATOR * inter >= NUMERATOR * (sizes[:, None] + sizes[None, :] - inter)
        np.fill_diagonal(linked, False)
        block = np.array([r["block"] for r in keep])
        if keep[0]["i"] != keep[0]["j"]:
            linked &= block[:, None] != block[None, :]
        copies = np.array([r["copies"] for r in keep], np.int64)
        root = local_roots(*np.nonzero(linked), m)
        links = (linked * copies[None, :]).sum(1)
        return [(r["rep"], keep[root[x]]["rep"], int(links[x]), r["blocks"]) for x, r in enumerate(keep)]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["rep", "root", "links", "blocks"])

    at = lambda r: (r["family"], r["i"], r["j"])
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if held and at(held[0]) != at(r):
                done += group(held)
                held = []
            held.append(r)
        yield out(done)
    if held:
        yield out(group(held))


def classes(docs: DataFrame) -> tuple[DataFrame, Scratch]:
    """A row for each document: doc_id, h (row hash), class_id, n_links, and first_h, the row hash of the class's first document.

    A document is known by its id and its row hash together, so equal hashes of different documents do no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = scratch.write(_embedded(docs))
    # The first document of a set is the one of the smallest id, null last.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    reps = scratch.write(
        rows.filter("n > 0").groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("n").alias("n")).withColumn("rep", F.monotonically_increasing_id())
    )
    families = components(_family_edges(reps, scratch), scratch).select(F.col("node").alias("rep"), F.col("root").alias("family"))
    joined = scratch.write(families.join(reps.select("rep", "copies", "n", F.col("first.doc_id").alias("id"), F.col("first.h").alias("h")), "rep"))
    parts = F.least("members", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / SHINGLES)))
    whole = (F.col("members") <= WHOLE) & (F.col("shingles") <= 2 * SHINGLES)
    sizes = joined.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).select("family", F.when(whole, F.lit(1).cast("long")).otherwise(parts).alias("blocks"))
    member = scratch.write(joined.join(sizes, "family").drop("n"))
    near = scratch.write(_linked(docs, member))
    # Families compared whole have their roots; those compared in blocks still have to join theirs.
    joined = components(near.filter("blocks > 1").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = near.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("blocks").alias("blocks"))
    rooted = links.join(joined.select(F.col("node").alias("rep"), F.col("root").alias("far")), "rep", "left").select("rep", "links", F.when(F.col("blocks") > 1, F.coalesce("far", "rep")).otherwise(F.col("root")).alias("root"))
    known = reps.join(rooted, "rep", "left").select("digest", "first", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    firsts = known.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("sets")).filter("sets > 1").select("root", F.col("first").alias("class"))
    told = known.join(firsts, "root", "left").select("digest", F.coalesce("class", "first").alias("class"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = rows.filter("n = 0").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("first_h"))
    result = rows.filter("n > 0").select("doc_id", "h", "digest").join(told, "digest").select("doc_id", "h", F.col("class.doc_id").alias("class_id"), "n_links", F.col("class.h").alias("first_h")).union(alone)
    return result, scratch


def _linked(docs: DataFrame, member: DataFrame) -> DataFrame:
    """Verified links within families. Texts are read again, only for first documents of sets in families.

    A bitmap of bounded size rules out most other documents before the shuffle; what it lets by falls out in the join.
    """
    least, largest = BITMAPS
    size = min(largest, max(least, 1 << (BITS * member.count()).bit_length()))
    bits = bytearray(size // 8)
    spread = member.select((F.pmod("h", F.lit(size)) + 1).alias("b"))
    parts = spread.groupBy(F.expr("bitmap_bucket_number(b)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("on"))
    for part, on in parts.collect():
        bits[(part - 1) * 4096 : part * 4096] = on
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    @F.pandas_udf("boolean")
    def maybe(h):
        at = h.to_numpy() & (size - 1)
        return type(h)((np.frombuffer(shared.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(), text_or_empty().cast("binary").alias("text")).filter(maybe("h"))
    held = texts.join(member.withColumnRenamed("h", "first_h"), (F.col("h") == F.col("first_h")) & F.col("doc_id").eqNullSafe(F.col("id")))
    placed = _paired(held).select("family", "i", "j", "rep", "block", "copies", "blocks", "text")
    return placed.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "rep").mapInArrow(lean(_verify), "rep long, root long, links long, blocks long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of those linked with it, directly or by others), n_links (documents at the threshold or above)."""
    result, scratch = classes(docs)
    return result.select("doc_id", "class_id", "n_links")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, less those whose class has an earlier document; a repeated row stays once. Texts without words all stay."""
    result, scratch = classes(docs)
    stay = result.filter("first_h is null or (first_h = h and class_id <=> doc_id)").select(F.col("h").alias("__first"), F.col("doc_id").alias("__id"), F.col("first_h").isNotNull().alias("__once")).distinct()
    packed = docs.select(row_hash().alias("__h"), F.col("doc_id").cast("long").alias("__doc"), F.struct("*").alias("__row")).join(stay, (F.col("__h") == F.col("__first")) & F.col("__doc").eqNullSafe(F.col("__id")))
    # Rows of one id and text may differ in other columns; the same one of them stays on every run.
    once = packed.filter("__once").groupBy("__h", "__doc").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*")
    return once.unionByName(packed.filter("not __once").select("__row.*"))


SQL = """
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                 WHEN len(w) > 0 THEN ['1 ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 5 * shared.n >= 4 * (p.n + q.n - shared.n)),
reach AS (SELECT r AS x, r AS y FROM words UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
class AS (SELECT reach.x AS r, min(w.doc_id) AS class_id FROM reach JOIN words w ON w.r = reach.y GROUP BY 1)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE links.x = words.r) AS n_links FROM words JOIN class USING (r)
"""
