"""Best-fit packing of token pieces into sequences, after a dominance reduction.

The instance is a histogram: how many pieces there are of each of at most `capacity` lengths. Both
the reduction and best fit work on that bounded histogram, in ranges of like sequences, so their
cost does not depend on the number of documents. Pieces of one length are interchangeable: each
gets its rank among them, and the ranges say which sequence and place a rank has.

Reduction: a piece and what fills its sequence exactly dominate every set with the piece, and so do the
largest others beside it where at most two fit and every other choice could be exchanged for them. Such
sets are fixed for good, from long pieces to short ones, again and again until none is left. Best fit in
decreasing order packs the rest; where it stays above the least number that the tokens need, best fit by
sets (the longest piece left and the pieces that fill its sequence most) is tried as well, and the packing
with fewer sequences is taken.

Defined results: a null or empty text is a document of the end id alone; documents longer than the
capacity, however long, are cut so that the first piece is the short one; repeated rows are packed each;
pieces of one length are interchangeable and ranked by hash; an empty table gives no rows; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import copy
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.common import lean, ship, text_or_empty
from weirlog.scratch import Scratch

CAPACITY, END = 1024, 2
TOKENIZER, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"
#: Pieces of one length are ranked in groups of about this many, in at most so many groups.
GROUP, GROUPS = 200, 4096


@cache
def encoder(tokenizer: str = TOKENIZER, ranks: str = RANKS):
    """Texts to ids of the public vocabulary. The same vocabulary as ranks gives the same ids several times faster; a text with the special token's string goes through the tokenizer itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    with open(public_tokenizers.path(ranks), "rb") as f:
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    return lambda text: whole.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    ship(docs.sparkSession)

    def go(batches):
        encode = encoder()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), END], "<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k != 1 else pa.int32()) for k in range(5)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(lean(go), "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Segment:
    """Ranks from `rank` to `rank + count` of a length go to sequences from `base`, `each` to a sequence, from `offset` there."""

    rank: int
    count: int
    base: int
    each: int
    offset: int


class Packer:
    """The packing of a histogram of lengths; `segments` has it by length, `sequences` is the number used."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left, self.given = capacity, {k: n for k, n in counts.items() if n}, dict.fromkeys(counts, 0)
        self.segments: dict[int, list[Segment]] = {k: [] for k in counts}
        self.sequences = self.fixed = 0
        while self._reduce():
            pass
        bound = self.sequences + -(-sum(k * n for k, n in self.left.items()) // capacity)
        by_sets = copy.deepcopy(self)
        self._best_fit()
        if self.sequences > bound:
            by_sets._fit_sets()
            if by_sets.sequences < self.sequences:
                self.segments, self.given, self.sequences = by_sets.segments, by_sets.given, by_sets.sequences

    def _put(self, length: int, count: int, base: int, each: int, offset: int) -> None:
        self.segments[length].append(Segment(self.given[length], count, base, each, offset))
        self.given[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _fill(self, *lengths: int) -> int:
        """As many sequences of these pieces as there are."""
        each, offset, base = Counter(lengths), 0, self.sequences
        times = min(self.left[k] // m for k, m in each.items())
        for k, m in each.items():
            self._put(k, m * times, base, m, offset)
            offset += m * k
        self.sequences += times
        return times

    def _reduce(self) -> bool:
        """Fixes every set that dominates all others with its longest piece; whether there was any."""
        before = self.fixed
        for length in sorted(self.left, reverse=True):
            while length in self.left and (found := self._dominating(length)) is not None:
                self.fixed += self._fill(length, *found)
        return self.fixed > before

    def _dominating(self, length: int) -> tuple[int, ...] | None:
        """What to put beside a piece of `length` such that every other choice can be exchanged for it: each of the other's pieces, or several together, fit in place of one of these.

        Wherever one is found it stays valid while its pieces last, since fewer pieces leave fewer other choices.
        """
        room = self.capacity - length
        spare = lambda k: self.left[k] - (k == length)
        others = [k for k in sorted(self.left) if k <= room and spare(k) > 0]
        if not others:
            return ()
        a = others[-1]
        if a == room:
            return (a,)
        least = [k for k in others[:3] for _ in range(min(3, spare(k)))][:3]
        if len(least) < 2 or least[0] + least[1] > room:
            return (a,)
        if len(least) == 3 and sum(least) <= room:
            return None  # three may fit: no dominance is known

        def pairs(low: int):
            """For each second piece above `low` the longest that fits with it and is no shorter."""
            for y in others[bisect_right(others, low) :]:
                i = bisect_right(others, room - y) - 1
                if i >= 0 and others[i] == y and spare(y) < 2:
                    i -= 1
                if i >= 0 and others[i] >= y:
                    yield others[i] + y

        if max(pairs(0), default=0) <= a:
            return (a,)
        i = bisect_right(others, room - a) - 1
        if i >= 0 and others[i] == a and spare(a) < 2:
            i -= 1
        if i >= 0 and max(pairs(others[i]), default=0) <= a:
            return (a, others[i])
        return None

    def _fit_sets(self) -> None:
        """Best fit by sets: each sequence takes the longest piece left and the pieces that fill it up most, long ones first."""
        while self.left:
            first = max(self.left)
            room = self.capacity - first
            # Sums that can be reached with pieces down to each length, as bits.
            steps, reach, mask = [], 1, (1 << room + 1) - 1
            for k in sorted((k for k in self.left if k <= room), reverse=True):
                steps.append((k, reach))
                many, part = min(self.left[k] - (k == first), room // k), 1
                while many > 0:
                    part = min(part, many)
                    reach |= reach << part * k & mask
                    many, part = many - part, part * 2
                if reach >> room & 1:
                    break
            rest, taken = reach.bit_length() - 1, [first]
            for k, before in reversed(steps):
                while not before >> rest & 1:
                    taken.append(k)
                    rest -= k
            self._fill(*taken)

    def _best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = {}  # by free ids: (first sequence, number of sequences)
        free: list[int] = []

        def put_back(r: int, base: int, n: int) -> None:
            if r and n:
                if r not in room:
                    room[r] = []
                    insort(free, r)
                room[r].append((base, n))

        for length in sorted(self.left, reverse=True):
            while (have := self.left.get(length, 0)) > 0:
                i = bisect_left(free, length)
                if i < len(free):
                    r = free[i]
                    base, n = room[r].pop()
                    if not room[r]:
                        del room[r], free[i]
                else:
                    r, base, n = self.capacity, self.sequences, -(-have // (self.capacity // length))
                    self.sequences += n
                each = r // length
                full = min(n, have // each)
                if full:
                    self._put(length, full * each, base, each, self.capacity - r)
                    put_back(r - each * length, base, full)
                if full < n and have - full * each > 0:
                    rest = have - full * each
                    self._put(length, rest, base + full, rest, self.capacity - r)
                    put_back(r - rest * length, base + full, 1)
                    full += 1
                put_back(r, base + full, n - full)


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.write(pieces(docs, capacity).withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = {k: tuple(np.array([getattr(s, f) for s in v], np.int64) for f in ("rank", "base", "each", "offset")) for k, v in Packer(counts, capacity).segments.items()}
    groups = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(GROUPS, -(-n // GROUP))))) if counts else F.lit(None).cast("map<bigint,int>")
    grouped = table.withColumn("grp", F.pmod(F.xxhash64("row"), F.element_at(groups, F.col("length"))))
    # Ranks in two levels: rows before the group, then the place in the group.
    sizes = grouped.groupBy("length", "grp").agg(F.count("*").alias("n"))
    before = sizes.select("length", "grp", (F.sum("n").over(Window.partitionBy("length").orderBy("grp")) - F.col("n")).alias("before"))
    ranked = grouped.withColumn("place", F.row_number().over(Window.partitionBy("length", "grp").orderBy("row"))).join(before, ["length", "grp"])

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, each, shift = plan[int(n)]
                s = np.searchsorted(first, rank[at], side="right") - 1
                j = rank[at] - first[s]
                sequence[at], offset[at] = base[s] + j // each[s], shift[s] + j % each[s] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place") - 1).cast("long").alias("rank"))
    return rows.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
