import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weirlog.llm import packing

from cases import documents, empty


@pytest.mark.parametrize("seed", range(25))
def test_packer_fills_every_place_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 16, 50])
    counts = {n: rng.randrange(1, 60) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity))}
    p = packing.Packer(counts, capacity)
    bins = defaultdict(list)
    for n, segments in p.segments.items():
        rank = 0
        for s in segments:
            assert s.rank == rank
            for j in range(s.count):
                bins[s.base + j // s.each].append((s.offset + j % s.each * n, n))
            rank += s.count
        assert rank == counts[n]
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == p.sequences >= -(-sum(n * c for n, c in counts.items()) // capacity)


def optimum(items, capacity):
    @cache
    def least(rest):
        if not rest:
            return 0
        first, best = rest[0], 99

        def fill(i, room, left):
            nonlocal best
            best = min(best, 1 + least(left))
            for k in range(i, len(left)):
                if left[k] <= room:
                    fill(k, room - left[k], left[:k] + left[k + 1 :])

        fill(0, capacity - first, rest[1:])
        return best

    return least(tuple(sorted(items, reverse=True)))


@pytest.mark.parametrize("seed", range(120))
def test_reduction_keeps_the_optimum(seed):
    """What the reduction fixes, and the best packing of the rest, are together a best packing."""
    rng = random.Random(seed)
    items = [rng.randrange(1, 11) for _ in range(8)]
    counts = {n: items.count(n) for n in set(items)}
    p = packing.Packer.__new__(packing.Packer)
    p.capacity, p.left, p.given = 10, dict(counts), dict.fromkeys(counts, 0)
    p.segments, p.sequences, p.fixed = {n: [] for n in counts}, 0, 0
    while p._reduce():
        pass
    rest = [n for n, c in p.left.items() for _ in range(c)]
    assert p.fixed + optimum(rest, 10) == optimum(items, 10)


def test_ids_are_the_tokenizers():
    whole, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    for text in ["", " a  b\n\n", "é漢字😀", "<|endoftext|>x", "a" * 3000, "1234567 don't", "\t\t\r\n " * 50]:
        assert list(fast(text)) == whole.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    docs = documents(spark)
    rows = packing.pack(docs).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for r in docs.collect() for ids in [[*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2]] for k, (s, n) in enumerate(packing.cuts(len(ids))))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *r[1:5]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= -(-sum(w[3] for w in want) // 1024) + 1
    assert packing.pack(empty(spark)).count() == 0


def test_cuts():
    assert packing.cuts(1024) == [(0, 1024)] and packing.cuts(1025) == [(0, 1), (1, 1024)] and packing.cuts(3) == [(0, 3)]
