"""Class-based n-grams: exchange clustering, class transitions, word emissions, smoothed perplexity.

Counts cover every training document, and each training word has the class that its own contexts
give it. The `SINGLE` most frequent words are exchanged one by one on the driver, against units of all
other words by ending; Spark counts which unit follows which, a matrix of at most SINGLE + TAIL + 1
units squared. Then every other word meets the classes to its left and right, counted over all its
occurrences, and goes to the class that gains most likelihood from these counts. This is one round, in
which all words look at the classes that their neighbours had before it. Class transitions are counted
again after it. A word never seen in training has no contexts to learn from: its probability is summed
over all classes that can follow, and the likeliest of them is its class for what comes next.

A word's probability is that of its class after the previous class, times that of the word in the
class. Both are smoothed by absolute discounting; what is taken from a class's words goes to words
never seen in training, as one event, as in the base score.

Words that make up at least one in `HEAD` of all tokens (so at most `HEAD` of them) are looked up in a
table. A word of a task's stretch of tokens that makes up less than that of it is not reported; so a
word outside the table makes up less than two in `HEAD` of all tokens. Occurrences of other words are
told apart by a 64-bit hash and travel once, in blocks by hash bucket: the bucket counts the word,
finds its class and answers the chunk of texts that asked. A bucket holds about `SPAN` occurrences, or
those of its most frequent word if they are more.

Defined results: a null or empty text is the end token alone; a text of any length is scored whole (a
chunk holds at least one text); ties go to the lower class, and among equally frequent words to the
lesser bytes; without training documents every token is unknown and both scores follow from the
formulas with counts of 0; an empty table gives no rows; a null id counts as empty text in the fold;
repeated rows are scored each; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm.common import id_bucket, lean, ship, slices, text_or_empty
from weirlog.scratch import Scratch

FOLDS, HELD = 7, 2
#: Codes of the table's words and one more fit in 16 bits.
HEAD, SINGLE, TAIL, CLASSES, SETTLED = 60_000, 2000, 512, 64, 0.003
CONTEXT_DISCOUNT = 0.5
#: Different words of a stretch, bytes of a chunk of texts, occurrences of a bucket, and words classed at once.
HOLD, CHUNK, SPAN, AT_ONCE = 250_000, 1 << 20, 1_000_000, 8192
#: Stands for the class of a word never seen in training.
NEVER = 255
LEARNT = CLASSES**3


def tokens(text: bytes) -> list[bytes]:
    """A-Z in lower case, split at the six white-space bytes."""
    return text.lower().split()


def word_hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64).view(np.int64)


def endings(words) -> np.ndarray:
    """The unit of each word that is not exchanged alone, counted from 0."""
    return np.fromiter((zlib.crc32(w[-3:]) for w in words), np.int64) % TAIL


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as a compressed block, their byte planes apart."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes, *kinds: str) -> list[np.ndarray]:
    size, widths = int.from_bytes(block[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    raw, at, out = np.frombuffer(pa.decompress(block[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8), 0, []
    n = size // sum(widths)
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(k))
        at += n * w
    return out


def frequent(texts: DataFrame) -> DataFrame:
    """word, n: counts of words that make up one in HEAD of a stretch of tokens; a null word counts all tokens but ends."""

    def of_stretch(counts: Counter):
        total = sum(counts.values())
        kept = [(w, n) for w, n in counts.items() if n * HEAD >= total]
        return pa.RecordBatch.from_arrays([pa.array([None, *(w for w, _ in kept)], pa.binary()), pa.array([total, *(n for _, n in kept)], pa.int64())], names=["word", "n"])

    def go(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(tokens(t.as_py()))
                if len(counts) > HOLD:
                    yield of_stretch(counts)
                    counts = Counter()
        yield of_stretch(counts)

    return texts.select("text").mapInArrow(lean(go), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def table_of(texts: DataFrame) -> dict[bytes | None, int]:
    """Code of each word of the table, frequent ones first; None, the end, is 0. Its length is the code of all other words."""
    found = frequent(texts)
    total = (found.filter("word is null").first() or {"n": 0})["n"]
    top = sorted(((-r["n"], bytes(r["word"])) for r in found.filter(F.col("word").isNotNull() & (F.col("n") * HEAD >= total)).collect()))
    return {None: 0} | {w: i for i, (_, w) in enumerate(top[:HEAD], 1)}


def coded(table: dict, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts (an end after each), their codes, the places of words outside the table, and where each text ends."""
    words, ends = [], []
    for t in texts:
        words += tokens(t.as_py())
        words.append(None)
        ends.append(len(words))
    codes = np.fromiter(map(table.get, words, repeat(len(table))), np.int64, len(words))
    return words, codes, np.flatnonzero(codes == len(table)), np.array(ends, np.int64)


def unit_of(size: int) -> np.ndarray:
    """Unit of each code of a table of that size: the end, words alone, then endings, which codes from the table's size on stand for."""
    single = min(SINGLE, size - 1)
    return np.concatenate((np.arange(single + 1), np.zeros(size - single - 1, np.int64), 1 + single + np.arange(TAIL)))


def units(table: dict) -> np.ndarray:
    """Unit of each code, then of each ending."""
    unit, single = unit_of(len(table)), min(SINGLE, len(table) - 1)
    later = [w for w, c in table.items() if c > single]
    unit[single + 1 : len(table)] = 1 + single + endings(later)
    return unit


def count_pairs(texts: DataFrame, table: dict, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a unit (column) follows a unit (row), where each text follows an end; and the count of every code."""
    size, shared = int(unit.max()) + 1, texts.sparkSession.sparkContext.broadcast((table, unit))

    def go(batches):
        # A task adds up all its pairs in one matrix, whose size depends on the number of units alone.
        table, unit = shared.value
        matrix, counts, held, total = np.zeros(size * size, np.int64), np.zeros(len(table) + 1, np.int64), [], 0
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(0)).to_pylist(), CHUNK):
                words, codes, rare, _ = coded(table, batch.column(0)[a:b])
                counts += np.bincount(codes, minlength=len(counts))
                u = unit[codes]
                u[rare] = unit[len(table) + endings([words[i] for i in rare])]
                held.append(np.concatenate(([0], u[:-1])) * size + u)
                total += len(u)
                if total > 4_000_000:
                    matrix += np.bincount(np.concatenate(held), minlength=len(matrix))
                    held, total = [], 0
        if held:
            matrix += np.bincount(np.concatenate(held), minlength=len(matrix))
        seen = np.flatnonzero(counts)
        blocks = [(-1, pack(seen, counts[seen]))]
        for row, n in enumerate(matrix.reshape(size, size)):
            if len(seen := np.flatnonzero(n)):
                blocks.append((row, pack(seen, n[seen])))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], names=["row", "block"])

    def add(batches):
        now, sums, out = None, None, []
        for batch in batches:
            for row, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if row != now:
                    if now is not None:
                        out.append((now, sums))
                    now, sums = row, np.zeros(max(size, len(table) + 1), np.int64)
                seen, n = unpack(block, "i8", "i8")
                sums[seen] += n
        if now is not None:
            out.append((now, sums))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([pack(x) for _, x in out], pa.binary())], names=["row", "block"])

    found = texts.select("text").mapInArrow(lean(go), "row int, block binary").repartition("row").sortWithinPartitions("row").mapInArrow(lean(add), "row int, block binary").toArrow()
    pairs, counts = np.zeros((size, size)), np.zeros(len(table) + 1, np.int64)
    for row, block in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        [n] = unpack(block, "i8")
        if row < 0:
            counts += n[: len(counts)]
        else:
            pairs[row] += n[:size]
    return pairs, counts


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, of: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Classes of units after exchange: pairs[x, y] counts unit y after unit x, `of` has the classes at first.

    Units move one at a time, frequent ones first, each to the class that gains most likelihood,
    against counts that hold every move so far; rounds end when few units move.
    """
    of, size = of.copy(), len(of)
    after, before = np.zeros((size, CLASSES)), np.zeros((size, CLASSES))
    np.add.at(after.T, of, pairs.T)
    np.add.at(before.T, of, pairs)
    n = np.zeros((CLASSES, CLASSES))
    np.add.at(n, of, after)
    row, col = n.sum(1), n.sum(0)
    order = [u for u in np.argsort(-pairs.sum(1), kind="stable") if pairs[u].any() or pairs[:, u].any()]
    for _ in range(rounds):
        moves = 0
        for u in order:
            a, own = of[u], pairs[u, u]
            # Its pairs with itself stay with it and are handled apart.
            right, left = after[u].copy(), before[u].copy()
            right[a] -= own
            left[a] -= own
            out, into = right.sum() + own, left.sum() + own
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= own
            row -= left
            col -= right
            row[a] -= out
            col[a] -= into
            d = np.diag(n)
            gain = (_f(n + right) - _f(n)).sum(1) + (_f(n + left[:, None]) - _f(n)).sum(0)
            gain += _f(d + right + left + own) - _f(d + right) - _f(d + left) + _f(d)
            gain -= _f(row + left + out) - _f(row + left) + _f(col + right + into) - _f(col + right)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            n[b] += right
            n[:, b] += left
            n[b, b] += own
            row += left
            col += right
            row[b] += out
            col[b] += into
            if b != a:
                of[u], moves = b, moves + 1
                after[:, a] -= pairs[:, u]
                after[:, b] += pairs[:, u]
                before[:, a] -= pairs[u]
                before[:, b] += pairs[u]
        if moves <= SETTLED * size:
            break
    return of


@dataclass
class Model:
    """Everything that scoring needs, of bounded size. Codes are those of `table_of`; the one after the table's is any other word's."""

    table: dict[bytes | None, int]
    counts: np.ndarray  # of each code of the table
    of: np.ndarray  # class of each code of the table, then of each ending
    pairs: np.ndarray  # how often a class (column) followed a class (row) when words outside the table had their ending's class
    size: np.ndarray | None = None  # tokens in each class
    unseen: np.ndarray | None = None  # log10 probability, in each class, of a word never seen
    discount: float = 0.5
    total: int = 0  # tokens
    distinct: int = 0

    @property
    def floor(self) -> float:
        return float(self.total + self.distinct + 1)

    def emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 probability of a word seen in training in its class."""
        return np.log10(np.maximum(count - self.discount, 1e-9) / np.maximum(self.size[cls], 1))


def begin(texts: DataFrame) -> tuple[Model, int]:
    """Classes after the exchange of single words, and how many occurrences of words outside the table `texts` (text binary) have."""
    table = table_of(texts)
    unit = units(table)
    pairs, counts = count_pairs(texts, table, unit)
    start = np.empty(len(pairs), np.int64)
    start[np.argsort(-(pairs.sum(0)), kind="stable")] = np.arange(len(pairs)) % CLASSES
    of_unit = exchange(pairs, start)
    n = np.zeros((CLASSES, len(pairs)))
    np.add.at(n, of_unit, pairs)
    n = np.stack([np.bincount(of_unit, row, CLASSES) for row in n])
    return Model(table, counts[:-1], of_unit[unit], n), int(counts[-1])


def parts(rows: DataFrame, model: Model, buckets: int) -> DataFrame:
    """What texts hold, in rows of two kinds.

    A chunk of texts (bucket -1) has ids, folds, ends of texts and a block with the code of each token. A bucket's row has a block
    of occurrences in one chunk: hash, ordinal among the chunk's words outside the table, and classes there, left and right with a
    mark if the text is learnt from. Rows of chunk -1 sum up the same classes for words of the table that were not exchanged alone.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    single = min(SINGLE, len(model.table) - 1)

    def go(batches):
        m, task = shared.value, TaskContext.get().partitionId()
        tail, held, total, number = len(m.table), [], 0, 0

        def out(items):
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in items], t) for k, t in enumerate(kinds)], names=["bucket", "chunk", "doc_id", "held", "ends", "block"])

        def summed():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            of = key // CLASSES**2 % buckets
            return out([(b, -1, None, None, None, pack(key[of == b], n[of == b])) for b in np.unique(of).tolist()])

        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), CHUNK):
                words, codes, rare, ends = coded(m.table, batch.column(2)[a:b])
                fold = batch.column(1)[a:b].to_numpy(zero_copy_only=False)
                learnt = np.repeat(~fold, np.diff(ends, prepend=0))
                names = [words[i] for i in rare]
                cls = m.of[codes]
                cls[rare] = m.of[tail + endings(names)]
                around = np.concatenate((m.of[:1], cls, m.of[:1]))
                beside = around[:-2] * CLASSES + around[2:]
                later = np.flatnonzero((codes > single) & (codes < tail) & learnt)
                held.append(codes[later] * CLASSES**2 + beside[later])
                total += len(later)
                chunk, number = task << 33 | number, number + 1
                items = [(-1, chunk, batch.column(0)[a:b].to_pylist(), fold.tolist(), ends.tolist(), pack(codes.astype("u2")))]
                h = word_hashes(names)
                ctx = (cls[rare] * CLASSES**2 + beside[rare] + LEARNT * learnt[rare]).astype("u4")
                to = h.view(np.uint64) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    mine = order[edges[k] : edges[k + 1]]
                    items.append((k, chunk, None, None, None, pack(h[mine], np.diff(mine, prepend=0).astype("u4"), ctx[mine])))
                yield out(items)
                if total > HOLD * 4:
                    yield summed()
                    held, total = [], 0
        if total:
            yield summed()

    return rows.select("doc_id", "held_out", "text").mapInArrow(lean(go), "bucket int, chunk long, doc_id array<long>, held array<boolean>, ends array<long>, block binary")


def best_classes(pairs: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The class of most likelihood for each word, taken out of the class `own`, by the counts of classes to its left and right (words x classes)."""
    words, every = len(own), np.arange(len(own))
    gain, stay = np.zeros((words, len(pairs))), np.zeros(words)
    for counts, others, n in ((right, left, pairs), (left, right, pairs.T)):
        w, k = np.nonzero(counts)
        x = counts[w, k]
        # The gain of a count x with class k, in all classes, is looked up for each k and x that occur.
        kinds, which = np.unique(np.stack([k, x], 1), axis=0, return_inverse=True)
        with_k = n[:, kinds[:, 0].astype(np.int64)].T
        table = _f(with_k + kinds[:, 1:]) - _f(with_k)
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[starts]] += np.add.reduceat(table[which.ravel()], starts)
        there = n[own[w], k]
        stay += np.bincount(w, _f(there) - _f(np.maximum(there - x, 0)), words)
        # Pairs with the class that the word leaves don't hold the word any more.
        w, b = np.nonzero((others > 0) & (counts[every, own] > 0)[:, None] & (np.arange(len(pairs)) != own[:, None]))
        x, there = counts[w, own[w]], n[b, own[w]]
        gone = np.maximum(there - others[w, b], 0)
        gain[w, b] += _f(gone + x) - _f(gone) - _f(there + x) + _f(there)
        whole, some = n.sum(1), counts.sum(1)
        gain -= _f(whole + some[:, None]) - _f(whole)
        stay -= _f(whole[own]) - _f(np.maximum(whole[own] - some, 0))
    # Where a class stands on both sides, its pairs with itself were counted twice.
    w, b = np.nonzero((left > 0) & (right > 0))
    d, x, y = np.diag(pairs)[b], left[w, b], right[w, b]
    gain[w, b] += _f(d + x + y) - _f(d + x) - _f(d + y) + _f(d)
    less = lambda z: _f(np.maximum(d - z, 0))
    stay += np.bincount(w, np.where(b == own[w], less(x) + less(y) - _f(d) - less(x + y), 0), words)
    gain[every, own] = stay
    best = gain.argmax(1)
    return np.where(gain[every, best] <= stay + 1e-6, own, best)


def _classed(pairs: np.ndarray, word: np.ndarray, own: np.ndarray, beside: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best class of each word. `word` ascends from 0; `own` is by word, `beside` and `n` by row."""
    out, classes = np.empty(len(own), np.int64), len(pairs)
    for i in range(0, len(own), AT_ONCE):
        m = min(AT_ONCE, len(own) - i)
        a, b = np.searchsorted(word, (i, i + m))
        at = (word[a:b] - i) * classes
        left, right = (np.bincount(at + k, n[a:b], m * classes).reshape(m, classes) for k in (beside[a:b] // classes, beside[a:b] % classes))
        out[i : i + m] = best_classes(pairs, own[i : i + m], left, right)
    return out


def answers(found: DataFrame, model: Model) -> DataFrame:
    """From the buckets' rows of `parts`: to each chunk (kind 0) a block of ordinal, class and count of the words seen in training; of the table's words (kind 1) a block of code and class; of each class (kind 2; n tokens, m words) what its other words add up to, and under CLASSES how many were seen once (n) and twice (m)."""
    pairs, of = model.pairs, model.of

    def bucket(rows):
        out = []
        if tables := [unpack(x, "i8", "i8") for chunk, x in rows if chunk < 0]:
            key, n = (np.concatenate(x) for x in zip(*tables, strict=True))
            order = np.argsort(key // CLASSES**2, kind="stable")
            codes, word = np.unique(key[order] // CLASSES**2, return_inverse=True)
            cls = _classed(pairs, word, of[codes], key[order] % CLASSES**2, n[order])
            out.append((1, -1, pack(codes, cls), 0, 0))
        asked = [(chunk, *unpack(x, "i8", "u4", "u4")) for chunk, x in rows if chunk >= 0]
        if not asked:
            return out
        h, ctx = (np.concatenate([r[k] for r in asked]) for k in (1, 3))
        _, first, word = np.unique(h, return_index=True, return_inverse=True)
        learnt = ctx >= LEARNT
        count = np.bincount(word, learnt, len(first)).astype(np.int64)
        order = np.flatnonzero(learnt)
        order = order[np.argsort(word[order], kind="stable")]
        known = np.flatnonzero(count)
        number = np.cumsum(count > 0) - 1
        cls = np.zeros(len(first), np.int64)
        cls[known] = _classed(pairs, number[word[order]], ctx[first[known]].astype(np.int64) // CLASSES**2 % CLASSES, ctx[order].astype(np.int64) % CLASSES**2, np.ones(len(order)))
        at = 0
        for chunk, mine, ordinal, _ in asked:
            w, at = word[at : at + len(mine)], at + len(mine)
            seen = count[w] > 0
            if seen.any():
                out.append((0, chunk, pack(np.cumsum(ordinal, dtype=np.int64)[seen], cls[w[seen]].astype("u1"), count[w[seen]]), 0, 0))
        n, m = (np.bincount(cls[known], x, CLASSES).astype(np.int64).tolist() for x in (count[known], None))
        out += [(2, k, None, n[k], m[k]) for k in range(CLASSES) if m[k]]
        out.append((2, CLASSES, None, int((count == 1).sum()), int((count == 2).sum())))
        return out

    def batch_of(rows):
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "chunk", "block", "n", "m"])

    def go(batches):
        now, held = None, []
        for batch in batches:
            for b, chunk, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now and held:
                    yield batch_of(bucket(held))
                    held = []
                now = b
                held.append((chunk, block))
        if held:
            yield batch_of(bucket(held))

    rows = found.filter("bucket >= 0").select("bucket", "chunk", "block")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(lean(go), "kind int, chunk long, block binary, n long, m long")


def settle(model: Model, told: DataFrame) -> Model:
    """The model with every word in the class that its contexts gave it, from what `answers` says."""
    of = model.of.copy()
    # The words of the table, so at most HEAD.
    for r in told.filter("kind = 1").select("block").collect():
        codes, cls = unpack(r["block"], "i8", "i8")
        of[codes] = cls
    mine = of[: len(model.table)]
    tokens_in, types_in = np.bincount(mine, model.counts, CLASSES), np.bincount(mine, model.counts > 0, CLASSES)
    once, twice = ((model.counts[1:] == k).sum() for k in (1, 2))
    for r in told.filter("kind = 2").groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect():
        if r["chunk"] == CLASSES:
            once, twice = once + r["n"], twice + r["m"]
        else:
            tokens_in[r["chunk"]] += r["n"]
            types_in[r["chunk"]] += r["m"]
    discount = min(float(once / (once + 2 * twice)) if once else 0.5, 0.95)
    return Model(model.table, model.counts, of, model.pairs, tokens_in, _unseen(discount, types_in, tokens_in), discount, int(tokens_in.sum()), int(types_in.sum()))


def _arrive(n: np.ndarray, tokens_in: np.ndarray) -> np.ndarray:
    anywhere = (tokens_in + 0.5) / (tokens_in.sum() + 0.5 * CLASSES)
    out = n.sum(1, keepdims=True)
    kept = np.maximum(n - CONTEXT_DISCOUNT, 0) / np.maximum(out, 1)
    return np.log10(np.where(out > 0, kept + (1 - kept.sum(1, keepdims=True)) * anywhere, anywhere))


def _unseen(discount: float, types_in: np.ndarray, tokens_in: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(np.where(tokens_in > 0, discount * types_in / np.maximum(tokens_in, 1), 1.0), 1e-12))


def filled(found: DataFrame, told: DataFrame, model: Model) -> DataFrame:
    """A row for each chunk: ids, folds, ends of texts; known tokens, base score and emissions of each text; a block with the class of each token (NEVER: not seen in training)."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id array<long>, held array<boolean>, ends array<long>, known array<long>, base array<double>, emitted array<double>, block binary"

    def go(batches):
        m = shared.value
        tail, log_floor = len(m.table), np.log10(m.floor)
        base = np.append(np.log10(m.counts + 1.0) - log_floor, 0)
        known = np.append(m.counts > 0, False)
        emit = np.append(m.emission(m.counts, m.of[:tail]), 0)

        def whole(texts, told):
            codes = unpack(texts["block"], "u2")[0].astype(np.int64)
            rare = np.flatnonzero(codes == tail)
            cls, count = np.append(m.of[:tail], NEVER)[codes].astype("u1"), np.zeros(len(rare), np.int64)
            for block in told:
                ordinal, c, n = unpack(block, "i8", "u1", "i8")
                cls[rare[ordinal]], count[ordinal] = c, n
            seen, rows = count > 0, [known[codes].astype(np.int64), base[codes], emit[codes]]
            rows[0][rare], rows[1][rare] = seen, np.log10(count + 1.0) - log_floor
            rows[2][rare[seen]] = m.emission(count[seen], cls[rare[seen]])
            starts = np.concatenate(([0], texts["ends"][:-1])).astype(np.int64)
            sums = [np.add.reduceat(x, starts).tolist() for x in rows]
            return (texts["doc_id"], texts["held"], texts["ends"], *sums, pack(cls))

        def batch_of(row):
            kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["doc_id", "held", "ends", "known", "base", "emitted", "block"])

        # A chunk's texts come before what the buckets told it.
        texts, told = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] < 0:
                    if texts is not None:
                        yield batch_of(whole(texts, told))
                    texts, told = r, []
                else:
                    told.append(r["block"])
        if texts is not None:
            yield batch_of(whole(texts, told))

    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "array<long>"), ("held", "array<boolean>"), ("ends", "array<long>"))]
    asked = found.filter("bucket = -1").select("chunk", F.lit(-1).alias("kind"), "doc_id", "held", "ends", "block")
    both = asked.unionByName(told.filter("kind = 0").select("chunk", "kind", *none, "block"))
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(lean(go), schema)


def count_steps(chunks: DataFrame, end: int) -> np.ndarray:
    """How often a class (column) follows a class (row) in texts that are learnt from; `end` is the class before each text."""

    def go(batches):
        n = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for held, ends, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cls = unpack(block, "u1")[0].astype(np.int64)
                learnt = np.repeat(~np.array(held), np.diff(ends, prepend=0))
                n += np.bincount((np.concatenate(([end], cls[:-1])) * CLASSES + cls)[learnt], minlength=len(n))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["step", "n"])

    counted = chunks.select("held", "ends", "block").mapInArrow(lean(go), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CLASSES * CLASSES)
    n[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return n.reshape(CLASSES, CLASSES)


def _moved(chunks: DataFrame, arrive: np.ndarray, unseen: np.ndarray, end: int) -> DataFrame:
    """A row for each document: emissions, class transitions, and what words never seen in training have."""
    flat, new = arrive.ravel(), 10 ** (arrive + unseen)
    into, likeliest = np.minimum(np.log10(new.sum(1)), 0), new.argmax(1).tolist()

    def moved_of(ends: np.ndarray, block: bytes) -> np.ndarray:
        cls = np.concatenate(([end], unpack(block, "u1")[0])).astype(np.int64)
        never = np.flatnonzero(cls == NEVER)
        for i in never.tolist():
            cls[i] = likeliest[cls[i - 1]]
        moved = flat[cls[:-1] * CLASSES + cls[1:]]
        moved[never - 1] = into[cls[never - 1]]
        return np.add.reduceat(moved, np.concatenate(([0], ends[:-1])))

    def go(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.array(r["ends"], np.int64)
                score = np.array(r["emitted"]) + moved_of(ends, r["block"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_id"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(np.diff(ends, prepend=0)), pa.array(r["known"], pa.int64()), pa.array(r["base"], pa.float64()), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return chunks.mapInArrow(lean(go), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every document; learnt from those not held out."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(FOLDS) == HELD).alias("held_out"), text_or_empty().cast("binary").alias("text"))
    first, others = begin(rows.filter("not held_out"))
    # Words outside the table, those of held-out texts as well.
    buckets = 1 + others * FOLDS // (FOLDS - 1) // SPAN
    found = scratch.write(parts(rows, first, buckets))
    told = scratch.write(answers(found, first))
    model = settle(first, told)
    chunks = scratch.write(filled(found, told, model))
    scratch.drop(found, told)
    end = int(model.of[0])
    arrive = _arrive(count_steps(chunks, end), model.size)
    out = _moved(chunks, arrive, model.unseen, end).withColumn("train_tokens", F.lit(model.total).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
