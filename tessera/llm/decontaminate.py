"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of ``span`` words of which a fixed mask reads ``weight``;
ignored places may be substituted. Hashes of all masked windows of the
benchmark are joined with those of every text, and around each hit the two
texts are aligned word by word along the hit's diagonal: there is an overlap if
any stretch of the diagonal is long and equal enough. The one that is given is
the best, with one point for an equal word and ``-penalty`` for a substituted
one, or, if that is too short, the longest that is equal enough.

The benchmark's seeds are joined to the texts where these are: it goes to the
tasks in blocks of at most ``block_bytes`` of text, whose size is checked before
a block is broadcast (one block for most benchmarks; a text is read once for
each). A worker builds a block's index, 12 bytes a seed, once. No text is
shuffled. A hit is held against every item that has its hash, wherever and
however often it occurs.

Defined results: null and empty texts, and items of fewer words than
``min_words``, overlap with nothing unless a whole item of at least
``min_item_words`` words stands in the text. Repeated rows give repeated
results; a null id is carried. Ties between stretches: the earliest in the
text. Columns beside id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.llm.common import mix, steps, word_hashes

#: Which of a window's words count. Fixed masks; the first words always count. Every way to change a quarter of 8 to 25 words
#: leaves all counted words of one of them as they are, and a longer passage that is three quarters equal holds such a piece of
#: 13 to 25 words, so that no passage within ``MIN_EQUAL`` is without a hit.
MASKS = ("11111", "111011", "110111", "111101", "1110011", "10101101", "11010011", "11001011")
MIN_WORDS = 13
MIN_ITEM_WORDS = 8
MIN_EQUAL = 0.75
PENALTY = 2.0
BLOCK_BYTES = 8 << 20
#: Words of diagonals that are compared at once.
STEP_WORDS = 1 << 20
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def seeds(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The masked hash of each window that begins at a word and fits into ``hashes``."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, _FACTORS[40 + number], np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                out += hashes[k : k + n] * _FACTORS[k]
    return mix(out)


class Block:
    """The seeds of some benchmark items, as sorted arrays behind a bitmap."""

    def __init__(self, items: list[tuple[int, str]], masks=MASKS, min_item_words: int = MIN_ITEM_WORDS) -> None:
        self.ids = [i for i, _ in items]
        words, at = word_hashes(pa.array([t for _, t in items], pa.string()))
        self.words, self.at, self.masks = words, at, masks
        keys, places = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        for k in range(len(items)):
            own = words[at[k] : at[k + 1]]
            if len(own) < min_item_words:
                continue
            for m, mask in enumerate(masks):
                s = seeds(own, mask, m)
                keys.append(s)
                places.append(np.arange(at[k], at[k] + len(s), dtype=np.int32))
        keys, places = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]  # 12 bytes a seed
        self.bits = max(16, int(len(self.keys) * 16).bit_length())
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows of distinct (text, item, diagonal) with a common seed; the diagonal is the item's first word's place in the text."""
        found = []
        for m, mask in enumerate(self.masks):
            s = seeds(words, mask, m)
            near = np.flatnonzero(self.bitmap[(s >> np.uint64(64 - self.bits)).astype(np.int64)])
            low, high = np.searchsorted(self.keys, s[near], "left"), np.searchsorted(self.keys, s[near], "right")
            near, low, count = near[high > low], low[high > low], (high - low)[high > low]
            if not len(near):
                continue
            text = np.searchsorted(starts, near, "right") - 1
            inside = near + len(mask) <= starts[text + 1]
            near, low, count, text = near[inside], low[inside], count[inside], text[inside]
            entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            near, text = np.repeat(near, count), np.repeat(text, count)
            place = self.places[entry].astype(np.int64)
            owner = np.searchsorted(self.at, place, "right") - 1
            found.append(np.stack([text, owner, near - starts[text] - (place - self.at[owner])], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def fitting(self, words: np.ndarray, starts: np.ndarray, hits: np.ndarray, min_words: int, min_equal: float) -> Iterator[tuple[int, int, int]]:
        """The ``hits`` with a stretch of at least ``min_words`` (or the whole item) of which ``min_equal`` is equal, wherever it lies on the diagonal."""
        text, item, diagonal = hits.T
        length = self.at[item + 1] - self.at[item]
        first = np.maximum(0, diagonal)
        count = np.minimum(starts[text + 1] - starts[text], diagonal + length) - first
        least = np.minimum(min_words, length)
        ends = np.cumsum(count)
        at = 0
        while at < len(hits):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_WORDS, "right")))
            own = slice(at, to)
            n, low = count[own], least[own]
            begin = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(begin, n)
            equal = words[place + np.repeat(starts[text[own]] + first[own], n)] == self.words[place + np.repeat(self.at[item[own]] + first[own] - diagonal[own], n)]
            total = np.concatenate([[0], np.cumsum(equal)])
            fits = np.zeros(to - at, bool)
            maybe = (n >= low) & (total[begin + n] - total[begin] >= min_equal * low)
            # A stretch of twice the words is two of which one is as equal, so that the lengths below that suffice.
            for size in range(int(low[maybe].min(initial=1)), 2 * int(low[maybe].max(initial=0))):
                now = np.flatnonzero(maybe & ~fits & (low <= size) & (size < 2 * low) & (size <= n))
                if len(now):
                    many = n[now] - size + 1
                    owner = np.repeat(now, many)
                    left = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[owner]
                    fits[owner[total[left + size] - total[left] >= min_equal * size - 1e-9]] = True
            yield from map(tuple, hits[own][fits].tolist())
            at = to

    def overlap(self, words: np.ndarray, item: int, diagonal: int, penalty: float, min_words: int, min_equal: float) -> tuple[int, int, int] | None:
        """The stretch on a diagonal: its first word in the text, its words, and how many are equal."""
        own = self.words[self.at[item] : self.at[item + 1]]
        first, last = max(0, diagonal), min(len(words), diagonal + len(own))
        equal = words[first:last] == own[first - diagonal : last - diagonal]
        run = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -penalty))])
        low = np.minimum.accumulate(run)
        end = int(np.argmax(run - low))
        begin = int(np.flatnonzero(run[:end] == low[end])[-1]) if end else 0
        least = min(min_words, len(own))
        if end - begin < least or equal[begin:end].sum() < min_equal * (end - begin):
            run = np.concatenate([[0.0], np.cumsum(equal - min_equal)])
            begins = np.searchsorted(-np.minimum.accumulate(run), -run - 1e-9, "left")  # for each end the first begin that is not above it
            sizes = np.arange(len(run)) - begins
            end = int(np.argmax(sizes))
            begin = int(begins[end])
            if end - begin < least:
                return None
        return first + begin, end - begin, int(equal[begin:end].sum())


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_equal", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("similarity", T.DoubleType()),
    ]
)


def blocks_of(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items with a text, in blocks of at most ``block_bytes`` (single items excepted); only one block is on the driver at a time."""
    held, size = [], 0
    for row in items.select(F.col(item_id).cast("long"), F.col(text).cast("string")).where(F.length(F.col(text)) > 0).toLocalIterator():
        n = len(row[1].encode())
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    yield held


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL, penalty: float = PENALTY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each text and benchmark item that overlap: the longest stretch and how many of its words are equal."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for items_now in blocks_of(items, item_id, item_text, block_bytes):
        part = source.mapInArrow(_searcher(docs.sparkSession, items_now, min_words, min_equal, penalty), RESULT)
        out = part if out is None else out.unionByName(part)
    return out


#: The index that a worker built last, by the block that it is of.
_BUILT: dict[str, Block] = {}


def _index(name: str, sent) -> Block:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Block(sent.value)
    return _BUILT[name]


def _searcher(spark: SparkSession, items: list[tuple[int, str]], min_words: int, min_equal: float, penalty: float):
    """Searches texts for a block of items, which is broadcast."""
    sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _index(name, sent)
        for whole in batches:
            for batch in steps(whole):
                words, starts = word_hashes(batch.column(1))
                best: dict[tuple[int, int], tuple] = {}
                for k, item, diagonal in block.fitting(words, starts, block.hits(words, starts), min_words, min_equal):
                    found = block.overlap(words[starts[k] : starts[k + 1]], item, diagonal, penalty, min_words, min_equal)
                    length = int(block.at[item + 1] - block.at[item])
                    if not found:
                        continue
                    if (k, item) not in best or (found[2], -found[0]) > (best[k, item][2], -best[k, item][0]):
                        best[k, item] = (*found, length)
                if best:
                    ids = batch.column(0).to_pylist()
                    rows = [(ids[k], block.ids[item], a, n, e, length, e / n) for (k, item), (a, n, e, length) in best.items()]
                    kinds = [pa.int64()] * 6 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=RESULT.fieldNames())

    return searched


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL, penalty: float = PENALTY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text overlaps with an item; each row is decided for itself, so ids need not be unique."""
    out = docs
    for items_now in blocks_of(items, item_id, item_text, block_bytes):
        search = _searcher(docs.sparkSession, items_now, min_words, min_equal, penalty)

        def kept(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in steps(whole, text):
                    column = batch.column(batch.schema.get_field_index(text))
                    numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), column], names=["doc_id", "text"])
                    bad = {i for x in search(iter([numbered])) for i in x.column(0).to_pylist()}
                    yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(kept, out.schema)
    return out
