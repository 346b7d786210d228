"""Best-fit packing: bounded-space online best-fit of token pieces into
sequences of a fixed length.

1. Each text is tokenised (``tokens.UnitEncoder``) and cut into pieces of at
   most ``capacity`` ids; only longer texts are cut.
2. Pieces, without their ids unless asked for, are dealt by a hash of their
   key to tasks of about ``pieces_per_task``; the number of tasks follows the
   count of pieces, so a task's memory is bounded and its share of
   part-filled sequences (at most ``open_bins``) stays small.
3. A task puts each piece in the open sequence with the least space that it
   fits. The open ones stand in a bitset keyed by free space. If none fits
   and ``open_bins`` are open, the fullest closes.

Defined results: a null or empty text is one piece, the end id alone. Repeated
rows are packed each for itself; a null id is a key like any other. An empty
table gives no rows. Columns beside id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.common import cut, steps
from tessera.llm.tokens import UnitEncoder

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 1024
PIECES_PER_TASK = 100_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: its document, number, first id's place, length, CRC-32 of its ids and, if asked for, the ids.

    ``copy`` tells apart the rows of a repeated id.
    """
    path = path or vocabulary_path()
    schema = T.StructType([*PIECE, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    end = np.array([end_id], "<u4")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of(path)
        for whole in batches:
            for batch in steps(whole):
                rows, held = [], []
                flat, bounds = encoder.encode(batch.column(1))
                for i, (key, copy) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    ids = np.concatenate([flat[bounds[i] : bounds[i + 1]].astype("<u4"), end])
                    for number, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        rows.append((key, copy, number, at, len(part), zlib.crc32(part.tobytes())))
                        if with_ids:
                            held.append(part.astype(np.int32))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                if with_ids:
                    arrays.append(pa.array(held, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("copy"))
    return source.mapInArrow(cut_up, schema)


class OpenBins:
    """The open sequences of a task: a bitset of the free spaces there are, and for each the sequences with it, oldest first."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        held = self.by_space[space]
        out = held.pop()
        if not held:
            self.bits &= ~(1 << space)
        return out

    def put(self, length: int) -> tuple[int, int]:
        """The sequence that a piece of ``length`` goes to, and its offset there."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.open -= 1
            space, number = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = space - length
        if left:
            self.by_space[left].append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - space


def assign(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``parts`` (with doc_id, copy, piece, length; written already, as it is read twice) with sequence_id and offset."""
    tasks = max(1, -(-parts.count() // pieces_per_task))
    schema = T.StructType([*parts.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            placed = [bins.put(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            numbers = np.array(placed, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers[:, 0] + base), pa.array(numbers[:, 1])], names=schema.fieldNames())

    # The order inside a task is by a hash, hence the same when a task is run again, and mixes long and short pieces.
    key = [F.col(c) for c in ("doc_id", "copy", "piece")]
    dealt = parts.repartition(tasks, *key).sortWithinPartitions(F.xxhash64(*key), *key)
    return dealt.mapInArrow(packed, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` with the sequence and the place they go to."""
    return assign(cut(pieces(docs, doc_id, text, path, capacity, with_ids=with_ids)), capacity, open_bins)
