"""Helpers that the corpus operators share: shared storage, Arrow slicing and
vectorised word hashing.

Words are the maximal runs of ASCII letters, digits and non-ASCII characters
of a text; every operator that says "word" without a pattern of its own means
these, lower-cased.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a vectorised step looks at together; a longer text is a step of its own.
STEP_BYTES = 1 << 19
#: Bytes of an Arrow batch: Spark's own limit, and the one set in its place.
SPARK_BATCH_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Bytes hashed at once inside a step: what is kept for each byte stays small however long a text is.
SEGMENT_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only in local mode where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return named or current


def bounded_batches(spark: SparkSession) -> None:
    """Sets the bytes of an Arrow batch for this session, unless it has a limit of its own: a task holds several batches, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(SPARK_BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later steps neither recompute it nor depend on one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have at most ``limit`` bytes together, single rows excepted."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ``texts`` (null: empty), and where each begins; the last entry is the end."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts.cast(pa.large_string())])  # an array of its own, from offset 0 on
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without visible structure."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased ``texts`` in order, and for each text where its words begin (one more entry: the end)."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(data)
    found, begins = [], []
    at = 0
    inner = offsets[1:-1]
    while at < n:
        to = min(n, at + SEGMENT_BYTES)
        while to < n and _IS_WORD[data[to - 1]] and _IS_WORD[data[to]]:  # not inside a word
            step = _IS_WORD[data[to : to + 4096]]
            stop = int(np.argmin(step)) if not step.all() else len(step)
            to += max(1, stop)
        part = data[at:to]
        word = _IS_WORD[part]
        first = np.zeros(len(part) + 1, bool)
        first[inner[np.searchsorted(inner, at) : np.searchsorted(inner, to)] - at] = True
        first[0] = True
        before = np.concatenate([[False], word[:-1]])
        start = np.flatnonzero(word & (~before | first[:-1]))
        after = np.concatenate([word[1:], [False]])
        end = np.flatnonzero(word & (~after | np.concatenate([first[1:-1], [True]]))) + 1
        up, down = _powers(len(part))
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(np.where(word, _BYTE[part], np.uint64(0)) * up[: len(part)], dtype=np.uint64)])
            found.append(mix((total[end] - total[start]) * down[start]))
        begins.append(start + at)
        at = to
    hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
    where = np.concatenate(begins) if begins else np.empty(0, np.int64)
    return hashes, np.searchsorted(where, offsets, "left").astype(np.int64)


_SHINGLE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words within each text, and the texts' bounds.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(starts)
    n = len(hashes)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    if not n:
        return np.empty(0, np.uint64), bounds
    # Position of each shingle's first word.
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts[:-1], per)
    left = np.repeat(starts[1:], per) - at
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            part = hashes[np.minimum(at + k, n - 1)] * _SHINGLE[k]
            out += part if bool((left > k).all()) else np.where(left > k, part, np.uint64(0))
    return mix(out), bounds


def distinct_shingles(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its distinct shingles (44 bits of the hash, ascending), their counts, and the texts' bounds."""
    texts = len(bounds) - 1
    if texts >= 1 << 20:
        raise ValueError("too many texts in a step")
    owner = np.repeat(np.arange(texts, dtype=np.uint64), np.diff(bounds))
    keys, counts = np.unique((owner << np.uint64(44)) | (hashes >> np.uint64(20)), return_counts=True)
    at = np.searchsorted(keys, np.arange(texts + 1, dtype=np.uint64) << np.uint64(44))
    return keys & np.uint64((1 << 44) - 1), counts, at.astype(np.int64)
