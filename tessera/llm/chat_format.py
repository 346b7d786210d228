"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. For a whole Arrow batch
the segment lengths, their cumulative offsets and the scatter indices are
computed in numpy, and headers and contents are copied into one preallocated
buffer, which is the result column's data as it stands.

Control strings inside a role or a text are escaped so that they can be read
back: ``<``, any backslashes and ``|`` get one backslash more before the ``|``.
In a role, backslashes and newlines are escaped too. The loss mask is the
content of assistant turns.

Turns are formatted where they are read, without a shuffle, so a conversation
of any length costs no more than its rows. ``read_back`` then walks through
each conversation in order of its turns, null first (turns of one number: by
their formatted text), holding two running digests and no text.

Defined results: a null text or role is empty; a null conversation id is a
conversation of its own; a repeated row is a turn of its own, next to its
twin; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.common import steps, utf8

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(texts, ""), r"<(\\*)\|", r"<\\\1|")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    out = pc.replace_substring(pc.fill_null(roles, ""), "\\", "\\\\")
    return escape(pc.replace_substring(out, "\n", "\\n"))


def unescape_role(role: str) -> str:
    role = unescape(pa.array([role]))[0].as_py()
    out, parts = [], iter(role)
    for c in parts:
        out.append({"n": "\n"}.get(d := next(parts, ""), d) if c == "\\" else c)
    return "".join(out)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and the bytes in each where its content begins and ends. Roles and texts are escaped already."""
    n = len(texts)
    constants = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", f"{END}\n")]
    role_data, role_at = utf8(roles)
    text_data, text_at = utf8(texts)
    lengths = np.empty((n, 5), np.int64)  # start, role, newline, text, end
    lengths[:, 0::2] = [len(c) for c in constants]
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    stops = np.cumsum(lengths.reshape(-1))
    begins = (stops - lengths.reshape(-1)).reshape(n, 5)
    buffer = np.empty(int(stops[-1]) if n else 0, np.uint8)
    for k, bytes_ in zip((0, 2, 4), constants, strict=True):
        buffer[begins[:, k, None] + np.arange(len(bytes_))] = bytes_
    for k, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        buffer[np.arange(len(data)) + np.repeat(begins[:, k] - at[:-1], np.diff(at))] = data
    offsets = np.append(begins[:, 0], len(buffer)).astype(np.int64) if n else np.zeros(1, np.int64)
    column = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).cast(pa.string())
    return column, begins[:, 3] - begins[:, 0], begins[:, 4] - begins[:, 0]


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each row of ``turns`` as formatted text, with the byte span under the loss mask (null for turns that are not learned)."""
    source = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.IntegerType()), T.StructField("loss_end", T.IntegerType())])

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                column, first, last = assemble(escape_role(batch.column(2)), escape(batch.column(3)))
                other = pc.fill_null(pc.not_equal(batch.column(2), ASSISTANT), True).to_numpy(zero_copy_only=False).astype(bool)
                spans = [pa.array(x.astype(np.int32), mask=other) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column, *spans], names=schema.fieldNames())

    return source.mapInArrow(formatted, schema)


DIGEST = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text, as they were before formatting; raises if the turn is malformed."""
    head, found, content = formatted.partition("\n")
    tail = f"{END}\n"
    if not (found and head.startswith(START) and content.endswith(tail)):
        raise ValueError(f"not a formatted turn: {formatted[:80]!r}")
    return unescape_role(head[len(START) :]), unescape(pa.array([content[: -len(tail)]], pa.large_string()))[0].as_py()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation as they come out of the formatted turns.

    A digest has one order, so one task reads a conversation through; it holds one batch and two hash states.
    """

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        n = chars = loss = 0
        turns = learned = None
        rows: list[tuple] = []

        def done() -> None:
            rows.append((now[0], n, turns.hexdigest(), loss, learned.hexdigest(), chars))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=DIGEST.fieldNames())

        for batch in batches:
            for key, text, first, last in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if now != (key,):
                    if now:
                        done()
                    now, n, chars, loss, turns, learned = (key,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, content = parse_turn(text)
                n += 1
                chars += len(text)
                turns.update(f"{role}\n{content}\n".encode())
                if first is not None:
                    masked = unescape(pa.array([text.encode()[first:last].decode()], pa.large_string()))[0].as_py()
                    loss += len(masked)
                    learned.update(masked.encode())
            if len(rows) >= 1000:
                yield out()
                rows = []
        if now:
            done()
        if rows:
            yield out()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(walked, DIGEST)
