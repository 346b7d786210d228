"""Scores of items against tag embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Numbers of a block of tag embeddings that is sent to the tasks; larger tables are scored block by block.
BLOCK_VALUES = 8_000_000
#: Scores that a task computes before it gives them on.
SCORES_AT_ONCE = 2_000_000


def _blocks(tags: DataFrame, key: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    keys, rows, size = [], [], 0
    for r in tags.select(key, vector).orderBy(key).toLocalIterator():
        keys.append(r[0])
        rows.append(r[1])
        size += len(r[1])
        if size >= BLOCK_VALUES:
            yield keys, np.array(rows, np.float64)
            keys, rows, size = [], [], 0
    if rows:
        yield keys, np.array(rows, np.float64)


def score(items: DataFrame, tags: DataFrame, threshold: float | None = 0.5, item: str = "item", vector: str = "v", key: str = "label") -> DataFrame:
    """(item, label, conf): sigmoid of the inner product of each item with each tag, where it reaches ``threshold``.

    Items stay where they are; tags come to them in blocks of a fixed size, and scores below the threshold are never made
    into rows. Vectors of different sizes are an error.
    """
    kinds = dict(tags.dtypes)[key]
    out = None
    for keys, table in _blocks(tags, key, vector):

        def scored(batches: Iterator[pa.RecordBatch], keys=keys, table=table) -> Iterator[pa.RecordBatch]:
            names = np.array(keys)
            kind = pa.int64() if isinstance(keys[0], int) else pa.string()
            for batch in batches:
                step = max(1, SCORES_AT_ONCE // len(table))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    vectors = part.column(1)
                    width = table.shape[1]
                    if not (np.diff(vectors.offsets.to_numpy()) == width).all():
                        raise ValueError("vectors differ in size")
                    conf = 1 / (1 + np.exp(-(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) @ table.T)))
                    row, col = np.nonzero(conf >= threshold) if threshold is not None else np.nonzero(np.ones_like(conf, bool))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(names[col].tolist(), kind), pa.array(conf[row, col])], names=["item", "label", "conf"])

        part = items.select(F.col(item).alias("item"), F.col(vector).alias("v")).mapInArrow(scored, f"item {dict(items.dtypes)[item]}, label {'bigint' if kinds in ('int', 'bigint') else kinds}, conf double")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("label", F.col("label").cast(kinds))


def ranked(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Scores with their rank inside the item: falling confidence, then the tag's key."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("conf"), "label")))
    return out if top is None else out.where(F.col("rank") <= top)


def as_json(scores: DataFrame) -> DataFrame:
    """(item, json): an item's scores as one JSON object, best first."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), F.col("label").cast("string").alias("label"), F.round("conf", 6).alias("conf"))))
    pairs = F.transform(order, lambda s: F.struct(s["label"], s["conf"]))
    return scores.groupBy("item").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def as_lines(scores: DataFrame) -> DataFrame:
    """Lines ``confidence<tab>tag`` with three places."""
    return scores.select("item", F.format_string("%.3f\t%s", F.col("conf"), F.col("label").cast("string")).alias("line"))
