"""Samples: balanced, covering every tag, weighted by rarity, and splits that stay the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.prefix import CHUNK, dense_number, first_n_by_hash, prefix_sum


def balanced(bags: DataFrame, tags: list[str], cap: int | None, seed: str = "0") -> DataFrame:
    """(item, positive): up to ``cap`` items with any of ``tags``, and as many of the leftover and the items without, both in hash order."""
    marked = bags.groupBy("item").agg(F.max(F.col("tag").isin(tags).cast("int")).alias("hit"))
    matching = marked.where("hit = 1").select("item")
    positives = matching if cap is None else first_n_by_hash(matching, "item", cap, f"{seed}p")
    count = positives.count()
    pool = marked.select("item").join(positives, "item", "left_anti")
    negatives = first_n_by_hash(pool, "item", count, f"{seed}n")
    return positives.select("item", F.lit(1).alias("positive")).unionByName(negatives.select("item", F.lit(0).alias("positive")))


def coverage(bags: DataFrame, most: int, per_tag: int) -> DataFrame:
    """(item): a sample of at most ``most`` items that gives rare tags their share.

    ``bags`` has (item, pos, tag), ``pos`` the corpus order; an item without a tag has a row with a null one. If there are no more items than ``most``, all are taken. Else
    tags take turns from the rarest on (ties: first seen), each adding its first ``per_tag`` items that are not taken yet, and
    what is left of the budget goes to the first items of the corpus.

    A tag's turn can only take one of its first ``per_tag * turn`` items, as no more are taken before it, and never more than
    ``most`` are: only those rows, already in order of turns, reach the one task that plays the turns, and it streams over
    them with the set of taken items.
    """
    items = bags.select("item", "pos").distinct()
    if items.limit(most + 1).count() <= most:
        return items.select("item")
    rows = bags.select("item", "pos", "tag").where("tag IS NOT NULL").distinct()
    tags = rows.groupBy("tag").agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
    tags = dense_number(tags, "n", "seen", "tag", into="turn").withColumn("turn", F.col("turn") + 1)
    # The first limit is a number, so that each task passes on no more rows of a tag than that; then the tag's own.
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy("pos"))).where(F.col("r") <= most + per_tag)
    useful = first.join(tags.select("tag", "turn"), "tag").where(F.col("r") <= F.col("turn") * per_tag)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set = set()
        turn, given = None, 0
        for batch in batches:
            for now, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != turn:
                    turn, given = now, 0
                if given < per_tag and len(taken) < most and item not in taken:
                    taken.add(item)
                    given += 1
        yield pa.RecordBatch.from_arrays([pa.array(sorted(taken), pa.int64())], names=["item"])

    chosen = useful.select("turn", F.col("item").cast("long").alias("item"), "r").repartition(1).sortWithinPartitions("turn", "r").mapInArrow(play, "item long")
    chosen = chosen.join(items, "item").withColumn("kind", F.lit(0))
    rest = items.orderBy("pos").limit(most).withColumn("kind", F.lit(1))  # of the first ``most``, enough are not taken yet
    both = chosen.unionByName(rest.select(chosen.columns)).groupBy("item").agg(F.min("kind").alias("kind"), F.min("pos").alias("pos"))
    return both.orderBy("kind", "pos").limit(most).select("item")


def rare_weights(bags: DataFrame) -> DataFrame:
    """(item, weight): one over the count of the item's rarest tag. Items without a tag have no rows here and weigh 0."""
    counts = bags.groupBy("tag").agg(F.count("*").alias("n"))
    return bags.join(counts, "tag").groupBy("item").agg((F.lit(1.0) / F.greatest(F.min("n"), F.lit(1))).alias("weight"))


def cumulative(weights: DataFrame) -> DataFrame:
    """(item, weight, low, high, chunk): the weights' running sum by item."""
    out = prefix_sum(weights, "item", F.col("weight"), "low", chunk_column="chunk")
    return out.withColumn("high", F.col("low") + F.col("weight"))


def weighted_draws(weights: DataFrame, draws: DataFrame) -> DataFrame:
    """(draw, item): for each draw's ``u`` in [0, 1) the first item whose running sum reaches ``u`` times the total; draws are independent, with replacement.

    A draw is first given to the chunk of items that its target falls into (a row a chunk), then joined inside the chunk.
    """
    run = cumulative(weights)
    ends = run.groupBy("chunk").agg(F.min("low").alias("from"), F.max("high").alias("to"))
    total = F.max("to").over(Window.partitionBy())
    ends = ends.withColumn("total", total)
    target = F.col("u") * F.col("total")
    dealt = draws.join(F.broadcast(ends), (target > F.col("from")) & (target <= F.col("to")) | ((target == 0) & (F.col("from") == 0))).select("draw", target.alias("target"), "chunk")
    hit = dealt.join(run.select("chunk", "item", "low", "high"), "chunk").where(F.col("high") >= F.col("target"))
    return hit.groupBy("draw").agg(F.min("item").alias("item"))


def train_split(items: DataFrame, fraction: float, key: str = "item", seed: str = "split") -> DataFrame:
    """``items`` with ``validation``: of n > 1 items, clamp(int(n * fraction), 1, n - 1) in hash order, the same in every run; none of one."""
    n = items.count()
    size = 0 if n <= 1 else min(max(int(n * fraction), 1), n - 1)
    return split_of(items, size, key, seed)


def small_split(items: DataFrame, key: str = "item", seed: str = "split") -> DataFrame:
    """As ``train_split`` for the few items of a new tag: none of fewer than 6, else a fifth."""
    n = items.count()
    return split_of(items, 0 if n < 6 else max(1, n // 5), key, seed)


def split_of(items: DataFrame, size: int, key: str, seed: str) -> DataFrame:
    chosen = first_n_by_hash(items.select(key).distinct(), key, size, seed).withColumn("__v", F.lit(True))
    return items.join(chosen, key, "left").withColumn("validation", F.coalesce("__v", F.lit(False))).drop("__v")


def uniform_row(dim: int, low: float = -0.02, high: float = 0.02, seed: int = 0) -> Column:
    """A random start for an embedding row: ``dim`` draws between ``low`` and ``high``."""
    return F.array(*[F.rand(seed + k) * (high - low) + low for k in range(dim)])


__all__ = ["CHUNK", "balanced", "coverage", "cumulative", "rare_weights", "small_split", "split_of", "train_split", "uniform_row", "weighted_draws"]
