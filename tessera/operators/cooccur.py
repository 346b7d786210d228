"""Tag co-occurrence: pair counts, hard-negative sources, negative query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.taxonomy import raw_name


def tag_counts(bags: DataFrame, tag: str = "tag") -> DataFrame:
    return bags.groupBy(tag).agg(F.count("*").alias("n_items"))


def pair_counts(bags: DataFrame, item: str = "item", tag: str = "tag", mirrored: bool = True) -> DataFrame:
    """(tag, other, n_both): unordered pairs of different tags of an item, counted; ``mirrored`` has both directions.

    An item's tags are brought together once and its pairs are made there, so the exchange is by item, never by tag, and
    pair counts are summed before the second exchange. An item has as many pairs as its own tags allow.
    """
    held = bags.groupBy(item).agg(F.array_sort(F.collect_list(tag)).alias("__tags")).where(F.size("__tags") > 1)
    left = held.select("__tags", F.posexplode("__tags").alias("__k", "tag"))
    pairs = left.select("tag", F.explode(F.slice("__tags", F.col("__k") + 2, F.size("__tags"))).alias("other")).where(F.col("tag") != F.col("other"))
    once = pairs.groupBy("tag", "other").agg(F.count("*").alias("n_both"))
    return once.unionByName(once.select(F.col("other").alias("tag"), F.col("tag").alias("other"), "n_both")) if mirrored else once


def hard_negative_sources(bags: DataFrame, min_ratio: float, min_counter: int, max_sources: int | None = None) -> DataFrame:
    """(tag, other, n_both, n_other, counter, ratio, rank): tags that often stand beside a tag and often without it.

    Ranked by falling ratio, falling counter-examples, rising name.
    """
    counts = tag_counts(bags)  # a row for each tag of the vocabulary
    pairs = pair_counts(bags)
    found = pairs.join(counts.withColumnRenamed("n_items", "n_target"), "tag").join(counts.select(F.col("tag").alias("other"), F.col("n_items").alias("n_other")), "other")
    found = found.withColumn("ratio", F.col("n_both") / F.col("n_target")).withColumn("counter", F.col("n_other") - F.col("n_both"))
    found = found.where((F.col("ratio") >= min_ratio) & (F.col("counter") >= min_counter))
    order = Window.partitionBy("tag").orderBy(F.desc("ratio"), F.desc("counter"), "other")
    found = found.withColumn("rank", F.row_number().over(order)).select("tag", "other", "n_both", "n_other", "counter", "ratio", "rank")
    return found if max_sources is None else found.where(F.col("rank") <= max_sources)


def negative_query_plan(targets: DataFrame, bags: DataFrame, min_ratio: float, min_counter: int, max_sources: int) -> DataFrame:
    """(tag, step, query, phase, label): a target's hard-negative queries in order, then its background query."""
    target = raw_name(F.col("tag"))
    hard = hard_negative_sources(bags, min_ratio, min_counter, max_sources).join(targets.select("tag").distinct(), "tag", "left_semi")
    first = hard.select("tag", F.col("rank").alias("step"), F.concat(raw_name(F.col("other")), F.lit(" -"), target).alias("query"), F.concat(F.lit("negative:cooccur:"), "other").alias("phase"), F.col("other").alias("label"))
    # The fallback comes last: its step is one more than the target's hard negatives.
    last = targets.select("tag").distinct().join(hard.groupBy("tag").agg(F.max("rank").alias("__n")), "tag", "left")
    last = last.select("tag", (F.coalesce("__n", F.lit(0)) + 1).alias("step"), F.concat(F.lit("-"), target).alias("query"), F.lit("negative").alias("phase"), F.lit("background").alias("label"))
    return first.unionByName(last)
