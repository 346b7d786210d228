"""Reconciling an item's tags with what its sources say now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

def _none() -> Column:
    return F.array().cast("array<string>")


def reconcile(current: DataFrame, snapshots: DataFrame, observed: DataFrame) -> DataFrame:
    """(item, tags, added, removed, unknown) after sources were read again.

    ``current`` (item, tags), ``snapshots`` (item, source, tags; null: never captured, an empty list: known to be empty),
    ``observed`` (item, source, tags; null: the source is gone and says nothing). What any source says is added always.
    What none says is removed only if no other source is unknown.
    """
    seen = observed.select("item", "source", F.coalesce("tags", _none()).alias("__now"), F.lit(True).alias("__seen"))
    every = snapshots.join(seen, ["item", "source"], "full_outer").withColumn("__tags", F.when(F.col("__seen"), F.col("__now")).otherwise(F.col("tags")))
    said = every.groupBy("item").agg(
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("__tags", _none())))).alias("said"),
        F.bool_or(F.col("__tags").isNull()).alias("unknown"),
        F.bool_or(F.coalesce("__seen", F.lit(False))).alias("__read"),
    )
    both = current.join(said, "item", "left").where(F.coalesce("__read", F.lit(False)))
    added = F.array_sort(F.array_except("said", "tags"))
    removed = F.when(F.col("unknown"), _none()).otherwise(F.array_sort(F.array_except("tags", "said")))
    both = both.withColumn("added", added).withColumn("removed", removed)
    return both.select("item", F.array_sort(F.array_except(F.array_union("tags", "added"), "removed")).alias("tags"), "added", "removed", "unknown")


def deltas(reconciled: DataFrame) -> DataFrame:
    """(tag, delta): the net change of each tag's count; tags without one are left out."""
    moves = reconciled.select(F.explode("added").alias("tag"), F.lit(1).alias("d")).unionByName(reconciled.select(F.explode("removed").alias("tag"), F.lit(-1).alias("d")))
    return moves.groupBy("tag").agg(F.sum("d").alias("delta")).where("delta != 0")


def apply_deltas(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts after ``changes``; tags that are not in the table are not made."""
    return counts.join(changes, "tag", "left").select("tag", (F.col("positives") + F.coalesce("delta", F.lit(0))).alias("positives"))


def refresh_counters(reconciled: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: sources read, items changed."""
    changed = reconciled.where((F.size("added") > 0) | (F.size("removed") > 0)).agg(F.count_distinct("item").alias("items_changed"))
    checked = observed.agg(F.count("*").alias("sources_checked"))
    return checked.withColumn("__k", F.lit(1)).join(changed.withColumn("__k", F.lit(1)), "__k").drop("__k")


def next_batch(sources: DataFrame, site: str, after: int, limit: int) -> DataFrame:
    """The next ``limit`` sources of a site by post id: a page of a keyset walk."""
    return sources.where((F.col("site") == site) & (F.col("post_id") > after)).orderBy("post_id").limit(limit)


def targeted(sources: DataFrame, bags: DataFrame, tags: list[str], sites: list[str]) -> DataFrame:
    """Sources, on the given sites, of the items that hold any of ``tags``."""
    items = bags.where(F.col("tag").isin(tags)).select("item").distinct()
    return sources.where(F.col("site").isin(sites)).join(items, "item", "left_semi")


def with_item(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Sources whose item exists; orphans are skipped."""
    return sources.join(items.select("item"), "item", "left_semi")
