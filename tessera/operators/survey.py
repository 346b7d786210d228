"""Tag surveys of two sites: reading prefix, merge, eligibility, summaries, upsert."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.taxonomy import ExclusionRules, best_count, identity
from tessera.operators.aliases import fold_counts, stale


def take_while(listing: DataFrame, min_count: int) -> DataFrame:
    """Rows of each site's listing (site, pos, n) ahead of its first count under ``min_count``; a later one above it is not read."""
    first_under = listing.where(F.col("n") < min_count).groupBy("site").agg(F.min("pos").alias("__stop"))
    return listing.join(F.broadcast(first_under), "site", "left").where(F.col("__stop").isNull() | (F.col("pos") < F.col("__stop"))).drop("__stop")


def last_listed(listing: DataFrame) -> DataFrame:
    """One row for a site's raw name: the last listed, at the place of the first."""
    return listing.groupBy("site", "raw").agg(F.max_by(F.struct("category", "n"), "pos").alias("x"), F.min("pos").alias("pos")).select("site", "raw", "x.category", "x.n", "pos")


def merge_sites(listing: DataFrame, closed: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(name, count_a, count_b, best_count): a full outer join of two sites' listings by raw name after folding aliases; the first site's category wins."""
    folded = fold_counts(last_listed(listing), closed)
    a, b = (folded.where(F.col("site") == s).select("raw", F.col("category").alias(f"category_{x}"), F.col("n").alias(f"count_{x}")) for s, x in ((first, "a"), (second, "b")))
    both = a.join(b, "raw", "full_outer")
    name = identity(F.col("raw"), F.coalesce("category_a", "category_b"))
    return both.select(name.alias("name"), "raw", "count_a", "count_b", best_count(F.col("count_a"), F.col("count_b")).alias("best_count"))


def image_slots(tags: DataFrame, max_images: int) -> DataFrame:
    return tags.agg(F.coalesce(F.sum(F.least(F.lit(max_images).cast("long"), F.col("best_count").cast("long"))), F.lit(0)).cast("long").alias("image_slots"))


def summary(tags: DataFrame, min_images: int, max_images: int, rules: ExclusionRules = ExclusionRules()) -> DataFrame:
    """One row: how many tags there are, are eligible, are excluded, and the image slots of the eligible."""
    excluded = rules.excluded(F.col("name"))
    fits = (F.col("best_count") >= min_images) & ~excluded
    slots = F.sum(F.when(fits, F.least(F.lit(max_images).cast("long"), F.col("best_count").cast("long"))))
    return tags.agg(
        F.count("*").alias("total_tags"), F.count(F.when(fits, 1)).alias("eligible_tags"), F.count(F.when(excluded, 1)).alias("excluded_tags"), F.coalesce(slots, F.lit(0)).cast("long").alias("image_slots")
    )


def estimate(tags: DataFrame, min_images: int, max_images: int, page_sizes: dict[str, int], rates: dict[str, float], requests_made: int = 0, rules: ExclusionRules = ExclusionRules()) -> DataFrame:
    """One row: eligible tags, image slots, requests (pages at the sites' mean page size) and seconds at the sites' joint rate."""
    page = max(1.0, sum(page_sizes.values()) / len(page_sizes) if page_sizes else 1.0)
    rate = math.fsum(rates.values())
    out = summary(tags, min_images, max_images, rules).select("eligible_tags", "image_slots")
    out = out.withColumn("requests", (F.lit(requests_made) + F.ceil(F.col("image_slots") / F.lit(page))).cast("long"))
    return out.withColumn("seconds", F.col("requests") / F.lit(rate) if rate > 0 else F.lit(0.0))


def rarest_first(tags: DataFrame) -> DataFrame:
    return tags.orderBy("best_count", "name")


def upsert(stored: DataFrame, survey: DataFrame) -> DataFrame:
    """The stored survey (name, count_a, count_b, positives) after a new one: new counts replace old ones, positives and rows that are not surveyed stay."""
    new = survey.select("name", F.col("count_a").alias("__a"), F.col("count_b").alias("__b"), F.lit(True).alias("__new"))
    both = stored.join(new, "name", "full_outer")
    pick = lambda n, o: F.when(F.col("__new"), F.col(n)).otherwise(F.col(o))
    return both.select("name", pick("__a", "count_a").alias("count_a"), pick("__b", "count_b").alias("count_b"), F.coalesce("positives", F.lit(0)).alias("positives"))


def prune_report(stored: DataFrame, aliases: DataFrame, closed: DataFrame) -> DataFrame:
    """What pruning aliased tags would delete: name, the name it ends at, and its counts."""
    from tessera.functions.taxonomy import raw_name

    gone = stale(stored, aliases).withColumn("raw", raw_name(F.col("name")))
    return gone.join(closed, "raw").select("name", F.col("canonical").alias("target"), "count_a", "count_b")


def prune(stored: DataFrame, aliases: DataFrame) -> DataFrame:
    return stored.join(stale(stored, aliases).select("name"), "name", "left_anti")


def progress(keys: DataFrame, stored: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Stored progress for each key; defaults where there is none."""
    out = keys.join(stored, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c) for c, v in defaults.items()})


def rank_rarest(tags: DataFrame) -> DataFrame:
    """``rarest_first`` as a rank column; the vocabulary is a dimension table, so one ordered task is enough."""
    return tags.withColumn("rank", F.row_number().over(Window.orderBy("best_count", "name")))
