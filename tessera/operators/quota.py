"""Quotas of a crawl: when to go on, floors, shortfalls, and who is credited with what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keeps_fetching(count: Column, most: Column | int) -> Column:
    return count < most


def negative_shortfall(total: Column, positives: Column, target: Column | int) -> Column:
    target = target if isinstance(target, Column) else F.lit(target)
    return F.greatest(F.lit(0), target - (total - positives))


def site_floor(most: Column | int, sites: int) -> Column:
    most = most if isinstance(most, Column) else F.lit(most)
    return F.ceil(most / F.lit(sites)).cast("long")


def site_continues(own: Column, combined: Column, most: int, sites: int) -> Column:
    """A site goes on while it is under its own floor or all together are under the quota."""
    return (own < site_floor(most, sites)) | (combined < most)


def needs_recheck(satisfied_at: Column, most: int) -> Column:
    """Whether a quota that was met under an older maximum has to be looked at again."""
    return F.coalesce(satisfied_at < most, F.lit(True))


def associations(sightings: DataFrame) -> DataFrame:
    """First sighting of every (item, tag) in order of ``seq``: the site that is credited with it."""
    return sightings.groupBy("item", "tag").agg(F.min_by("site", "seq").alias("site"), F.min("seq").alias("seq"))


def combined_counts(sightings: DataFrame) -> DataFrame:
    return associations(sightings).groupBy("tag").agg(F.count("*").alias("positives"))


def site_credit(sightings: DataFrame, searched: Column) -> DataFrame:
    """(site, tag, credit): new associations count for the site that brought them; a later sighting of the ``searched`` tag on an item that has it counts for its own site."""
    first = associations(sightings).select("item", "tag", F.col("seq").alias("__first"))
    every = sightings.join(first, ["item", "tag"])
    counted = (F.col("seq") == F.col("__first")) | searched
    return every.where(counted).groupBy("site", "tag").agg(F.count("*").alias("credit"))


def site_duplicates(sightings: DataFrame) -> DataFrame:
    """(site, tag, duplicates): sightings of associations that were known already."""
    first = associations(sightings).select("item", "tag", F.col("seq").alias("__first"))
    return sightings.join(first, ["item", "tag"]).where(F.col("seq") != F.col("__first")).groupBy("site", "tag").agg(F.count("*").alias("duplicates"))


def shortfalls(counts: DataFrame, most: int) -> DataFrame:
    return counts.where(F.col("positives") < most).withColumn("missing", F.lit(most) - F.col("positives"))


def early_stopping(losses: DataFrame, patience: int = 3, min_delta: float = 1e-4) -> DataFrame:
    """(run, step, loss, stops): whether training ends after a step, for each run's losses in order.

    A run's steps are one ordered list, folded with the best loss so far and the steps since; an improvement has to be
    larger than ``min_delta``. The fold has no window form, as the best loss moves only by such improvements.
    """
    state = "struct<best:double,waited:int,out:array<struct<step:bigint,loss:double,stops:boolean>>>"
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.array().cast("array<struct<step:bigint,loss:double,stops:boolean>>").alias("out")).cast(state)

    def fold(s: Column, x: Column) -> Column:
        better = x["loss"] < s["best"] - min_delta
        waited = F.when(better, F.lit(0)).otherwise(s["waited"] + 1)
        row = F.struct(x["step"].alias("step"), x["loss"].alias("loss"), (~better & (waited >= patience)).alias("stops"))
        return F.struct(F.when(better, x["loss"]).otherwise(s["best"]).alias("best"), waited.alias("waited"), F.array_append(s["out"], row).alias("out")).cast(state)

    held = losses.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col("step").cast("long").alias("step"), F.col("loss").cast("double").alias("loss")))).alias("all"))
    return held.select("run", F.inline(F.aggregate("all", start, fold)["out"]))


def rate(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """Rows a second and the seconds that are left at that rate."""
    speed = done / seconds
    return speed, (total - done) / speed


def latest(table: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of every key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return table.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
