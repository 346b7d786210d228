"""Alias tables: closure of chains, union by priority, folding of counts, backfill of identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.taxonomy import raw_name
from tessera.session import cut


def union_by_priority(*tables: DataFrame) -> DataFrame:
    """(antecedent, consequent) of tables in falling priority; inside a table (with ``pos``) the last row wins."""
    every = None
    for k, t in enumerate(tables):
        part = t.select("antecedent", "consequent", F.lit(-k).alias("rank"), "pos")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("antecedent").agg(F.max_by("consequent", F.struct("rank", "pos")).alias("consequent"))


def closure(aliases: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(raw, canonical): where the chain from each name ends; on a cycle, the first name that it comes to again.

    Walks of all names advance together, each carrying its path. A walk ends when there is no next name or the next is on
    its path; the number of rounds is the longest chain, not the number of names.
    """
    step = aliases.select(F.col("antecedent").alias("__from"), F.col("consequent").alias("__to"))
    walk = (names.select("raw") if names is not None else aliases.select(F.col("antecedent").alias("raw"))).distinct()
    walk = walk.select("raw", F.col("raw").alias("at"), F.array().cast("array<string>").alias("path"))
    ended = None
    while True:
        moved = cut(walk.join(step, walk["at"] == step["__from"], "left").withColumn("stop", F.col("__to").isNull() | F.array_contains("path", F.col("at"))))
        part = moved.where("stop").select("raw", F.col("at").alias("canonical"))
        ended = part if ended is None else ended.unionByName(part)
        walk = moved.where(~F.col("stop")).select("raw", F.col("__to").alias("at"), F.array_append("path", F.col("at")).alias("path"))
        if walk.isEmpty():
            return ended


def fold_counts(counts: DataFrame, closed: DataFrame) -> DataFrame:
    """(site, raw, category, n, pos) with every name replaced by its canonical one: counts add up, the first-listed category stays."""
    named = counts.join(closed, "raw", "left").withColumn("raw", F.coalesce("canonical", "raw"))
    return named.groupBy("site", "raw").agg(F.min_by("category", "pos").alias("category"), F.sum("n").alias("n"), F.min("pos").alias("pos"))


def eligible_identities(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw, identity): the identity with the highest best count for each raw name (ties: the least name), and for every
    antecedent that is no raw name itself the identity of the name that it ends at."""
    best = Window.partitionBy("raw").orderBy(F.desc("best_count"), "name")
    own = tags.withColumn("raw", raw_name(F.col("name"))).withColumn("__r", F.row_number().over(best)).where("__r = 1").select("raw", F.col("name").alias("identity"))
    missing = aliases.select(F.col("antecedent").alias("raw")).distinct().join(own, "raw", "left_anti")
    filled = closure(aliases, missing).join(own.withColumnRenamed("raw", "canonical"), "canonical").select("raw", "identity")
    return own.unionByName(filled)


def stale(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Stored tags whose raw name has become an alias."""
    return tags.join(aliases.select("antecedent"), raw_name(F.col("name")) == F.col("antecedent"), "left_semi")
