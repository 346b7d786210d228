"""Exact and Hamming-near duplicates, leaders in order of arrival, merged tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.bits import bands, hamming
from tessera.session import cut

#: Distinct hashes in a bucket whose pairs are made at once; larger buckets get a further band as key.
BUCKET = 512


def exact_first(df: DataFrame, digest: str, seq: str) -> DataFrame:
    """(digest, first, n): the first row in order of ``seq`` of each digest, and how many rows have it."""
    return df.groupBy(digest).agg(F.min(seq).alias("first"), F.count("*").alias("n"))


def unknown(new: DataFrame, known: DataFrame, digest: str) -> DataFrame:
    """Rows whose digest is not known yet."""
    return new.join(known.select(digest).distinct(), digest, "left_anti")


def hamming_pairs(hashes: DataFrame, distance: int, item: str = "item", value: str = "h") -> DataFrame:
    """(a, b, distance, band): pairs of items no further than ``distance`` apart, a < b, with the lowest band they share.

    Equal hashes are compared once and expanded afterwards. Two hashes within the distance agree in one of its
    ``distance + 1`` bands, so hashes are joined by band and key and verified by their bits. A bucket of more than
    ``BUCKET`` hashes is joined by a second key, a band of ``2 * distance + 2`` bands, of which a pair agrees in at
    least ``distance + 2``: large buckets get smaller without losing a pair.
    """
    hashes = cut(hashes.select(item, value))  # read several times below
    distinct = hashes.select(value).distinct()
    keyed = distinct.select(value, F.inline(bands(F.col(value), distance)))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("__n")).where("__n > 1")
    keyed = keyed.join(sizes, ["band", "key"])
    fine = keyed.withColumn("__fine", F.when(F.col("__n") > BUCKET, F.transform(bands(F.col(value), 2 * distance + 1), lambda b: F.struct(b["band"].alias("fb"), b["key"].alias("fk")))).otherwise(F.array(F.struct(F.lit(-1).alias("fb"), F.lit(0).cast("long").alias("fk")))))
    fine = fine.select("band", "key", value, F.inline("__fine"))
    on = ["band", "key", "fb", "fk"]
    left, right = fine.withColumnRenamed(value, "ha"), fine.withColumnRenamed(value, "hb")
    near = left.join(right, on).where((F.col("ha") < F.col("hb")) & (hamming(F.col("ha"), F.col("hb")) <= distance))
    near = near.groupBy("ha", "hb").agg(F.min("band").alias("band"))
    rows = hashes.select(F.col(item).alias("i"), F.col(value).alias("v"))
    across = near.join(rows.toDF("a", "ha"), "ha").join(rows.toDF("b", "hb"), "hb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), hamming(F.col("ha"), F.col("hb")).cast("int").alias("distance"), "band")
    same = rows.toDF("a", "v").join(rows.toDF("b", "v"), "v").where("a < b").select("a", "b", F.lit(0).alias("distance"), F.lit(0).alias("band"))
    return across.unionByName(same)


def hamming_groups(hashes: DataFrame, distance: int, item: str = "item", value: str = "h") -> tuple[DataFrame, DataFrame]:
    """The same without the pairs of equal hashes, of which there may be as many as the square of a group: (item, first), the first item of each
    item's hash, and (a, b, distance, band), the pairs between first items."""
    hashes = cut(hashes.select(item, value))
    first = cut(equal_leaders(hashes, item, value))
    members = hashes.join(first.select(value, F.col(item).alias("first")), value).select(item, "first")
    return members, hamming_pairs(first, distance, item, value)


def equal_leaders(hashes: DataFrame, item: str = "item", value: str = "h") -> DataFrame:
    """The first item of every hash; the others are its duplicates whatever else is near."""
    return hashes.groupBy(value).agg(F.min(item).alias(item))


def leaders(hashes: DataFrame, distance: int, item: str = "item", value: str = "h") -> DataFrame:
    """(item, leader): an item, in order of arrival, is its own leader unless an earlier leader is within ``distance``;
    then its leader is the one in the lowest shared band, and of those the earliest.

    Equal hashes follow their first item. Among the rest the rule is settled in rounds: an undecided item leads once all
    its earlier neighbours are known not to, and follows once one of them leads.
    """
    hashes = cut(hashes.select(item, value))
    first = cut(equal_leaders(hashes, item, value))
    links = cut(hamming_pairs(first, distance, item, value).select(F.col("a").alias("early"), F.col("b").alias("late"), "band"))
    state = cut(first.select(F.col(item).alias("node")).join(links.select(F.col("late").alias("node")).distinct().withColumn("waits", F.lit(True)), "node", "left").select("node", F.when(F.col("waits"), F.lit(0)).otherwise(F.lit(1)).alias("leads")))
    while state.where("leads = 0").limit(1).count():
        seen = links.join(state.withColumnRenamed("node", "early"), "early").groupBy(F.col("late").alias("node")).agg(F.max("leads").alias("most"), F.min("leads").alias("least"))
        settled = F.when(F.col("leads") != 0, F.col("leads")).when(F.col("most") == 1, F.lit(-1)).when(F.col("least") == -1, F.when(F.col("most") == -1, F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0))
        state = cut(state.join(seen, "node", "left").select("node", settled.alias("leads")))
    leading = state.where("leads = 1").select(F.col("node").alias("early"))
    of = links.join(leading, "early").groupBy(F.col("late").alias("node")).agg(F.min_by("early", F.struct("band", "early")).alias("leader"))
    named = state.join(of, "node", "left").select("node", F.when(F.col("leads") == 1, F.col("node")).otherwise(F.col("leader")).alias("leader"))
    heads = first.select(value, F.col(item).alias("node")).join(named, "node").select(value, "leader")
    return hashes.join(heads, value).select(item, "leader")


def merged_tags(led: DataFrame, bags: DataFrame, item: str = "item", tag: str = "tag") -> DataFrame:
    """(leader, tags): the tags of a leader and of all that follow it."""
    return bags.join(led, item).groupBy("leader").agg(F.array_sort(F.collect_set(tag)).alias("tags"))
