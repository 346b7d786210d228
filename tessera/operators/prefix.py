"""Running sums and dense numbers over a whole table without one task that sees all rows.

Rows are dealt to ranges of keys with about as many rows each, however the keys
lie; only the ranges' totals, a row each, are summed in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut

#: Rows that a range has, and ranges at most.
CHUNK, CHUNKS = 1 << 16, 20_000


def prefix_sum(df: DataFrame, key: str, value: Column, into: str = "before", then: tuple[str, ...] = (), chunk: int = CHUNK, chunk_column: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before a row (exclusive), in order of ``key``; ties by ``then``.

    ``chunk_column`` keeps the number of a row's range under that name. Rows are written once before and once after they are dealt.
    """
    name = chunk_column or "__chunk"
    rows = cut(df.withColumn("__value", value))
    ranges = min(CHUNKS, max(1, -(-rows.count() // chunk)))
    rows = cut(rows.repartitionByRange(ranges, key, *then).withColumn(name, F.spark_partition_id().cast("long")))
    totals = rows.groupBy(name).agg(F.sum("__value").alias("__total"))
    ahead = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(name, F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(name).orderBy(key, *then).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(totals), name).withColumn(into, F.col("__ahead") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return out.drop("__value", "__ahead", *([] if chunk_column else [name]))


def dense_number(df: DataFrame, key: str, *then: str, into: str = "row_index") -> DataFrame:
    """Numbers rows from 0 on by ascending ``key``, ties by ``then``."""
    return prefix_sum(df, key, F.lit(1).cast("long"), into, then)


def record_offsets(df: DataFrame, index: str, width: Column, height: Column, header: int = 12, record_header: int = 16, channels: int = 3) -> DataFrame:
    """Where each record of a file of variable-length records begins."""
    size = F.lit(record_header).cast("long") + width.cast("long") * height.cast("long") * channels
    out = prefix_sum(df.withColumn("__size", size), index, F.col("__size"), "offset")
    return out.withColumn("offset", F.col("offset") + header).withColumnRenamed("__size", "record_bytes")


def first_n_by_hash(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows with the least MD5 of seed and key, exactly, for any ``n``.

    Only the group of hashes (by their first digits) that the n-th falls into is ranked; groups before it are taken whole.
    """
    rows = df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("__g", F.substring("__h", 1, 3))
    counts = rows.groupBy("__g").agg(F.count("*").alias("__n"))  # 4096 rows at most
    until = F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("__until", until).where(F.col("__until") - F.col("__n") < n)
    rows = rows.join(F.broadcast(counts), "__g")
    whole = rows.where(F.col("__until") <= n)
    edge = rows.where(F.col("__until") > n)
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("__h", key))
    edge = edge.withColumn("__r", rank).where(F.col("__r") <= n - (F.col("__until") - F.col("__n"))).drop("__r")
    return whole.unionByName(edge).drop("__h", "__g", "__n", "__until")
