"""A crawl of several sites as rounds of pages, by one writer.

A round takes the next page of every (site, tag, phase) that is still open, all sites together, and gives them to the
ingestion as one batch; then quotas are looked at again. So sites advance side by side, what one of them brought counts for the
other, and there is nothing to lock. A site's negative phases open when none of its positive ones is open any more.

Data is committed first and the cursors after it, both under the round's number: a round that died is taken again and
changes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators import quota
from tessera.operators.prefix import dense_number
from tessera.session import cut
from tessera.streaming.ingest import Cursors, Ingest

KEYS = list(Cursors.KEYS)
POSITIVE = "positive"


def open_targets(targets: DataFrame, cursors: DataFrame | None, counts: DataFrame, total: int, most: int, sites: int, negatives: int) -> DataFrame:
    """Those of ``targets`` (tag, site, phase) that go on, with their cursor.

    ``counts`` has (tag, positives) over all sites, ``total`` is the number of images. A positive target goes on while its site
    has seen less than its share or all sites have found less than ``most``; a negative one while images without the tag are
    fewer than ``negatives``.
    """
    if cursors is None:
        state = targets.select(*KEYS, F.lit(None).cast("long").alias("cursor"), F.lit(0).cast("long").alias("seen"), F.lit(False).alias("exhausted"))
    else:
        state = targets.join(cursors, KEYS, "left").select(*KEYS, "cursor", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("exhausted", F.lit(False)).alias("exhausted"))
    known = state.join(counts, "tag", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))
    positive = F.col("phase") == POSITIVE
    wanted = F.when(positive, quota.site_continues(F.col("seen"), F.col("positives"), most, sites)).otherwise(quota.negative_shortfall(F.lit(total), F.col("positives"), negatives) > 0)
    marked = cut(known.select(*KEYS, "cursor", (wanted & ~F.col("exhausted")).alias("open")))
    busy = marked.where(positive & F.col("open")).select("site").distinct()
    negative = marked.where(~positive & F.col("open")).join(busy, "site", "left_anti")
    return marked.where(positive & F.col("open")).unionByName(negative).select(*KEYS, "cursor")


def next_pages(posts: DataFrame, wanted: DataFrame, page_size: int) -> DataFrame:
    """The next page, by falling post id, of every target in ``wanted``; a target without any has one row without a post."""
    behind = posts.join(wanted, KEYS, "right").where(F.col("cursor").isNull() | F.col("post_id").isNull() | (F.col("post_id") < F.col("cursor")))
    ranked = behind.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("post_id")))).where(F.col("_r") <= page_size).drop("_r", "cursor")
    return wanted.select(*KEYS).join(ranked, KEYS, "left")


def crawl(posts: DataFrame, work: Ingest, cursors: Cursors, most: int, negatives: int, page_size: int, sites: int | None = None) -> int:
    """Rounds until no target is open; gives how many there are by now.

    ``posts`` has (tag, site, phase, post_id, item, h, tags): what each site's listing of a phase's query holds.
    """
    targets = cut(posts.select(*KEYS).distinct())
    sites = sites or targets.select("site").distinct().count()
    number = -1 if cursors.table.version() is None else cursors.table.version()
    while True:
        number += 1
        said, images = work.tags(), work.images.read(number - 1)
        if said is None or images is None:
            counts, total = posts.sparkSession.createDataFrame([], "tag string, positives long"), 0
        else:
            counts, total = said.groupBy("tag").agg(F.count("*").alias("positives")), images.where("item = leader").count()
        wanted = cut(open_targets(targets, cursors.state(), counts, total, most, sites, negatives))
        if not wanted.limit(1).count():
            return number
        pages = cut(next_pages(posts, wanted, page_size))
        found = dense_number(pages.where(F.col("post_id").isNotNull()).withColumn("_k", -F.col("post_id")), "_k", *KEYS, into="_n")
        batch = found.select((F.lit(number) * F.lit(1 << 40) + F.col("_n")).alias("seq"), "site", "item", "h", "tags")
        work.apply(batch, number)
        cursors.advance(pages.select(*KEYS, "post_id"), number, page_size, falling=True)
