"""Resumable ingestion: a stream of sightings into versioned tables, batch by batch.

Each micro-batch is one writer: exact and near duplicates are settled against what is stored and inside the batch in order of
arrival, then tables are committed under the batch's number, images first and the cursor last. A batch that is run again
finds its versions committed and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.bits import bands
from tessera.operators.dedup import leaders
from tessera.operators.store import Parts, Table
from tessera.session import cut


class Ingest:
    """State of an ingestion under ``folder``: ``images`` (item, seq, h, leader), ``tags`` (item, tag), both in parts, and ``cursor`` (site, last, n).

    A batch costs what it brings: its hashes are held against the stored leaders by band keys, only new rows are written, and
    nothing that is stored is labelled again.
    """

    def __init__(self, spark: SparkSession, folder: str, distance: int = 2) -> None:
        self.spark, self.distance = spark, distance
        self.images, self.said, self.cursor = Parts(spark, f"{folder}/images"), Parts(spark, f"{folder}/tags"), Table(spark, f"{folder}/cursor")

    def tags(self) -> DataFrame | None:
        """(item, tag), each once: parts may repeat what an earlier one says."""
        said = self.said.read()
        return None if said is None else said.distinct()

    def _near(self, fresh: DataFrame, stored: DataFrame) -> DataFrame:
        """Stored leaders that share a band with one of ``fresh``: all that can lead one of them."""
        keys = fresh.select(F.inline(bands(F.col("h"), self.distance))).distinct()
        heads = stored.where("item = leader").select("item", "seq", "h")
        return heads.select("*", F.inline(bands(F.col("h"), self.distance))).join(keys, ["band", "key"], "left_semi").select("item", "seq", "h").distinct()

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` has (seq, site, item, h, tags); ``seq`` orders arrivals, ``item`` is a digest's number."""
        if batch_id in self.cursor.versions():
            return
        batch = cut(batch)
        stored = self.images.read(batch_id - 1)
        fresh = batch.groupBy("item").agg(F.min("seq").alias("seq"), F.min_by("h", "seq").alias("h"))
        known = None
        if stored is not None:
            known = cut(stored.join(batch.select("item").distinct(), "item", "left_semi").select("item", "leader"))
            fresh = fresh.join(known.select("item"), "item", "left_anti")
        fresh = cut(fresh)
        same = None
        if stored is not None:  # an equal hash follows the first item that had it
            had = stored.join(fresh.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min_by("leader", "seq").alias("leader"))
            same = cut(fresh.join(had, "h").select("item", "seq", "h", "leader"))
            fresh = cut(fresh.join(same.select("item"), "item", "left_anti"))
        around = fresh if stored is None else cut(fresh.unionByName(self._near(fresh, stored)))
        led = leaders(around.select(F.col("seq").alias("item"), "h"), self.distance).toDF("seq", "leader_seq")
        heads = around.select(F.col("seq").alias("leader_seq"), F.col("item").alias("leader"))
        images = fresh.join(led, "seq").join(heads, "leader_seq").select("item", "seq", "h", "leader")
        images = cut(images if same is None else images.unionByName(same))
        self.images.commit(images, batch_id)
        named = images.select("item", "leader")
        named = named if known is None else named.unionByName(known)
        said = batch.select("item", F.explode("tags").alias("tag")).join(named, "item").select(F.col("leader").alias("item"), "tag")
        self.said.commit(said.distinct(), batch_id)
        now = batch.groupBy("site").agg(F.max("seq").alias("last"), F.count("*").alias("n"))
        old = self.cursor.read()
        if old is not None:
            now = now.unionByName(old).groupBy("site").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
        self.cursor.commit(now, batch_id)

    def run(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


class Cursors:
    """Where each (tag, site, phase) of a crawl is: the last post of its last page, how many were seen, and whether a short page ended it.

    The table is committed under the batch's number, after the batch's data; a batch that is run again finds it done.
    """

    KEYS = ("tag", "site", "phase")

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.table = Table(spark, folder)

    def advance(self, posts: DataFrame, batch_id: int, page_size: int, falling: bool = False) -> None:
        """``posts`` has (tag, site, phase, post_id), all raw posts of the batch's pages; a row without a post says that there was none."""
        if batch_id in self.table.versions():
            return
        last = F.min("post_id") if falling else F.max("post_id")
        now = posts.groupBy(*self.KEYS).agg(last.alias("cursor"), F.count("post_id").alias("seen"))
        now = now.withColumn("exhausted", (F.col("seen") % page_size != 0) | (F.col("seen") == 0))
        old = self.table.read()
        if old is not None:
            both = old.toDF(*self.KEYS, "_cursor", "_seen", "_exhausted").join(now, list(self.KEYS), "full_outer")
            now = both.select(*self.KEYS, F.coalesce("cursor", "_cursor").alias("cursor"), (F.coalesce("seen", F.lit(0)) + F.coalesce("_seen", F.lit(0))).alias("seen"), F.coalesce("exhausted", "_exhausted").alias("exhausted"))
        self.table.commit(now, batch_id)

    def state(self) -> DataFrame | None:
        return self.table.read()


#: Seconds that a site rests after a failure.
REST = 20 * 60


def without_end(site: str, fetch: Callable[[], object], log: Callable[[str, Exception], None], rest: Callable[[float], None], seconds: float = REST) -> tuple[object, int]:
    """The page that ``fetch`` gives and how often it was asked for: a failure is logged, the site rests, and the same page is asked for again."""
    attempts = 0
    while True:
        attempts += 1
        try:
            return fetch(), attempts
        except Exception as e:  # noqa: BLE001  whatever a site does, the others go on
            log(site, e)
            rest(seconds)


def available_sites(sites: list[str], failed: set[str]) -> list[str]:
    """Sites that are left; none left is an error."""
    out = [s for s in sites if s not in failed]
    if sites and not out:
        raise RuntimeError("no site is left")
    return out


def refresh_walk(sources: DataFrame, site: str, size: int = 50, after: int = 0):
    """Batches of a site's sources by rising post id; each is given with the cursor to store after it."""
    from tessera.operators.reconcile import next_batch

    while rows := next_batch(sources, site, after, size).collect():  # ``size`` rows
        after = rows[-1]["post_id"]
        yield rows, after
