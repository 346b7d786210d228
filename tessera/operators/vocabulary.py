"""The vocabulary: dense row numbers in order of first sight, counts, status, delta log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.prefix import dense_number

TRAINED, WARM_START = "Trained", "WarmStartOnly"


def build(mentions: DataFrame) -> DataFrame:
    """(row_index, tag, image_count) of (pos, tag): numbered by first mention; repeated mentions count."""
    first = mentions.groupBy("tag").agg(F.min("pos").alias("pos"), F.count("*").alias("image_count"))
    return dense_number(first, "pos", "tag").select("row_index", "tag", "image_count")


def extend(vocabulary: DataFrame, mentions: DataFrame) -> DataFrame:
    """The vocabulary after new mentions: known rows keep their number, new tags are numbered after them."""
    size = vocabulary.agg((F.coalesce(F.max("row_index"), F.lit(-1)) + 1).alias("s")).first()["s"]
    counts = mentions.groupBy("tag").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    old = vocabulary.join(counts.select("tag", "n"), "tag", "left").select("row_index", "tag", (F.col("image_count") + F.coalesce("n", F.lit(0))).alias("image_count"))
    new = dense_number(counts.join(vocabulary, "tag", "left_anti"), "pos", "tag")
    return old.unionByName(new.select((F.col("row_index") + size).alias("row_index"), "tag", F.col("n").alias("image_count")))


def replay(base: DataFrame, log: DataFrame) -> DataFrame:
    """(row_index, tag, image_count, status) after a log of (line, tag, image_count, status): a known tag keeps its number and takes the last line's
    count and status; new ones are numbered in order of their first line."""
    size = base.agg((F.coalesce(F.max("row_index"), F.lit(-1)) + 1).alias("s")).first()["s"]
    last = log.groupBy("tag").agg(F.max_by(F.struct("image_count", "status"), "line").alias("x"), F.min("line").alias("line"))
    both = base.join(last, "tag", "left")
    old = both.select("row_index", "tag", F.coalesce("x.image_count", "image_count").alias("image_count"), F.coalesce("x.status", "status").alias("status"))
    new = dense_number(last.join(base, "tag", "left_anti"), "line", "tag")
    return old.unionByName(new.select((F.col("row_index") + size).alias("row_index"), "tag", "x.image_count", "x.status"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tag, image_count, status): rows of ``after`` that are new or differ from ``before``, each once, as a delta to append."""
    old = before.select("tag", F.struct("image_count", "status").alias("old"))
    now = F.struct("image_count", "status")
    return after.join(old, "tag", "left").where(F.col("old").isNull() | (F.col("old") != now)).select("tag", "image_count", "status")


class Log:
    """A vocabulary as a base and appended deltas; every ``every`` deltas are folded into a new base, and so is what is left when it is opened."""

    def __init__(self, spark, folder: str, every: int = 20) -> None:
        from tessera.operators.store import Table

        self.base, self.deltas, self.every = Table(spark, f"{folder}/base"), Table(spark, f"{folder}/deltas"), every

    def state(self) -> DataFrame:
        """The base with the deltas that came after it."""
        first = self.base.version()
        log = [self.deltas.read(v).withColumn("line", F.lit(v)) for v in self.deltas.versions() if v >= first]
        if not log:
            return self.base.read()
        whole = log[0]
        for x in log[1:]:
            whole = whole.unionByName(x)
        return replay(self.base.read(), whole)

    def start(self, vocabulary: DataFrame) -> None:
        """A base's version is the number of the first delta that is not in it."""
        self.base.commit(vocabulary, 0)

    def append(self, after: DataFrame) -> bool:
        """Appends what changed and says whether the deltas were folded."""
        delta = changed(self.state(), after)
        number = max([self.base.version() - 1, *self.deltas.versions()]) + 1
        self.deltas.commit(delta, number)
        if number + 1 - self.base.version() < self.every:
            return False
        self.fold()
        return True

    def fold(self) -> None:
        last = max(self.deltas.versions(), default=-1)
        if last >= self.base.version():
            self.base.commit(self.state(), last + 1)


def adjust(vocabulary: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts after the summed ``delta`` of each tag."""
    total = deltas.groupBy("tag").agg(F.sum("delta").alias("d"))
    return vocabulary.join(total, "tag", "left").withColumn("image_count", F.col("image_count") + F.coalesce("d", F.lit(0))).drop("d")


def promote(vocabulary: DataFrame, threshold: int) -> DataFrame:
    """Tags with enough images become trained; a trained one stays so."""
    return vocabulary.withColumn("status", F.when((F.col("status") == WARM_START) & (F.col("image_count") >= threshold), TRAINED).otherwise(F.col("status")))


def rows_of(mentions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(item, rows): an item's tags as sorted row numbers; tags that are not in the vocabulary are dropped."""
    return mentions.join(vocabulary.select("tag", "row_index"), "tag").groupBy("item").agg(F.array_sort(F.collect_set("row_index")).alias("rows"))


def read_all(rows: DataFrame, count: int) -> DataFrame:
    """(item, rows) for all items 0 .. count - 1: those without a row have an empty list."""
    spark = rows.sparkSession
    return spark.range(count).withColumnRenamed("id", "item").join(rows, "item", "left").select("item", F.coalesce("rows", F.array().cast("array<bigint>")).alias("rows"))
