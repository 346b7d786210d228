"""Versioned tables on plain Parquet: append, upsert, commit, schema growth, consistency checks.

A table is a folder of version folders. Writing makes a new version; a commit writes the pointer file after the data, so a
reader sees a whole version or the one before, and a job that dies half way leaves nothing behind that counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Table:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        if not self.fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path())]
        return sorted(int(n.removeprefix("commit-")) for n in names if n.startswith("commit-"))

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int | None = None) -> DataFrame | None:
        version = self.version() if version is None else version
        return None if version is None else self.spark.read.parquet(f"{self.folder}/v{version}")

    def commit(self, df: DataFrame, version: int | None = None) -> int:
        """Writes a version whole, then its pointer. A version that is committed already is left as it is, so a batch that is run again changes nothing."""
        if version is None:
            version = -1 if self.version() is None else self.version()
            version += 1
        if version in self.versions():
            return version
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        self.fs.create(self._path(f"commit-{version}"), True).close()
        return version

    def upsert(self, new: DataFrame, keys: list[str], keep: list[str] = (), version: int | None = None) -> int:
        old = self.read()
        return self.commit(new if old is None else upsert(old, new, keys, keep), version)

    def append(self, new: DataFrame, version: int | None = None) -> int:
        old = self.read()
        return self.commit(new if old is None else old.unionByName(new, allowMissingColumns=True), version)

    def compact(self, keep: int = 1) -> None:
        """Deletes all but the last ``keep`` versions."""
        for v in self.versions()[:-keep]:
            self.fs.delete(self._path(f"commit-{v}"), False)
            self.fs.delete(self._path(f"v{v}"), True)


class Parts(Table):
    """A table whose versions are parts: a commit writes new rows only, and reading is all committed parts together."""

    def read(self, version: int | None = None) -> DataFrame | None:
        parts = self.versions() if version is None else [v for v in self.versions() if v <= version]
        return self.spark.read.parquet(*[f"{self.folder}/v{v}" for v in parts]) if parts else None

    def compact(self, keep: int = 1) -> None:
        """Brings all parts together in the last one, in one commit by renaming; a reader in between sees some rows twice, never none."""
        parts = self.versions()
        if len(parts) > keep:
            last = parts[-1]
            self.read().write.mode("overwrite").parquet(f"{self.folder}/compacting")
            self.fs.delete(self._path(f"v{last}"), True)
            self.fs.rename(self._path("compacting"), self._path(f"v{last}"))
            for v in parts[:-1]:
                self.fs.delete(self._path(f"commit-{v}"), False)
                self.fs.delete(self._path(f"v{v}"), True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of ``old`` with those of ``new`` put in by key; columns in ``keep`` are not changed for a key that is there."""
    rest = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") if c in new.columns else F.lit(None).cast(dict(old.dtypes)[c]).alias(f"__{c}") for c in rest], F.lit(True).alias("__new"))
    both = old.withColumn("__old", F.lit(True)).join(fresh, keys, "full_outer")

    def pick(c: str) -> Column:
        use_new = F.col("__new") & F.col("__old").isNull() if c in keep else F.col("__new")
        return F.when(use_new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*keys, *[pick(c) for c in rest]).select(*old.columns)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def grow(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """``df`` with columns of a later schema: (type, default); nulls in them take the default too."""
    for name, (kind, value) in defaults.items():
        lit = F.lit(value).cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name), lit) if name in df.columns else lit)
    return df


def trim(rows: DataFrame, count: int, index: str = "row_index") -> DataFrame:
    """Rows that belong to the first ``count`` confirmed pictures; what a broken run appended beyond them goes."""
    return rows.where(F.col(index) < count)


def check_layout(found: dict, magic: str, size: int) -> None:
    """Refuses to go on with a cache of another layout or input size."""
    if found.get("magic") != magic:
        raise ValueError(f"not a cache of layout {magic}")
    if found.get("input_size") != size:
        raise ValueError(f"the cache was made for inputs of {found.get('input_size')}, not {size}")


def cache_violations(rows: DataFrame, count: int) -> DataFrame:
    """(row_index, n, problem): indices outside [0, count) and indices that more than one digest has."""
    used = rows.groupBy("row_index").agg(F.count("*").alias("n"))
    problem = F.when((F.col("row_index") < 0) | (F.col("row_index") >= count), "out of bounds").when(F.col("n") > 1, "duplicate")
    return used.withColumn("problem", problem).where(F.col("problem").isNotNull())


def checked_pixels(rows: DataFrame) -> DataFrame:
    """Records whose content has the length that their box says; any other is an error."""
    ok = F.length("pixels") == F.col("width") * F.col("height") * 3
    return rows.withColumn("pixels", F.when(ok, F.col("pixels")).otherwise(F.raise_error(F.lit("content does not fit its box")).cast("binary")))


def checked_vectors(rows: DataFrame, dim: int) -> DataFrame:
    return rows.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} values")).cast("array<float>")))


def commit_images(images: DataFrame, sources: DataFrame, counts: DataFrame, new_images: DataFrame, new_sources: DataFrame, new_tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables after a batch: new images are added (a digest that is there is an error), sources are put in by (site, post_id) without moving
    them to another image, and every new (image, tag) counts once for its tag if the tag is in the table."""
    clash = new_images.join(images.select("md5"), "md5", "left_semi").limit(1).count() or new_images.groupBy("md5").count().where("count > 1").limit(1).count()
    if clash:
        raise ValueError("an image is there already")
    credit = new_tags.select("md5", "tag").distinct().groupBy("tag").agg(F.count("*").alias("delta"))
    counted = counts.join(credit, "tag", "left").select("tag", (F.col("positives") + F.coalesce("delta", F.lit(0))).alias("positives"))
    return images.unionByName(new_images), upsert(sources, new_sources, ["site", "post_id"], keep=["md5"]), counted
