"""Files that a corpus comes in: manifests, rule files, listings, the packed image cache, embedding tables."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions.taxonomy import ExclusionRules
from tessera.functions.text import alias_pairs, html_unescape, rating_letter, tag_list, url_unescape
from tessera.session import cut
from tessera.sources.paths import Store

IMAGE_PATTERN = r"\.(png|jpg|jpeg|webp|bmp)$"
#: The marks that the two layouts of the packed cache begin with.
MAGIC = {b"2XBL": 2, b"LBX2": 2, b"1XBL": 1, b"LBX1": 1}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(image_path, tags) of a JSON list of objects."""
    raw = spark.read.option("multiLine", True).json(path)
    names = {c.lower().replace("_", ""): c for c in raw.columns}
    return raw.select(F.col(names["imagepath"]).alias("image_path"), F.col(names["tags"]).cast("array<string>").alias("tags"))


def write_manifest(df: DataFrame, path: str) -> None:
    df.select("image_path", "tags").write.mode("overwrite").json(path)


def exclusion_rules(spark: SparkSession, path: str) -> ExclusionRules:
    """Rules of a text file; without the file there are none."""
    try:
        lines = [r[0] for r in spark.read.text(path).toLocalIterator()]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return ExclusionRules(frozenset(), frozenset())
    return ExclusionRules.parse(lines)


def seeded_rules(spark: SparkSession, path: str) -> ExclusionRules:
    """As ``exclusion_rules``; where there is no file, one with the default includes is written first, for its owner to edit."""
    store = Store(spark)
    if not store.exists(path):
        head = ["# A bare line excludes a tag, a line with ! includes one of the meta category; the category is written in front, as in series:name.", ""]
        store.write(path, "\n".join([*head, *ExclusionRules().lines(), ""]).encode())
    return exclusion_rules(spark, path)


def write_alias_table(df: DataFrame, path: str) -> None:
    """(antecedent, consequent) as one JSON object of names; the form is one line, so the table has to fit one task."""
    pairs = F.array_sort(F.collect_list(F.struct("antecedent", "consequent")))
    df.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def alias_table(spark: SparkSession, path: str) -> DataFrame:
    """(antecedent, consequent) of a JSON object of names."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("antecedent", "consequent"))


def first_site_tags(spark: SparkSession, path: str) -> DataFrame:
    """(name, category_code, n, pos) of landed pages, a JSON array each; a missing category is general."""
    rows = spark.read.schema("name string, category int, post_count long").option("multiLine", True).json(path)
    return rows.select("name", F.coalesce("category", F.lit(0)).alias("category_code"), F.col("post_count").alias("n"), F.monotonically_increasing_id().alias("pos"))


def second_site_tags(spark: SparkSession, path: str) -> DataFrame:
    """The same of the other site: objects with a ``tag`` array, names with character references."""
    rows = spark.read.schema("tag array<struct<name:string,type:int,count:long>>").option("multiLine", True).json(path).select(F.inline("tag"))
    return rows.select(html_unescape("name").alias("name"), F.coalesce("type", F.lit(0)).alias("category_code"), F.col("count").alias("n"), F.monotonically_increasing_id().alias("pos"))


POST = "post_id long, md5 string, file_url string, tags array<string>, rating string, created_at timestamp, width int, height int"


def usable(posts: DataFrame) -> DataFrame:
    """Posts with a digest and a file."""
    return posts.where(F.col("md5").isNotNull() & F.col("file_url").isNotNull())


def first_site_posts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("id long, md5 string, file_url string, tag_string string, rating string, created_at string, image_width int, image_height int").option("multiLine", True).json(path)
    return usable(rows.select(F.col("id").alias("post_id"), "md5", "file_url", tag_list(F.col("tag_string")).alias("tags"), rating_letter(F.col("rating")).alias("rating"), F.to_timestamp("created_at").alias("created_at"), F.col("image_width").alias("width"), F.col("image_height").alias("height")))


def second_site_posts(spark: SparkSession, path: str) -> DataFrame:
    from tessera.functions.text import asctime

    rows = spark.read.schema("post array<struct<id:long,md5:string,file_url:string,tags:string,rating:string,created_at:string,width:int,height:int>>").option("multiLine", True).json(path).select(F.inline("post"))
    return usable(rows.select(F.col("id").alias("post_id"), "md5", "file_url", tag_list(html_unescape("tags")).alias("tags"), rating_letter(F.col("rating")).alias("rating"), asctime(F.col("created_at"), F.current_timestamp()).alias("created_at"), "width", "height")).where("file_url != ''")


def page_cursors(raw: DataFrame, page_size: int, id_column: str = "id", order: str | None = None) -> DataFrame:
    """(page, n, next) of raw posts (page, id): the last id of a full page, by ``order`` or by place, counted before unusable posts are dropped; null after a short page."""
    placed = raw.withColumn("_place", F.monotonically_increasing_id() if order is None else F.col(order))
    pages = placed.groupBy("page").agg(F.count("*").alias("n"), F.max_by(id_column, "_place").alias("last"))
    return pages.select("page", "n", F.when(F.col("n") == page_size, F.col("last")).alias("next"))


def next_cursor(raw_page: DataFrame, page_size: int, id_column: str = "id") -> int | None:
    """The cursor behind one page."""
    row = page_cursors(raw_page.withColumn("page", F.lit(0)), page_size, id_column).first()
    return row["next"] if row else None


def alias_pages(spark: SparkSession, path: str) -> DataFrame:
    """(antecedent, consequent) of landed listing pages: the links' own parameters, percent- and then entity-decoded."""
    pages = spark.read.option("wholetext", True).text(path)
    rows = pages.select(F.inline(alias_pairs(F.col("value"))))
    return rows.select(*[html_unescape(url_unescape(F.col(c))).alias(c) for c in ("antecedent", "consequent")])


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the images right in a folder, by path."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(F.lower("path").rlike(IMAGE_PATTERN)).select("path", "content").orderBy("path")


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table of a database, read by ranges of a column over several connections."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=partitions, **options).load()


def parse_cache(data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(row_index, x, y, width, height, pixels) of a packed cache of either layout; the older one's full inputs are cut to their content."""
    from tessera.operators.images import strip

    version = MAGIC.get(data[:4])
    if version is None:
        raise ValueError("not a packed image cache")
    count, size = struct.unpack_from("<ii", data, 4)
    at = 12
    for k in range(count):
        x, y, w, h = struct.unpack_from("<4i", data, at)
        at += 16
        n = w * h * 3 if version == 2 else 4 * 3 * size * size
        body = data[at : at + n]
        if len(body) != n:
            raise ValueError(f"record {k} is cut short")
        at += n
        if version == 1:
            body = strip(np.frombuffer(body, "<f4").reshape(3, size, size), (x, y, w, h))
        yield k, x, y, w, h, body


def pack_cache(rows: list[tuple[int, int, int, int, bytes]], size: int) -> bytes:
    out = [b"LBX2", struct.pack("<ii", len(rows), size)]
    for x, y, w, h, pixels in rows:
        if len(pixels) != w * h * 3:
            raise ValueError("content does not fit its box")
        out += [struct.pack("<4i", x, y, w, h), pixels]
    return b"".join(out)


def image_cache(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, x, y, width, height, pixels) of packed caches, for import; afterwards they are Parquet."""
    return parsed_caches(spark.read.format("binaryFile").load(path).select("content"))


def parsed_caches(caches: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The records of caches (content), with the caches' ``keep`` columns."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row_index", "x", "y", "width", "height", "pixels"]
        for b in batches:
            for cache in b.to_dict("records"):
                records = parse_cache(cache["content"])
                while held := list(islice(records, 256)):
                    yield pd.DataFrame(held, columns=names).assign(**{c: cache[c] for c in keep})

    schema = "row_index long, x int, y int, width int, height int, pixels binary"
    kinds = dict(caches.dtypes)
    return caches.select("content", *keep).mapInPandas(parsed, ", ".join([schema, *[f"`{c}` {kinds[c]}" for c in keep]]))


def packed_caches(rows: DataFrame, size: int, file: str = "file", legacy: bool = False) -> DataFrame:
    """(file, content): the stored pictures (file, row_index, x, y, width, height, pixels) of each file as a packed cache, in order of row."""
    from tessera.operators.images import reconstruct

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        own = [(r.x, r.y, r.width, r.height, r.pixels) for r in part.sort_values("row_index").itertuples(index=False)]
        if legacy:
            body = [struct.pack("<4i", x, y, w, h) + reconstruct(p, (x, y, w, h), size).astype("<f4").tobytes() for x, y, w, h, p in own]
            content = b"".join([b"LBX1", struct.pack("<ii", len(own), size), *body])
        else:
            content = pack_cache(own, size)
        return pd.DataFrame({"file": [part["file"].iloc[0]], "content": [content]})

    kind = dict(rows.dtypes)[file]
    named = rows.select(rows[file].alias("file"), "row_index", "x", "y", "width", "height", "pixels")
    return named.groupBy("file").applyInPandas(packed, f"file {kind}, content binary")


def shrunk_caches(legacy: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(file, content): caches of the older layout (file, content) in the present one. A cache whose count differs from its labelled rows
    (file, n) is refused, and every new cache is read back and counted before it is given."""
    rows = parsed_caches(legacy, ["file"])
    counts = rows.groupBy("file").agg(F.count("*").alias("found")).join(labels, "file", "left")
    wrong = counts.where(~F.col("n").eqNullSafe(F.col("found"))).limit(1).collect()
    if wrong:
        raise ValueError(f"cache {wrong[0]['file']} has {wrong[0]['found']} pictures and {wrong[0]['n']} labelled rows")
    new = cut(packed_caches(rows, size))
    again = parsed_caches(new, ["file"]).groupBy("file").agg(F.count("*").alias("again")).join(labels, "file", "full_outer")
    if again.where(~F.col("again").eqNullSafe(F.col("n"))).limit(1).count():
        raise ValueError("a new cache has lost pictures; the old ones are left")
    return new


def embedding_table(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, v) of a binary table: dimension and rows, then floats row by row."""
    return parsed_embeddings(spark.read.format("binaryFile").load(path).select("content"))


def parsed_embeddings(tables: DataFrame) -> DataFrame:
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                dim, rows = struct.unpack_from("<ii", content)
                table = np.frombuffer(content, "<f4", dim * rows, 8).reshape(rows, dim)
                yield pd.DataFrame({"row_index": range(rows), "v": list(table)})

    return tables.select("content").mapInPandas(parsed, "row_index long, v array<float>")


def packed_embeddings(rows: DataFrame, dim: int) -> DataFrame:
    """(content): rows (row_index, v) as one binary table, in order of row; a row that has not ``dim`` values is an error."""

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        values = [np.asarray(v, "<f4") for v in part.sort_values("row_index")["v"]]
        if any(len(v) != dim for v in values):
            raise ValueError(f"a vector has not {dim} values")
        return pd.DataFrame({"content": [struct.pack("<ii", dim, len(values)) + b"".join(v.tobytes() for v in values)]})

    return rows.select("row_index", "v", F.lit(0).alias("table")).groupBy("table").applyInPandas(packed, "content binary")


def tag_row_lines(spark: SparkSession, path: str, count: int) -> DataFrame:
    """(row_index, rows): the first ``count`` lines of a text file of number lists, a line that is none is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = cut(lines.withColumn("at", F.monotonically_increasing_id()))
    block = Window.partitionBy("file", "start")
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("file", "start")) - F.col("n"))
    placed = lines.withColumn("k", F.row_number().over(block.orderBy("at"))).join(F.broadcast(sizes), ["file", "start"])  # a row a block of the file
    rows = F.from_json("value", "array<int>")
    checked = F.when(rows.isNotNull(), rows).otherwise(F.raise_error(F.lit("a line holds no list of rows")).cast("array<int>"))
    return placed.select((F.col("before") + F.col("k") - 1).alias("row_index"), checked.alias("rows")).where(F.col("row_index") < count)


def fetched(posts: DataFrame, known: DataFrame, fetch: Callable[[str], bytes | None]) -> DataFrame:
    """(post_id, md5, content) of posts whose digest is not ``known``: each file is fetched once, patiently; what is gone is left out.

    ``fetch`` takes an address and gives bytes; it raises ``Refused`` with the status, of which 404 and 410 mean gone.
    """
    from tessera.sources.paged import patiently

    def got(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 32):
                part = b.iloc[at : at + 32]
                content = [patiently(lambda u=u: fetch(u)) for u in part["file_url"]]
                kept = [c is not None for c in content]
                yield part.assign(content=content)[kept][["post_id", "md5", "content"]]

    new = posts.join(known.select("md5"), "md5", "left_anti").groupBy("md5").agg(F.min_by(F.struct("post_id", "file_url"), "post_id").alias("p"))
    return new.select("p.post_id", "md5", "p.file_url").mapInPandas(got, "post_id long, md5 string, content binary")


def first_blob(blobs: DataFrame) -> DataFrame:
    """(image_id, data): the blob with the least id of each image."""
    return blobs.groupBy("image_id").agg(F.min_by("data", "blob_id").alias("data"))


def tags_of(links: DataFrame) -> DataFrame:
    return links.groupBy("image_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))


def corpus(blobs: DataFrame, links: DataFrame) -> DataFrame:
    """Images with their first blob and all tags; those without a tag have an empty list."""
    return first_blob(blobs).join(tags_of(links), "image_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def active_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(antecedent, consequent) of landed pages of the first site; rows without both names are skipped."""
    rows = spark.read.schema("antecedent_name string, consequent_name string").option("multiLine", True).json(path)
    return rows.where("antecedent_name IS NOT NULL AND consequent_name IS NOT NULL").select(F.col("antecedent_name").alias("antecedent"), F.col("consequent_name").alias("consequent"))


def lookup(wanted: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts by (site, post_id); what is not there has nulls."""
    return wanted.join(posts, ["site", "post_id"], "left")
