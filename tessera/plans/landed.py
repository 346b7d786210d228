"""Queries of sources: what the given tables hold is written in a source's own form, read back by its reader, and held against SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions import bits, taxonomy, text
from tessera.operators import images, reconcile as rec, vocabulary
from tessera.plans import standins as st
from tessera.plans.pictures import CANVAS, CONTENT_SQL, pictures
from tessera.plans.registry import query
from tessera.plans.standins import ALIAS_SQL, BAG_SQL, LISTING_SQL, MENTION_SQL
from tessera.session import cut, ensure_checkpoint_dir, read
from tessera.sources import files
from tessera.sources.paged import PagedSource
from tessera.sources.paths import Store

CODE_SQL = "CASE category WHEN 'artist' THEN 1 WHEN 'series' THEN 3 WHEN 'character' THEN 4 WHEN 'meta' THEN 5 ELSE 0 END"


def folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"


def _pages(rows: DataFrame, value: Column, size: int, key: str = "pos") -> str:
    """Writes ``value`` of all rows, ``size`` at a time by ``key``, as JSON arrays, a file each; returns the folder."""
    path = folder(rows.sparkSession)
    page = rows.withColumn("page", F.expr(f"({key} - 1) div {size}"))
    held = page.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"]).alias("v"))
    body = held.select("page", F.to_json("v").alias("value"))
    body.repartition("page").write.partitionBy("page").text(path)
    return path


def _code(category: Column) -> Column:
    return F.when(category == "artist", 1).when(category == "series", 3).when(category == "character", 4).when(category == "meta", 5)


@query(f"WITH {LISTING_SQL} SELECT raw AS name, CAST({CODE_SQL} AS INT) AS category_code, n FROM listing WHERE site = 'a'")
def first_site_listing(spark, d):
    """A missing category is general."""
    rows = st.listing(spark, d).where("site = 'a'")
    path = _pages(rows, F.struct(F.col("raw").alias("name"), _code(F.col("category")).alias("category"), F.col("n").alias("post_count")), 7)
    return files.first_site_tags(spark, path).drop("pos")


@query(f"WITH {LISTING_SQL} SELECT raw || ' & <' || category || '> ''x''' AS name, CAST({CODE_SQL} AS INT) AS category_code, n FROM listing WHERE site = 'b'")
def second_site_listing(spark, d):
    """Names come with character references."""
    rows = st.listing(spark, d).where("site = 'b'")
    name = F.concat("raw", F.lit(" &amp; &lt;"), "category", F.lit("&gt; &#39;x&#x27;"))
    path = _second_pages(rows, name)
    return files.second_site_tags(spark, path).drop("pos")


def _second_pages(rows: DataFrame, name: Column) -> str:
    path = folder(rows.sparkSession)
    tag = F.struct(name.alias("name"), _code(F.col("category")).alias("type"), F.col("n").alias("count"))
    held = rows.groupBy(F.expr("(pos - 1) div 7").alias("page")).agg(F.collect_list(tag).alias("tag"))
    held.select("page", F.to_json(F.struct("tag")).alias("value")).repartition("page").write.partitionBy("page").text(path)
    return path


POST_SQL = """post AS (SELECT o_orderkey AS post_id, CASE WHEN o_orderkey % 7 <> 0 THEN md5(CAST(o_orderkey AS VARCHAR)) END AS md5, CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 11 <> 0 THEN 'f/' || o_orderkey END AS file_url,
  lower(o_orderstatus) AS rating, list_filter(string_split(o_orderpriority || '  ' || o_orderstatus, ' '), lambda x: x <> '') AS tags, date_trunc('second', o_orderdate) AS created_at FROM orders)"""


def _posts(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        key.alias("id"), F.when(key % 7 != 0, F.md5(key.cast("string"))).alias("md5"), F.when(key % 13 == 0, "").when(key % 11 != 0, F.concat(F.lit("f/"), key.cast("string"))).alias("file_url"),
        F.concat_ws("  ", "o_orderpriority", "o_orderstatus").alias("words"), F.concat(F.lower("o_orderstatus"), F.lit("ating")).alias("rating"), F.col("o_orderdate").cast("timestamp").alias("at"), key.alias("pos"),
    )


def _posts_of(found: DataFrame) -> DataFrame:
    return found.select("post_id", "md5", "file_url", F.array_sort("tags").alias("tags"), "rating", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"WITH {POST_SQL} SELECT post_id, md5, file_url, list_sort(tags) AS tags, rating, created_at FROM post WHERE md5 IS NOT NULL AND file_url IS NOT NULL")
def first_site_posts(spark, d):
    said = F.struct("id", "md5", "file_url", F.col("words").alias("tag_string"), "rating", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"), F.lit(8).alias("image_width"), F.lit(8).alias("image_height"))
    return _posts_of(files.first_site_posts(spark, _pages(_posts(spark, d), said, 2000)))


@query(f"WITH {POST_SQL} SELECT post_id, md5, file_url, list_sort(list_append(tags, 'a&b')) AS tags, rating, created_at FROM post WHERE md5 IS NOT NULL AND file_url <> ''")
def second_site_posts(spark, d):
    path = folder(spark)
    said = F.struct("id", "md5", "file_url", F.concat("words", F.lit(" a&amp;b")).alias("tags"), "rating", text.as_asctime(F.col("at")).alias("created_at"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    held = _posts(spark, d).groupBy(F.expr("pos div 2000").alias("page")).agg(F.collect_list(said).alias("post"))
    held.select("page", F.to_json(F.struct("post")).alias("value")).repartition("page").write.partitionBy("page").text(path)
    return _posts_of(files.second_site_posts(spark, path))


@query(f"WITH {POST_SQL}, page AS (SELECT (post_id - 1) // 2000 AS page, count(*) AS n, max(post_id) AS last FROM post GROUP BY 1) SELECT page, n, CASE WHEN n = (SELECT max(n) FROM page) THEN last ELSE -1 END AS next FROM page")
def page_cursors(spark, d):
    """The cursor behind each page of raw posts: the last id of a full page, counted before unusable posts are dropped."""
    pages = _posts(spark, d).select(F.expr("(pos - 1) div 2000").alias("page"), "id")
    size = pages.groupBy("page").count().agg(F.max("count")).first()[0]
    return files.page_cursors(pages, size).select("page", "n", F.coalesce("next", F.lit(-1)).alias("next"))


@query(f"WITH {POST_SQL}, usable AS (SELECT * FROM post WHERE md5 IS NOT NULL AND file_url IS NOT NULL) SELECT 'a' AS site, e.event_id AS post_id, u.md5, u.rating FROM events e LEFT JOIN usable u ON u.post_id = e.event_id")
def post_lookup(spark, d):
    found = _posts(spark, d).select(F.col("id").alias("post_id"), "md5", "file_url", F.substring("rating", 1, 1).alias("rating"), F.lit("a").alias("site"))
    wanted = read(spark, d, "events").select(F.lit("a").alias("site"), F.col("event_id").alias("post_id"))
    return files.lookup(wanted, files.usable(found)).select("site", "post_id", "md5", "rating")


@query(f"WITH {ALIAS_SQL} SELECT * FROM alias")
def first_site_aliases(spark, d):
    """Rows without both names are skipped."""
    own = st.aliases(spark).select(F.col("antecedent").alias("antecedent_name"), F.col("consequent").alias("consequent_name"), (F.col("pos") + 1).alias("pos"))
    odd = spark.createDataFrame([("x", None, 90), (None, "y", 91)], own.schema)
    return files.active_aliases(spark, _pages(own.unionByName(odd), F.struct("antecedent_name", "consequent_name"), 3))


@query(f"WITH {ALIAS_SQL} SELECT antecedent || ' & co' AS antecedent, consequent || '+1' AS consequent FROM alias")
def second_site_aliases(spark, d):
    """Pairs read off the rows of an HTML listing, percent- and then entity-decoded."""
    code = lambda c, more: F.concat(F.replace(F.col(c), F.lit("#"), F.lit("%23")), F.lit(more))
    cell = lambda value: F.concat(F.lit('<a class="t" href="index.php?page=post&s=list&tags='), value, F.lit('">name</a> <span>12</span>'))
    row = F.concat(F.lit("<tr><td>"), cell(code("antecedent", "%20%26amp%3B%20co")), F.lit(" <b>&rarr;</b> "), cell(code("consequent", "+1")), F.lit("</td><td>a reason</td></tr>"))
    held = st.aliases(spark).groupBy(F.expr("pos div 3").alias("page")).agg(F.concat_ws("\n", F.collect_list(row)).alias("rows"))
    body = held.select("page", F.concat(F.lit('<a href="?tags=menu">m</a><table><tr><th>Alias</th></tr>'), "rows", F.lit('</table><a href="?pid=50&tags=x">next</a>')).alias("value"))
    path = folder(spark)
    body.repartition("page").write.partitionBy("page").text(path)
    return files.alias_pages(spark, path)


@query(f"WITH {BAG_SQL} SELECT o_orderkey AS image_id, (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS first_blob, coalesce((SELECT list_sort(list(DISTINCT tag)) FROM bag WHERE item = o_orderkey AND tag <> 'Brand#11' AND o_orderkey % 3 > 0), []) AS tags FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def corpus_images(spark, d):
    """Images with their first blob, and all tags or an empty list."""
    rows = st.lines(spark, d)
    blobs = rows.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("blob_id"), F.col("l_linenumber").alias("data")).distinct()
    links = rows.where("p_brand <> 'Brand#11' AND l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("image_id"), F.col("p_brand").alias("name"))
    known = read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return files.corpus(blobs.join(known, "image_id", "left_semi"), links).withColumnRenamed("data", "first_blob")


@query(f"WITH {BAG_SQL} SELECT 'images/' || item || '.png' AS image_path, list_sort(list(tag)) AS tags FROM bag GROUP BY item")
def manifest_round_trip(spark, d):
    path = folder(spark)
    files.write_manifest(st.item_tags(spark, d).select(F.concat(F.lit("images/"), F.col("item").cast("string"), F.lit(".png")).alias("image_path"), "tags"), path)
    return spark.read.json(path).select("image_path", "tags")


@query(f"WITH {ALIAS_SQL}, second(antecedent, consequent) AS (VALUES {', '.join(f'({a!r}, {b!r})' for a, b in st.SECOND_ALIASES)}) SELECT * FROM alias UNION ALL SELECT * FROM second WHERE antecedent NOT IN (SELECT antecedent FROM alias)")
def alias_cache(spark, d):
    """Both sites' aliases merged, written as one JSON object and read again."""
    from tessera.operators.aliases import union_by_priority

    path = folder(spark)
    files.write_alias_table(union_by_priority(st.aliases(spark), st.aliases(spark, st.SECOND_ALIASES)).select("antecedent", "consequent"), path)
    return files.alias_table(spark, path)


_SEEDED = ", ".join(f"('{x}')" for x in sorted(taxonomy.DEFAULT_INCLUDES))


@query(f"WITH name(name) AS (VALUES {_SEEDED}, ('meta:other'), ('meta:pen_(medium)'), ('solo'), ('general_bad'), ('series:x')), included(i) AS (VALUES {_SEEDED}) SELECT name, CASE WHEN name IN (SELECT i FROM included) THEN false WHEN name LIKE '%\\_(medium)' ESCAPE '\\' THEN false ELSE name LIKE 'meta:%' END AS excluded FROM name")
def seeded_exclusions(spark, d):
    """Without a rule file one with the default includes is written; a second reading finds it."""
    path = f"{folder(spark)}/rules.txt"
    files.seeded_rules(spark, path)
    rules = files.seeded_rules(spark, path)
    names = [*taxonomy.DEFAULT_INCLUDES, "meta:other", "meta:pen_(medium)", "solo", "general_bad", "series:x"]
    return spark.createDataFrame([(x,) for x in names], "name string").select("name", rules.excluded(F.col("name")).alias("excluded"))


@query("WITH line(line) AS (VALUES ('  solo  '), ('# a comment'), (''), ('   '), ('! meta:scan '), ('!general_x'), ('series:#tag')), said AS (SELECT trim(line) AS t FROM line) SELECT CASE WHEN t[1] = '!' THEN trim(t[2:]) ELSE t END AS name, t[1] = '!' AS included FROM said WHERE t <> '' AND t[1] <> '#'")
def rule_lines(spark, d):
    path = f"{folder(spark)}/rules.txt"
    Store(spark).write(path, "\n".join(["  solo  ", "# a comment", "", "   ", "! meta:scan ", "!general_x", "series:#tag"]).encode())
    rules = files.exclusion_rules(spark, path)
    return spark.createDataFrame([(x, False) for x in sorted(rules.excludes)] + [(x, True) for x in sorted(rules.includes)], "name string, included boolean")


_STORED_SQL = f"WITH {CONTENT_SQL}, stored AS (SELECT item, ox AS x, oy AS y, tw AS width, th AS height, upper(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY i, j, c)) AS pixels FROM content GROUP BY ALL)"
_FILED_SQL = f"{_STORED_SQL} SELECT item % 8 AS file, row_number() OVER (PARTITION BY item % 8 ORDER BY item) - 1 AS row_index, x, y, width, height, pixels FROM stored"


def _filed(spark, d) -> DataFrame:
    return images.encode_images(pictures(spark, d), CANVAS).withColumn("file", F.col("item") % 8).withColumnRenamed("item", "row_index")


@query(_FILED_SQL)
def cache_records(spark, d):
    """Packed caches and the records that are read from them."""
    return files.parsed_caches(files.packed_caches(_filed(spark, d), CANVAS), ["file"]).withColumn("pixels", F.hex("pixels"))


@query(_FILED_SQL)
def shrunk_cache_records(spark, d):
    """Caches of the older layout, brought into the present one and verified by count."""
    rows = cut(_filed(spark, d))
    old = files.packed_caches(rows, CANVAS, legacy=True)
    new = files.shrunk_caches(old, rows.groupBy("file").agg(F.count("*").alias("n")), CANVAS)
    return files.parsed_caches(new, ["file"]).withColumn("pixels", F.hex("pixels"))


@query(f"{_STORED_SQL} SELECT item % 8 AS file, length(pixels) // 2 + 28 AS bytes FROM stored QUALIFY row_number() OVER (PARTITION BY item % 8 ORDER BY item) = 1")
def first_records(spark, d):
    """Where the second record of each cache begins: behind the header, a box and the first content."""
    one = files.parsed_caches(files.packed_caches(_filed(spark, d), CANVAS), ["file"]).where("row_index = 0")
    return one.select("file", (F.length("pixels") + 28).cast("long").alias("bytes"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_index, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100000) AS INT)) AS v FROM embeddings")
def embedding_rows(spark, d):
    """A binary table of embeddings and the rows that are read from it."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_index"), F.col("embedding").alias("v"))
    got = files.parsed_embeddings(files.packed_embeddings(rows, 64))
    return got.select("row_index", F.transform("v", lambda x: F.round(x.cast("double") * 100_000).cast("int")).alias("v"))


@query(f"WITH {MENTION_SQL}, seen AS (SELECT item, list_sort(list(DISTINCT CAST(substr(tag, 7) AS INT) - 33)) AS rows FROM mention GROUP BY item) SELECT item, rows, 4 * len(rows) AS bytes FROM seen")
def packed_tag_rows(spark, d):
    """Row numbers, negative ones too, as little-endian blobs and back."""
    rows = st.bag(spark, d).groupBy("item").agg(F.array_sort(F.collect_set(F.substring("tag", 7, 9).cast("int") - 33)).alias("rows"))
    blobs = rows.select("item", bits.pack_int32(F.col("rows")).alias("blob"))
    return blobs.select("item", bits.unpack_int32(F.col("blob")).alias("rows"), F.length("blob").cast("long").alias("bytes"))


@query(f"WITH {BAG_SQL}, stored AS (SELECT item, list_sort(list(CAST(substr(tag, 7) AS BIGINT))) AS rows FROM bag WHERE item < 500 GROUP BY item) SELECT i AS item, coalesce(rows, []) AS rows FROM unnest(range(500)) AS r(i) LEFT JOIN stored ON item = i")
def all_tag_rows(spark, d):
    """Tag rows of the first 500 pictures: a picture without a stored row has an empty list."""
    stored = st.bag(spark, d).groupBy("item").agg(F.array_sort(F.collect_set(F.substring("tag", 7, 9).cast("long"))).alias("rows"))
    return vocabulary.read_all(stored, 500)


@query(f"WITH {BAG_SQL}, listed AS (SELECT row_number() OVER (ORDER BY item) - 1 AS row_index, list_sort(list(CAST(substr(tag, 7) AS INT))) AS rows FROM bag GROUP BY item) SELECT row_index, rows FROM listed WHERE row_index < 300")
def tag_row_lines(spark, d):
    """Lines of number lists, imported by their number as far as there are confirmed pictures."""
    held = st.bag(spark, d).groupBy("item").agg(F.array_sort(F.collect_set(F.substring("tag", 7, 9).cast("int"))).alias("rows"))
    path = folder(spark)
    held.orderBy("item").select(F.to_json("rows").alias("value")).coalesce(1).write.text(path)
    return files.tag_row_lines(spark, path, 300)


@query("SELECT * FROM (VALUES ('a.jpg', 1), ('b.PNG', 1), ('c.webp', 1), ('d d.bmp', 1), ('Z.jpeg', 1)) t(name, bytes)")
def image_listing(spark, d):
    """Images of a folder in order of their paths; other files and folders below stay out."""
    path = folder(spark)
    for name in ("b.PNG", "a.jpg", "c.webp", "d d.bmp", "Z.jpeg", "e.txt", "f.jpg.bak", "sub/g.jpg"):
        Store(spark).write(f"{path}/{name}", b"x")
    found = files.image_files(spark, path)
    return found.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"), F.length("content").alias("bytes"))


@query(f"WITH {POST_SQL}, new AS (SELECT * FROM post WHERE md5 IS NOT NULL AND file_url IS NOT NULL AND file_url <> '' AND post_id % 5 <> 0 AND post_id % 17 <> 0) SELECT post_id, md5, 'bytes of ' || file_url AS content FROM new")
def fetched_files(spark, d):
    """Files of posts whose digest is not known; what is gone is left out, a refusal is tried again."""
    from tessera.sources.paged import Refused

    seen: set[str] = set()

    def fetch(url: str) -> bytes:
        number = int(url.split("/")[1])
        if number % 17 == 0:
            raise Refused(404)
        if number % 1000 == 1 and url not in seen:
            seen.add(url)
            raise Refused(429, 0.0)
        return f"bytes of {url}".encode()

    posts = _posts(spark, d).select(F.col("id").alias("post_id"), "md5", "file_url").where("md5 IS NOT NULL AND file_url <> ''")
    known = posts.where("post_id % 5 = 0").select("md5")
    return files.fetched(posts, known, fetch).withColumn("content", F.col("content").cast("string"))


@query("SELECT event_id AS id, event_type AS name FROM events")
def paged_events(spark, d):
    """Pages through the paged source, up to the first empty one."""
    path = f"{folder(spark)}/pages"
    store, rows = Store(spark), read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    pages = rows.groupBy(F.expr("id div 1000").alias("page")).agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value")).orderBy("page")
    last = -1
    for last, r in enumerate(pages.toLocalIterator()):
        store.write(f"{path}/{last}.json", r["value"].encode())
    store.write(f"{path}/{last + 1}.json", b"[]")
    store.write(f"{path}/{last + 2}.json", b'[{"id": -5, "name": "behind the end"}]')
    spark.dataSource.register(PagedSource)
    return spark.read.format("tessera_pages").option("path", path).schema("id long, name string").load()


@query(f"WITH {LISTING_SQL} SELECT raw AS name, n AS count_a, n >= 60 AS eligible FROM listing WHERE site = 'a'")
def surveyed_tags(spark, d):
    """All stored tags, eligible or not, with the flag that was stored."""
    from tessera.operators.store import Table

    table = Table(spark, f"{folder(spark)}/tags")
    table.commit(st.listing(spark, d).where("site = 'a'").select(F.col("raw").alias("name"), F.col("n").alias("count_a"), (F.col("n") >= 60).alias("eligible")))
    return table.read()


@query(f"WITH {BAG_SQL}, keyed AS (SELECT DISTINCT item FROM bag) SELECT item AS post_id FROM keyed WHERE item > 40 ORDER BY item LIMIT 70")
def capped_pages(spark, d):
    """Pages of 50 sources behind a cursor, until 70 are taken: the last page is as large as what is left."""
    sources = st.bag(spark, d).select(F.col("item").alias("post_id"), F.lit("a").alias("site")).distinct()
    taken, after, out = 0, 40, None
    while taken < 70:
        page = cut(rec.next_batch(sources, "a", after, min(50, 70 - taken)))
        size = page.agg(F.count("*").alias("n"), F.max("post_id").alias("last")).first()
        if not size["n"]:
            break
        taken, after = taken + size["n"], size["last"]
        out = page if out is None else out.unionByName(page)
    return out.select("post_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || printf('.%06d0', CAST(date_part('microsecond', ts) % 1000000 AS INT)) || 'Z' AS iso, ts FROM events")
def iso_timestamps(spark, d):
    said = text.iso(F.col("ts").cast("timestamp"))
    rows = read(spark, d, "events").select("event_id", said.alias("iso"))
    return rows.withColumn("ts", F.to_timestamp("iso").cast("timestamp_ntz"))


@query(f"WITH {st.SOURCE_SQL} SELECT item, source, coalesce(array_to_string(tags, ','), '-') AS tags, tags IS NULL AS never FROM snapshots")
def stored_snapshots(spark, d):
    """Tag lists as stored JSON and back; null stays null."""
    said = st.snapshots(spark, d).select("item", "source", F.to_json("tags").alias("stored"))
    tags = text.tags_from_json(F.col("stored"))
    return said.select("item", "source", F.coalesce(F.array_join(tags, ","), F.lit("-")).alias("tags"), tags.isNull().alias("never"))

