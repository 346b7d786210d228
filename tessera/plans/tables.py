"""Queries of what is stored and of what changes it: versions, deltas, cursors, retries, guards, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import images, quota, reconcile as rec, sampling, scoring, store, training, vocabulary
from tessera.operators.store import Table
from tessera.plans import standins as st
from tessera.plans.landed import folder
from tessera.plans.registry import query
from tessera.plans.standins import BAG_SQL, LISTING_SQL, MENTION_SQL, SOURCE_SQL, VEC_SQL
from tessera.session import cut, read
from tessera.sources import state
from tessera.sources.paged import Pace, Refused, patiently
from tessera.streaming import ingest


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- versions ----------------------------------------------------------------------------------------------------------


@query(f"WITH {BAG_SQL} SELECT item, tag FROM bag WHERE item % 3 < 2")
def resumed_table(spark, d):
    """Two thirds are stored; in between a version is written whose pointer never was, as by a job that died. It counts for nothing."""
    table, bag = Table(spark, f"{folder(spark)}/bag"), st.bag(spark, d)
    table.commit(bag.where("item % 3 = 0"))
    bag.where("item % 3 = 2").write.parquet(f"{table.folder}/v1")
    assert table.version() == 0
    table.append(bag.where("item % 3 = 1"))
    table.commit(bag, 1)  # run again: committed already
    return table.read()


@query(f"WITH {BAG_SQL}, numbered AS (SELECT dense_rank() OVER (ORDER BY item) - 1 AS row_index, tag FROM bag) SELECT row_index, tag FROM numbered WHERE row_index < 200")
def trimmed_rows(spark, d):
    """Tag rows as far as pictures are confirmed."""
    from tessera.operators.prefix import dense_number

    bag = st.bag(spark, d)
    numbers = dense_number(bag.select("item").distinct(), "item")
    return store.trim(bag.join(numbers, "item"), 200).select("row_index", "tag")


@query("SELECT * FROM (VALUES ('LBX2', 224, 'goes on'), ('LBX1', 224, 'not a cache of layout LBX2'), ('LBX2', 160, 'the cache was made for inputs of 160, not 224')) t(magic, input_size, said)")
def layout_guards(spark, d):
    out = []
    for magic, size in (("LBX2", 224), ("LBX1", 224), ("LBX2", 160)):
        try:
            store.check_layout({"magic": magic, "input_size": size}, "LBX2", 224)
            said = "goes on"
        except ValueError as e:
            said = str(e)
        out.append((magic, size, said))
    return _rows(spark, out, "magic string, input_size int, said string")


_GROWN = "SELECT c_custkey AS item, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_nationkey END AS n FROM customer"


@query(_GROWN)
def grown_table(spark, d):
    """Rows of an older schema take the later columns' defaults."""
    rows = read(spark, d, "customer")
    table = Table(spark, f"{folder(spark)}/grown")
    table.commit(rows.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("kind")))
    table.append(rows.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("n")))
    return store.grow(table.read(), {"kind": ("string", "none"), "n": ("int", 0)}).select("item", "kind", "n")


@query(f"WITH {BAG_SQL}, total AS (SELECT tag, count(*) AS positives FROM bag WHERE item % 2 = 0 GROUP BY tag), credit AS (SELECT tag, count(*) AS delta FROM bag WHERE item % 2 = 1 GROUP BY tag) SELECT tag, positives + coalesce(delta, 0) AS positives FROM total LEFT JOIN credit USING (tag)")
def committed_counts(spark, d):
    return _committed(spark, d)[2]


@query(f"WITH {BAG_SQL}, own AS (SELECT DISTINCT item FROM bag) SELECT 'a' AS site, item AS post_id, md5(CAST(item AS VARCHAR)) AS md5, CASE WHEN item % 2 = 1 OR item % 10 = 0 THEN 'new' ELSE 'old' END AS seen FROM own")
def committed_sources(spark, d):
    """A source that is there keeps its image whatever the batch says; the rest of its row is taken over."""
    return _committed(spark, d)[1]


@query(f"WITH {BAG_SQL} SELECT DISTINCT md5(CAST(item AS VARCHAR)) AS md5 FROM bag")
def committed_images(spark, d):
    return _committed(spark, d)[0]


def _committed(spark, d):
    bag = st.bag(spark, d).withColumn("md5", F.md5(F.col("item").cast("string")))
    old, new = bag.where("item % 2 = 0"), bag.where("item % 2 = 1")
    source = lambda df, seen: df.select(F.lit("a").alias("site"), F.col("item").alias("post_id"), "md5", F.lit(seen).alias("seen")).distinct()
    moved = source(old.where("item % 10 = 0"), "new").withColumn("md5", F.lit("another"))
    counts = old.groupBy("tag").agg(F.count("*").alias("positives"))
    return store.commit_images(old.select("md5").distinct(), source(old, "old"), counts, new.select("md5").distinct(), source(new, "new").unionByName(moved), new.select("md5", "tag"))


@query(f"WITH {MENTION_SQL}, first AS (SELECT tag, min(pos) AS pos FROM mention GROUP BY tag), n AS (SELECT tag, count(*) AS image_count FROM mention GROUP BY tag) SELECT row_number() OVER (ORDER BY pos) - 1 AS row_index, tag, image_count, CASE WHEN image_count >= 20 THEN 'Trained' ELSE 'WarmStartOnly' END AS status FROM first JOIN n USING (tag)")
def logged_vocabulary(spark, d):
    """A vocabulary that grows in five steps; only what changed is appended, every third delta is folded, the last one on opening."""
    mentions = cut(st.mentions(spark, d).select("pos", "tag"))
    bounds = mentions.approxQuantile("pos", [0.05, 0.3, 0.5, 0.7], 0.0)
    log = vocabulary.Log(spark, f"{folder(spark)}/log", every=3)
    status = lambda v: vocabulary.promote(v.withColumn("status", F.lit(vocabulary.WARM_START)), 20)
    log.start(status(vocabulary.build(mentions.where(F.col("pos") <= bounds[0]))))
    for low, high in zip(bounds, [*bounds[1:], None], strict=True):
        now = mentions.where(F.col("pos") > low) if high is None else mentions.where((F.col("pos") > low) & (F.col("pos") <= high))
        log.append(status(vocabulary.extend(log.state().drop("status"), now)))
    log.fold()
    return log.base.read()


@query(f"WITH {MENTION_SQL}, a AS (SELECT tag, count(*) AS n FROM mention WHERE site = 'A' GROUP BY tag), b AS (SELECT tag, count(*) AS n FROM mention GROUP BY tag) SELECT b.tag, b.n AS image_count FROM b LEFT JOIN a USING (tag) WHERE a.n IS NULL OR a.n <> b.n")
def vocabulary_delta(spark, d):
    """Tags that are new or whose count changed."""
    status = lambda df: df.groupBy("tag").agg(F.count("*").alias("image_count")).withColumn("status", F.lit("Trained"))
    rows = st.mentions(spark, d)
    return vocabulary.changed(status(rows.where("site = 'A'")), status(rows)).select("tag", "image_count")


@query(f"WITH {MENTION_SQL}, v AS (SELECT tag, count(*) AS n FROM mention WHERE site = 'A' GROUP BY tag), delta AS (SELECT tag, sum(CASE WHEN site = 'N' THEN 1 ELSE -1 END) AS d FROM mention WHERE site <> 'A' GROUP BY tag) SELECT tag, CAST(n + coalesce(d, 0) AS BIGINT) AS image_count FROM v LEFT JOIN delta USING (tag)")
def adjusted_counts(spark, d):
    rows = st.mentions(spark, d)
    known = rows.where("site = 'A'").groupBy("tag").agg(F.count("*").alias("image_count"))
    deltas = rows.where("site <> 'A'").select("tag", F.when(F.col("site") == "N", 1).otherwise(-1).alias("delta"))
    return vocabulary.adjust(known, deltas)


# --- cursors -----------------------------------------------------------------------------------------------------------


@query("""WITH page AS (SELECT user_id AS tag, event_type AS site, max(event_id) FILTER (event_id % 2 = 1) AS odd, max(event_id) AS last, count(*) FILTER (event_id % 2 = 1) AS n, count(*) AS seen FROM events GROUP BY ALL)
SELECT CAST(tag AS VARCHAR) AS tag, site, 'positive' AS phase, coalesce(odd, last) AS cursor, seen, CASE WHEN n > 0 THEN n % 5 <> 0 ELSE seen % 5 <> 0 END AS exhausted FROM page""")
def crawl_cursors(spark, d):
    """Where each (tag, site, phase) is after its pages of 5: the cursor moves with the page's data, a short page ends the phase."""
    table = ingest.Cursors(spark, f"{folder(spark)}/cursors")
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("tag"), F.col("event_type").alias("site"), F.lit("positive").alias("phase"), F.col("event_id").alias("post_id"))
    for batch, part in enumerate(("event_id % 2 = 0", "event_id % 2 = 1")):
        now = read(spark, d, "events").where(part).select(F.col("user_id").cast("string").alias("tag"), F.col("event_type").alias("site"), F.lit("positive").alias("phase"), F.col("event_id").alias("post_id"))
        table.advance(now, batch, 5)
        table.advance(rows, batch, 5)  # the same batch again changes nothing
    return table.state()


@query(f"""WITH {MENTION_SQL} SELECT item, list_sort(list(DISTINCT tag)) AS tags FROM mention WHERE tag IN ('Brand#11', 'Brand#12', 'Brand#13') AND site <> 'R' GROUP BY item""")
def crawled_tags(spark, d):
    """Two sites' listings of three tags, crawled to their end: an image that both sites have is stored once."""
    from tessera.streaming.crawl import crawl

    rows = st.mentions(spark, d).where("tag IN ('Brand#11', 'Brand#12', 'Brand#13') AND site <> 'R'")
    tags = F.array_sort(F.collect_set("tag"))
    posts = rows.groupBy("item", "site").agg(tags.alias("tags")).withColumn("tag", F.explode("tags"))
    size = max(50, -(-rows.count() // 12))
    posts = posts.select("tag", F.lower("site").alias("site"), F.lit("positive").alias("phase"), F.col("item").alias("post_id"), "item", F.xxhash64("item").alias("h"), "tags")
    path = folder(spark)
    work, cursors = ingest.Ingest(spark, f"{path}/work"), ingest.Cursors(spark, f"{path}/cursors")
    crawl(posts, work, cursors, 1 << 40, 0, size)
    return work.tags().groupBy("item").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@query(f"WITH {SOURCE_SQL}, last AS (SELECT 'a' AS site, max(item) AS last FROM snapshots), known AS (SELECT count(DISTINCT item) AS n FROM snapshots WHERE item % 4 <> 0) SELECT site, last, n AS refreshed FROM last, known")
def refresh_cursor(spark, d):
    """A sweep's cursor moves over orphan sources too, which are not refreshed."""
    sources = st.snapshots(spark, d).select(F.lit("a").alias("site"), F.col("item").alias("post_id"), "item").distinct()
    items = sources.where("item % 4 <> 0").select("item")
    table, after, done = ingest.Cursors(spark, f"{folder(spark)}/refresh"), 0, None
    size = max(50, -(-sources.count() // 4))
    for batch in range(100):
        page = cut(rec.next_batch(sources, "a", after, size))
        last = page.agg(F.max("post_id").alias("last")).first()["last"]
        if last is None:
            break
        own = rec.with_item(page, items)
        done = own if done is None else done.unionByName(own)
        table.advance(page.select(F.lit("").alias("tag"), "site", F.lit("refresh").alias("phase"), "post_id"), batch, size)
        after = last
    moved = table.state().select("site", F.col("cursor").alias("last"))
    return moved.join(done.groupBy("site").agg(F.count_distinct("item").alias("refreshed")), "site")


_TRIES = [("gone", [404]), ("gone for good", [410]), ("patience", [429, 429, 0]), ("told to wait", [(429, 7.5), 0]), ("line", [-1, 0]), ("server", [500]), ("never", [429] * 8)]


@query("SELECT name, outcome, requests, CAST(w AS DOUBLE) AS waited FROM (VALUES ('gone', 'skipped', 1, 0), ('gone for good', 'skipped', 1, 0), ('patience', 'given', 3, 15), ('told to wait', 'given', 2, 7.5), ('line', 'given', 2, 5), ('server', 'failed', 1, 0), ('never', 'failed', 8, 5 + 10 + 20 + 40 + 80 + 120 + 120)) t(name, outcome, requests, w)")
def retries(spark, d):
    """What becomes of a request, how often it is made, and how long is waited."""
    out = []
    for name, answers in _TRIES:
        waits, given = [], iter(answers)
        made = 0

        def request(given=given):
            nonlocal made
            made += 1
            answer = next(given)
            status, after = answer if isinstance(answer, tuple) else (answer, None)
            if status < 0:
                raise ConnectionError
            if status:
                raise Refused(status, after)
            return "bytes"

        try:
            outcome = "skipped" if patiently(request, waits.append) is None else "given"
        except (Refused, ConnectionError):
            outcome = "failed"
        out.append((name, outcome, made, float(sum(waits))))
    return _rows(spark, out, "name string, outcome string, requests int, waited double")


@query("SELECT site, k AS request, CAST(k AS DOUBLE) / CAST(rate AS DOUBLE) AS at FROM (VALUES ('a', 4.0), ('b', 2.0)) s(site, rate), unnest(range(12)) AS r(k)")
def request_times(spark, d):
    """When requests of a paced source go out, if each is wanted at once."""
    out = []
    for site, rate in (("a", 4.0), ("b", 2.0)):
        now = [0.0]
        pace = Pace(rate, lambda now=now: now[0], lambda s, now=now: now.__setitem__(0, now[0] + s))
        for k in range(12):
            pace.wait()
            out.append((site, k, now[0]))
    return _rows(spark, out, "site string, request long, at double")


@query("SELECT * FROM (VALUES ('a', 'page 3', 3, 2400), ('b', 'page 1', 1, 0), ('c', 'page 9', 2, 1200)) t(site, page, attempts, waited)")
def site_failures(spark, d):
    """A site that fails waits and takes the same page again, without an end; what failed is logged."""
    log = f"{folder(spark)}/errors"
    out = []
    for site, page, fails in (("a", "page 3", 2), ("b", "page 1", 0), ("c", "page 9", 1)):
        waits, left = [], [fails]

        def fetch(page=page, left=left):
            if left[0]:
                left[0] -= 1
                raise Refused(500)
            return page

        got, attempts = ingest.without_end(site, fetch, lambda s, e: state.log_errors(_rows(spark, [(s, str(e))], "site string, message string"), log), waits.append)
        out.append((site, got, attempts, int(sum(waits))))
    assert state.read_log(spark, log).count() == 3
    return _rows(spark, out, "site string, page string, attempts int, waited int")


@query("SELECT * FROM (VALUES ('a', 'status 500'), ('b', 'timed out'), ('b', 'broken')) t(site, message)")
def error_log(spark, d):
    """Messages of a log that was appended to three times, without their times."""
    path = f"{folder(spark)}/errors"
    for site, message in (("a", "status 500"), ("b", "timed out"), ("b", "broken")):
        state.log_errors(_rows(spark, [(site, message)], "site string, message string"), path)
    line = state.read_log(spark, path).select(F.regexp_extract("line", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \[(.*?)\] (.*)$", 1).alias("site"), F.regexp_extract("line", r"\] (.*)$", 1).alias("message"))
    return line


@query("SELECT * FROM (VALUES ('max_images', '1000'), ('sites', '[\"a\", \"b\"]'), ('min_images', '500')) t(name, value)")
def saved_options(spark, d):
    """Options of a run as they come back: credentials are not among them."""
    import json

    path = f"{folder(spark)}/options.json"
    state.save_options(path, {"min_images": 500, "max_images": 1000, "sites": ["a", "b"], "api_key": "x", "Password": "y"})
    return _rows(spark, [(k, json.dumps(v)) for k, v in state.load_options(path).items()], "name string, value string")


@query("SELECT * FROM (VALUES (0, 'a,b,c'), (1, 'b,c'), (2, 'c'), (3, 'no site is left')) t(failed, left_)")
def sites_left(spark, d):
    out = []
    for failed in range(4):
        try:
            said = ",".join(ingest.available_sites(["a", "b", "c"], set("abc"[:failed])))
        except RuntimeError as e:
            said = str(e)
        out.append((failed, said))
    return _rows(spark, out, "failed int, left_ string")


# --- training ----------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('same size, epochs left', 'runs'), ('same size, done', 'nothing to do'), ('another size', 'the checkpoint has another vocabulary')) t(name, said)")
def resume_guards(spark, d):
    out = []
    for name, stored, done in (("same size, epochs left", 5, 1), ("same size, done", 5, 3), ("another size", 6, 1)):
        try:
            said = "runs" if training.resume_guard(stored, 5, done, 3) else "nothing to do"
        except ValueError as e:
            said = str(e)
        out.append((name, said))
    return _rows(spark, out, "name string, said string")


@query("WITH s AS (SELECT 3 AS label UNION ALL SELECT 5), i AS (SELECT vec_id AS item, label FROM embeddings WHERE label IN (3, 5) AND (label = 3 OR vec_id < 40)), n AS (SELECT label, count(*) AS n FROM i GROUP BY label), r AS (SELECT i.item, i.label, row_number() OVER (PARTITION BY i.label ORDER BY md5('split' || i.item), i.item) AS r FROM i) SELECT r.item, r.label, r <= CASE WHEN n < 6 THEN 0 ELSE greatest(1, n // 5) END AS validation FROM r JOIN n ON n.label = r.label")
def small_splits(spark, d):
    """Splits of few items: none of fewer than 6, else a fifth."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "label")
    many, few = rows.where("label = 3"), rows.where("label = 5 AND vec_id < 40")
    return sampling.small_split(many).unionByName(sampling.small_split(few))


@query("SELECT vec_id AS item, 64 AS n, true AS inside, true AS differ FROM embeddings")
def start_rows(spark, d):
    """Random rows: all values between -0.02 and 0.02, and not all the same."""
    rows = cut(read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), sampling.uniform_row(64).alias("v")))
    inside = F.forall("v", lambda x: (x >= -0.02) & (x < 0.02))
    return rows.select("item", F.size("v").alias("n"), inside.alias("inside"), (F.size(F.array_distinct("v")) > 32).alias("differ"))


@query("SELECT vec_id AS item, true AS smaller, true AS rows_kept FROM embeddings")
def cropped_inputs(spark, d):
    """A crop is never larger than the input, and its values are those of a rectangle, mirrored or not."""
    import numpy as np
    import pandas as pd

    def made(batches):
        for b in batches:
            out = []
            for item, v in zip(b["item"], b["v"], strict=True):
                whole = np.arange(1, 65, dtype=np.float64).reshape(1, 8, 8)
                crop = images.crop_flip(whole, np.random.default_rng(int(item)))
                y, x = np.nonzero(crop[0])
                box = crop[0, y.min() : y.max() + 1, x.min() : x.max() + 1]
                step = np.diff(box, axis=1)
                out.append((item, bool(4 <= box.shape[0] <= 8 and 4 <= box.shape[1] <= 8), bool((box > 0).all() and (np.diff(box, axis=0) == 8).all() and ((step == 1).all() or (step == -1).all()))))
            yield pd.DataFrame(out, columns=["item", "smaller", "rows_kept"])

    return st.vectors(spark, d).select("item", "v").mapInPandas(made, "item long, smaller boolean, rows_kept boolean")


@query(f"WITH {VEC_SQL}, fresh AS (SELECT label, k, CASE WHEN label = 3 THEN CAST(k AS DOUBLE) / 100 ELSE x END AS x FROM tagvec) SELECT label, list(round(x, 6) ORDER BY k) AS v FROM fresh WHERE label IN (1, 3, 4) GROUP BY label")
def gathered_rows(spark, d):
    """A table of rows, one of which is replaced by a trained one, and the rows that are asked for."""
    table = st.tag_vectors(spark, d)
    trained = _rows(spark, [(3, [k / 100 for k in range(1, 65)])], "label int, v array<double>").select(F.col("label").cast(dict(table.dtypes)["label"]).alias("label"), "v")
    rows = store.upsert(table.select("label", "v"), trained, ["label"])
    wanted = _rows(spark, [(1,), (3,), (4,)], "label int")
    return rows.join(wanted, "label", "left_semi").select("label", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query(f"WITH {MENTION_SQL}, v AS (SELECT tag, count(*) AS n FROM mention GROUP BY tag), listed AS (SELECT row_number() OVER (ORDER BY tag) - 1 AS row_index, tag, n FROM v), size AS (SELECT count(*) AS images FROM embeddings) SELECT row_index, tag, CASE tag WHEN 'Brand#11' THEN n + images ELSE n END AS image_count, CASE WHEN tag = 'Brand#11' AND n + images >= 300 THEN 'Trained' ELSE 'WarmStartOnly' END AS status FROM listed, size UNION ALL SELECT (SELECT count(*) FROM v), 'new', images, CASE WHEN images >= 300 THEN 'Trained' ELSE 'WarmStartOnly' END FROM size")
def added_tags(spark, d):
    """A vocabulary to which a tag that it has and one that it has not are added, each from the same manifest."""
    from pyspark.sql import Window

    from tessera.plans import commands

    known = st.mentions(spark, d).groupBy("tag").agg(F.count("*").alias("image_count"))
    known = known.select((F.row_number().over(Window.orderBy("tag")) - 1).cast("long").alias("row_index"), "tag", "image_count", F.lit("WarmStartOnly").alias("status"))
    items = cut(st.vectors(spark, d).select("item", "v", F.when(F.col("label") == 3, F.array(F.lit("new"))).otherwise(F.array(F.lit("Brand#11"))).alias("tags")))
    path = folder(spark)
    grown = known
    for tag in ("Brand#11", "new"):
        # The others' status is not looked at here: only the added tag may be promoted.
        after, fitted = commands.add_tag(grown, items, tag, f"{path}/{tag.replace('#', '-')}", [0.0] * 64, 300, epochs=2)
        assert fitted.count() == 1
        grown = cut(grown.where(F.col("tag") != tag).select("row_index", "tag", "image_count", "status").unionByName(after.where(F.col("tag") == tag).select("row_index", "tag", "image_count", "status")))
    return grown


@query(f"WITH {BAG_SQL}, m AS (SELECT item, bool_or(tag IN ('Brand#11', 'Brand#12')) AS hit FROM bag GROUP BY item), p AS (SELECT item FROM m WHERE hit ORDER BY md5('0p' || item), item LIMIT 300), n AS (SELECT item FROM m WHERE item NOT IN (SELECT item FROM p) ORDER BY md5('0n' || item), item LIMIT (SELECT count(*) FROM p)), c AS (SELECT item, 1 AS positive FROM p UNION ALL SELECT item, 0 FROM n) SELECT c.item, c.positive, (SELECT list_sort(list(tag)) FROM bag WHERE bag.item = c.item) AS tags, (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = c.item) AS data FROM c")
def small_dataset(spark, d):
    """A balanced sample with each image's first blob."""
    from tessera.plans import commands

    blobs = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("blob_id"), F.col("l_linenumber").alias("data"))
    return commands.build_small_dataset(st.bag(spark, d), ["Brand#11", "Brand#12"], 300, blobs)


@query(f"WITH {BAG_SQL}, frequent AS (SELECT tag FROM bag GROUP BY tag HAVING count(*) >= (SELECT count(*) / 25.0 FROM bag)), image AS (SELECT DISTINCT l_orderkey AS item FROM lineitem) SELECT item, coalesce((SELECT list_sort(list(tag)) FROM bag WHERE bag.item = image.item AND tag IN (SELECT tag FROM frequent)), []) AS tags FROM image")
def large_cache(spark, d):
    """All images with their frequent tags, an empty list where there is none."""
    from tessera.plans import commands

    lines = read(spark, d, "lineitem")
    blobs = lines.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("blob_id"), F.col("l_linenumber").alias("data"))
    links = st.bag(spark, d).select(F.col("item").alias("image_id"), F.col("tag").alias("name"))
    least = -(-links.count() // 25)
    return commands.build_large_cache(blobs, links, min_tag_images=least)[0].select("item", "tags")


# --- quotas ------------------------------------------------------------------------------------------------------------


@query(f"WITH {LISTING_SQL} SELECT site, raw, n, n < 70 AS goes_on FROM listing")
def fetching_goes_on(spark, d):
    return st.listing(spark, d).select("site", "raw", "n", quota.keeps_fetching(F.col("n"), 70).alias("goes_on"))


@query("SELECT run, done, round(done / CAST(4 AS DOUBLE), 6) AS speed, round((100000 - done) / (done / CAST(4 AS DOUBLE)), 6) AS left_ FROM (SELECT user_id AS run, count(*) AS done FROM events GROUP BY user_id)")
def progress(spark, d):
    """Rows a second and the seconds that are left."""
    done = read(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("done"))
    speed, left = quota.rate(F.col("done"), F.lit(100_000), F.lit(4.0))
    return done.select("run", "done", F.round(speed, 6).alias("speed"), F.round(left, 6).alias("left_"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS chunk FROM events")
def chunks(spark, d):
    """Rows in their order, 64 to a chunk."""
    from tessera.operators.prefix import dense_number

    return dense_number(read(spark, d, "events").select("event_id"), "event_id").select("event_id", F.expr("row_index div 64").alias("chunk"))


@query(f"""WITH {VEC_SQL}, held AS (SELECT item, list({{'c': conf, 'l': CAST(label AS VARCHAR)}} ORDER BY conf DESC, CAST(label AS VARCHAR)) AS s FROM scores WHERE conf >= 0.5 GROUP BY item)
SELECT item, array_to_string(list_transform(s, lambda x: x.l || '=' || printf('%.6f', round(x.c, 6))), ' ') AS said FROM held""")
def tag_batch_objects(spark, d):
    """The JSON object of each item, read back in its order."""
    made = scoring.as_json(scoring.score(st.vectors(spark, d), st.tag_vectors(spark, d), 0.5))
    pairs = F.map_entries(F.from_json("json", "map<string,double>"))
    return made.select("item", F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), F.format_string("%.6f", p["value"]))), " ").alias("said"))

