"""What the command line offers, as functions with its defaults: each composes operators and returns tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.taxonomy import ExclusionRules, eligible
from tessera.operators import aliases as al, cooccur, quota, reconcile as rec, sampling, scoring, spatial, survey, training, vocabulary
from tessera.sources import files

MIN_IMAGES, MAX_IMAGES = 500, 1000
PAGE_SIZES, RATES = {"a": 200, "b": 100}, {"a": 4.0, "b": 2.0}
RATIO, COUNTER, SOURCES = 0.5, 15, 3


def survey_tags(listing: DataFrame, aliases: DataFrame, stored: DataFrame, min_images: int = MIN_IMAGES, max_images: int = MAX_IMAGES, rules: ExclusionRules = ExclusionRules()) -> tuple[DataFrame, DataFrame]:
    """The stored survey after reading both sites' listings as far as they are eligible, and its summary."""
    read = survey.take_while(listing, min_images)
    merged = survey.merge_sites(read, al.closure(aliases))
    return survey.prune(survey.upsert(stored, merged), aliases), survey.summary(merged, min_images, max_images, rules)


def plan_crawl(tags: DataFrame, bags: DataFrame, aliases: DataFrame, min_images: int = MIN_IMAGES, max_images: int = MAX_IMAGES, negative_target: int | None = None, rules: ExclusionRules = ExclusionRules(), ratio: float = RATIO, counter: int = COUNTER, sources: int = SOURCES) -> dict[str, DataFrame]:
    """Everything that a crawl decides ahead of its requests: targets rarest first, what it will cost, identities of raw names, tags that
    lack negatives (twice the minimum unless told otherwise), and the queries that look for them."""
    able = eligible(tags, min_images, rules)
    total = bags.select("item").distinct().count()
    counts = cooccur.tag_counts(bags).withColumnRenamed("n_items", "positives")
    lacking = counts.withColumn("missing", quota.negative_shortfall(F.lit(total), F.col("positives"), 2 * min_images if negative_target is None else negative_target)).where("missing > 0")
    return {
        "targets": survey.rank_rarest(able),
        "estimate": survey.estimate(tags, min_images, max_images, PAGE_SIZES, RATES, 0, rules),
        "identities": al.eligible_identities(able.select("name", "best_count"), aliases),
        "shortfalls": quota.shortfalls(counts, max_images),
        "negatives": cooccur.negative_query_plan(lacking, bags, ratio, counter, sources),
    }


def refresh_tags(items: DataFrame, bags: DataFrame, snapshots: DataFrame, observed: DataFrame, counts: DataFrame, only_tags: list[str] | None = None) -> dict[str, DataFrame]:
    """Tags and counts after sources were read again; ``only_tags`` keeps to the items that hold one of them."""
    if only_tags:
        held = bags.where(F.col("tag").isin(only_tags)).select("item").distinct()
        observed = observed.join(held, "item", "left_semi")
    done = rec.reconcile(items, snapshots, observed)
    return {"items": done, "counts": rec.apply_deltas(counts, rec.deltas(done)), "summary": rec.refresh_counters(done, observed)}


def prune_aliased_tags(stored: DataFrame, aliases: DataFrame, apply: bool = False) -> DataFrame:
    """The report of what would go or, if it is to be applied, what stays."""
    return survey.prune(stored, aliases) if apply else survey.prune_report(stored, aliases, al.closure(aliases))


def build_small_dataset(bags: DataFrame, tags: list[str], max_images: int | None = None, blobs: DataFrame | None = None) -> DataFrame:
    """(item, positive, tags) of a balanced sample; with ``blobs`` (image_id, blob_id, data) also each image's first blob, and only images that have one."""
    chosen = sampling.balanced(bags, tags, max_images)
    out = chosen.join(bags.groupBy("item").agg(F.array_sort(F.collect_set("tag")).alias("tags")), "item")
    return out if blobs is None else out.join(files.first_blob(blobs).withColumnRenamed("image_id", "item"), "item")


def add_tag(known: DataFrame, items: DataFrame, tag: str, folder: str, start: list[float], min_images: int = MIN_IMAGES, epochs: int = 20, rate: float = 0.05, patience: int = 5) -> tuple[DataFrame, DataFrame]:
    """The vocabulary with ``tag`` and the tag's fitted row.

    ``known`` has (row_index, tag, image_count, status), ``items`` (item, v, tags): the manifest's images with their frozen vectors. A
    new tag is numbered after all others; every image of the manifest counts for it, and with enough images it is promoted. Of 6
    images or more a fifth is held out, and training stops when they no longer improve.
    """
    number = known.where(F.col("tag") == tag).select("row_index").first()
    if number is None:
        size = known.agg((F.coalesce(F.max("row_index"), F.lit(-1)) + 1).alias("s")).first()["s"]
        fresh = known.sparkSession.createDataFrame([(size, tag, 0, vocabulary.WARM_START)], "row_index long, tag string, image_count long, status string")
        known = known.select("row_index", "tag", "image_count", "status").unionByName(fresh)
    row = size if number is None else number["row_index"]
    known = known.withColumn("image_count", F.when(F.col("tag") == tag, F.col("image_count") + items.count()).otherwise(F.col("image_count")))
    work = training.RowTraining(items.sparkSession, folder, rate, patience)
    work.start(items.sparkSession.createDataFrame([(row, start)], "row_index long, v array<double>"))
    own = F.when(F.array_contains("tags", tag), F.array(F.lit(row).cast("long"))).otherwise(F.array().cast("array<long>"))
    fitted = work.run(sampling.small_split(items, "item").select("v", own.alias("rows"), "validation"), epochs)
    return vocabulary.promote(known, min_images), fitted


def build_large_cache(blobs: DataFrame, links: DataFrame, max_images: int | None = None, min_per_tag: int = 15, min_tag_images: int = 100) -> tuple[DataFrame, DataFrame]:
    """(images with their first blob and frequent tags, vocabulary): rare tags are dropped by their count over the whole corpus, then a sample is
    taken. An image without a frequent tag has an empty list; it covers no tag, but what is left of the sample may be given to it."""
    bags = links.select(F.col("image_id").alias("item"), F.col("name").alias("tag")).distinct()
    frequent = cooccur.tag_counts(bags).where(F.col("n_items") >= min_tag_images).select("tag")
    images = files.first_blob(blobs).withColumnRenamed("image_id", "item")
    bags = images.select("item", F.col("item").alias("pos")).join(bags.join(frequent, "tag"), "item", "left")
    if max_images is not None:
        bags = bags.join(sampling.coverage(bags, max_images, min_per_tag), "item", "left_semi")
    tags = bags.groupBy("item").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return images.join(tags, "item"), vocabulary.build(bags.where("tag IS NOT NULL").select((F.col("item") * 1024).alias("pos"), "tag"))


def tag(items: DataFrame, tags: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scoring.ranked(scoring.score(items, tags, threshold))


def tag_batch(items: DataFrame, tags: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scoring.as_json(scoring.score(items, tags, threshold))


def detect(scores: DataFrame, grids: DataFrame, rows: int, cols: int, canvas: int = 160, threshold: float = 0.5, box_threshold: float = 0.5, box_percentile: float = 0.6) -> DataFrame:
    """(item, json): tags over the threshold, best first, each with the boxes of its heatmap.

    ``scores`` has (item, label, conf), ``grids`` (item, label, values, image_width, image_height) of refined heatmaps; only
    those of tags that pass are looked at.
    """
    passed = scores.where(F.col("conf") >= threshold)
    wanted = grids.join(passed.select("item", "label"), ["item", "label"], "left_semi").withColumn("key", F.xxhash64("item", "label"))
    found = spatial.components(wanted.select(F.col("key").alias("item"), "values"), rows, cols, box_threshold, box_percentile).withColumnRenamed("item", "key")
    sized = found.join(wanted.select("key", "item", "label", "image_width", "image_height"), "key")
    box = spatial.letterbox(F.col("image_width"), F.col("image_height"), canvas)
    boxes = spatial.to_image(sized, rows, cols, canvas, box, F.col("image_width"), F.col("image_height"))
    held = boxes.groupBy("item", "label").agg(F.array_sort(F.collect_list(F.struct("component", "x", "y", "width", "height", F.round("confidence", 6).alias("confidence")))).alias("boxes"))
    whole = passed.join(held, ["item", "label"], "left")
    plain = F.transform(F.coalesce("boxes", F.array().cast("array<struct<component:int,x:int,y:int,width:int,height:int,confidence:double>>")), lambda b: F.struct(b["x"], b["y"], b["width"], b["height"], b["confidence"]))
    order = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), "label", F.round("conf", 6).alias("confidence"), plain.alias("boxes"))))
    return whole.groupBy("item").agg(F.to_json(F.transform(order, lambda s: F.struct(s["label"].alias("tag"), s["confidence"], s["boxes"]))).alias("json"))
