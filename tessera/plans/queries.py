"""Registered queries of the tagging domain, and for each the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import bits, taxonomy, text
from tessera.operators import aliases as al, cooccur, dedup, images, losses, prefix, quota, reconcile as rec, sampling, scoring, spatial, store, survey, training, vocabulary
from tessera.plans import standins as st
from tessera.plans.registry import ORACLE_SQL, QUERIES, query
from tessera.plans.standins import ALIAS_SQL, BAG_SQL, CLOSURE_SQL, HASH_SQL, IDENTITY_SQL, LISTING_SQL, MENTION_SQL, SOURCE_SQL, VEC_SQL
from tessera.session import cut, read

RULES = taxonomy.ExclusionRules(frozenset({"Brand#22"}), frozenset({"meta:Brand#33"}))
EXCLUDED_SQL = "CASE WHEN name IN ('meta:Brand#33') THEN false WHEN name IN ('Brand#22') THEN true WHEN name LIKE '%\\_(medium)' ESCAPE '\\' THEN false ELSE name LIKE 'meta:%' END"


# --- scoring -----------------------------------------------------------------------------------------------------------


@query(f"WITH {VEC_SQL} SELECT item, label, round(conf, 6) AS conf FROM scores WHERE conf >= 0.5")
def tag_scores(spark, d):
    return scoring.score(st.vectors(spark, d), st.tag_vectors(spark, d), 0.5).withColumn("conf", F.round("conf", 6))


@query(f"WITH {VEC_SQL} SELECT item, label, round(conf, 6) AS conf, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY conf DESC, label) AS r FROM scores) WHERE r <= 3")
def topk_tags_per_item(spark, d):
    out = scoring.ranked(scoring.score(st.vectors(spark, d), st.tag_vectors(spark, d), None), 3)
    return out.withColumn("conf", F.round("conf", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {VEC_SQL} SELECT item, '{{' || string_agg('\"' || label || '\":' || CAST(round(conf, 6) AS VARCHAR), ',' ORDER BY conf DESC, CAST(label AS VARCHAR)) || '}}' AS json FROM scores WHERE conf >= 0.5 GROUP BY item")
def tag_batch_json(spark, d):
    return scoring.as_json(scoring.score(st.vectors(spark, d), st.tag_vectors(spark, d), 0.5))


@query(f"WITH {VEC_SQL} SELECT item, printf('%.3f', conf) || chr(9) || label AS line FROM scores WHERE conf >= 0.5")
def tag_lines(spark, d):
    return scoring.as_lines(scoring.score(st.vectors(spark, d), st.tag_vectors(spark, d), 0.5))


# --- surveys -----------------------------------------------------------------------------------------------------------

_KEPT = "kept AS (SELECT l.* FROM listing l LEFT JOIN (SELECT site, min(pos) AS stop FROM listing WHERE n < {m} GROUP BY site) s USING (site) WHERE s.stop IS NULL OR l.pos < s.stop)"
_MERGED = f"""folded AS (SELECT site, coalesce(canonical, l.raw) AS raw, arg_min(category, pos) AS category, CAST(sum(n) AS BIGINT) AS n FROM listing l LEFT JOIN closed c ON c.raw = l.raw GROUP BY 1, 2),
sa AS (SELECT * FROM folded WHERE site = 'a'), sb AS (SELECT * FROM folded WHERE site = 'b'),
merged AS (SELECT {IDENTITY_SQL.format(c='coalesce(sa.category, sb.category)', r='coalesce(sa.raw, sb.raw)')} AS name, coalesce(sa.raw, sb.raw) AS raw, sa.n AS count_a, sb.n AS count_b, greatest(coalesce(sa.n, 0), coalesce(sb.n, 0)) AS best_count FROM sa FULL OUTER JOIN sb ON sa.raw = sb.raw)"""
_SURVEY = f"WITH RECURSIVE {ALIAS_SQL}, {CLOSURE_SQL}, {LISTING_SQL}, {_MERGED}"


def _merged(spark, d):
    return survey.merge_sites(st.listing(spark, d), al.closure(st.aliases(spark)))


@query(f"WITH {LISTING_SQL}, {_KEPT.format(m=80)} SELECT site, raw, n FROM kept")
def survey_takewhile(spark, d):
    return survey.take_while(st.listing(spark, d), 80).select("site", "raw", "n")


@query(f"{_SURVEY} SELECT name, count_a, count_b, best_count FROM merged")
def survey_merge(spark, d):
    return _merged(spark, d).drop("raw")


@query(f"WITH RECURSIVE {ALIAS_SQL}, {CLOSURE_SQL} SELECT raw, canonical FROM closed")
def alias_closure(spark, d):
    return al.closure(st.aliases(spark))


@query(f"WITH {ALIAS_SQL}, second(antecedent, consequent) AS (VALUES {', '.join(f'({a!r}, {b!r})' for a, b in st.SECOND_ALIASES)}) SELECT * FROM alias UNION ALL SELECT * FROM second WHERE antecedent NOT IN (SELECT antecedent FROM alias)")
def alias_priority_union(spark, d):
    return al.union_by_priority(st.aliases(spark), st.aliases(spark, st.SECOND_ALIASES))


@query(f"WITH RECURSIVE {ALIAS_SQL}, {CLOSURE_SQL}, {LISTING_SQL} SELECT site, coalesce(canonical, l.raw) AS raw, arg_min(category, pos) AS category, CAST(sum(n) AS BIGINT) AS n FROM listing l LEFT JOIN closed c ON c.raw = l.raw GROUP BY 1, 2")
def alias_fold_counts(spark, d):
    return al.fold_counts(st.listing(spark, d), al.closure(st.aliases(spark))).drop("pos")


@query(f"{_SURVEY}, own AS (SELECT regexp_replace(name, '^(artist|series|character|meta):', '') AS raw, name FROM merged QUALIFY row_number() OVER (PARTITION BY regexp_replace(name, '^(artist|series|character|meta):', '') ORDER BY best_count DESC, name) = 1) SELECT raw, name AS identity FROM own UNION ALL SELECT c.raw, o.name FROM closed c JOIN own o ON o.raw = c.canonical WHERE c.raw NOT IN (SELECT raw FROM own)")
def eligible_identities(spark, d):
    return al.eligible_identities(_merged(spark, d).drop("raw"), st.aliases(spark))


@query(f"{_SURVEY} SELECT name, best_count FROM merged WHERE best_count >= 50 AND NOT ({EXCLUDED_SQL})")
def eligible_tags(spark, d):
    return taxonomy.eligible(_merged(spark, d), 50, RULES).select("name", "best_count")


@query(f"{_SURVEY} SELECT name, {EXCLUDED_SQL} AS excluded FROM merged")
def excluded_tags(spark, d):
    return _merged(spark, d).select("name", RULES.excluded(F.col("name")).alias("excluded"))


@query(f"{_SURVEY} SELECT CAST(sum(least(100, best_count)) AS BIGINT) AS image_slots FROM merged")
def image_slot_estimate(spark, d):
    return survey.image_slots(_merged(spark, d), 100)


_SUMMARY = f"{_SURVEY}, m AS (SELECT *, {EXCLUDED_SQL} AS ex FROM merged), s AS (SELECT count(*) AS total_tags, count(*) FILTER (best_count >= 50 AND NOT ex) AS eligible_tags, count(*) FILTER (ex) AS excluded_tags, CAST(coalesce(sum(least(100, best_count)) FILTER (best_count >= 50 AND NOT ex), 0) AS BIGINT) AS image_slots FROM m)"


@query(f"{_SUMMARY} SELECT * FROM s")
def survey_summary(spark, d):
    return survey.summary(_merged(spark, d), 50, 100, RULES)


@query(f"{_SUMMARY} SELECT eligible_tags, image_slots, CAST(7 + ceil(image_slots / 150.0) AS BIGINT) AS requests, (7 + ceil(image_slots / 150.0)) / 6.0 AS seconds FROM s")
def crawl_estimate(spark, d):
    return survey.estimate(_merged(spark, d), 50, 100, {"a": 200, "b": 100}, {"a": 4.0, "b": 2.0}, 7, RULES)


@query(f"{_SURVEY} SELECT name, best_count, row_number() OVER (ORDER BY best_count, name) AS rank FROM merged")
def rarest_first(spark, d):
    return survey.rank_rarest(_merged(spark, d)).select("name", "best_count", F.col("rank").cast("long").alias("rank"))


_STORED = f"{_SURVEY}, stored AS (SELECT raw AS name, n AS count_a, n AS count_b, n AS positives FROM listing WHERE site = 'a' UNION ALL SELECT 'gone', 1, 2, 3)"


def _stored(spark, d):
    rows = st.listing(spark, d).where("site = 'a'").select(F.col("raw").alias("name"), F.col("n").alias("count_a"), F.col("n").alias("count_b"), F.col("n").alias("positives"))
    return rows.unionByName(spark.createDataFrame([("gone", 1, 2, 3)], "name string, count_a long, count_b long, positives long"))


@query(f"{_STORED} SELECT coalesce(s.name, m.name) AS name, CASE WHEN m.name IS NOT NULL THEN m.count_a ELSE s.count_a END AS count_a, CASE WHEN m.name IS NOT NULL THEN m.count_b ELSE s.count_b END AS count_b, coalesce(positives, 0) AS positives FROM stored s FULL OUTER JOIN merged m ON s.name = m.name")
def upsert_survey(spark, d):
    return survey.upsert(_stored(spark, d), _merged(spark, d))


@query(f"{_STORED} SELECT name, canonical AS target, count_a, count_b FROM stored JOIN closed ON raw = regexp_replace(name, '^(artist|series|character|meta):', '')")
def stale_alias_report(spark, d):
    return survey.prune_report(_stored(spark, d), st.aliases(spark), al.closure(st.aliases(spark)))


@query(f"{_STORED} SELECT name, count_a, count_b, positives FROM stored WHERE name NOT IN (SELECT antecedent FROM alias)")
def prune_aliased(spark, d):
    return survey.prune(_stored(spark, d), st.aliases(spark))


@query(f"{_SURVEY}, el AS (SELECT raw, name FROM merged WHERE best_count >= 50 AND NOT ({EXCLUDED_SQL})), ids AS (SELECT raw, name FROM el UNION ALL SELECT c.raw, e.name FROM closed c JOIN el e ON e.raw = c.canonical WHERE c.raw NOT IN (SELECT raw FROM el)), {BAG_SQL} SELECT DISTINCT item, name AS identity FROM bag JOIN ids ON bag.tag = ids.raw")
def post_tag_identities(spark, d):
    ids = al.eligible_identities(taxonomy.eligible(_merged(spark, d), 50, RULES).drop("raw"), st.aliases(spark))
    posts = st.bag(spark, d).groupBy("item").agg(F.array_join(F.collect_set("tag"), " ").alias("tag_string"))
    names = posts.select("item", F.explode(text.tag_list(F.col("tag_string"))).alias("raw"))
    return names.join(F.broadcast(ids) if ids.count() <= 100_000 else ids, "raw").select("item", "identity").distinct()


@query(f"WITH keys(name, site) AS (SELECT DISTINCT p_brand, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey), done AS (SELECT name, site, CAST(1000 AS BIGINT) AS satisfied FROM keys WHERE site = 'A') SELECT k.name, k.site, coalesce(d.satisfied, 0) AS fetched, coalesce(d.satisfied < 1200, true) AS recheck FROM keys k LEFT JOIN done d USING (name, site)")
def resume_progress(spark, d):
    keys = st.lines(spark, d).select(F.col("p_brand").alias("name"), F.col("l_returnflag").alias("site")).distinct()
    done = keys.where("site = 'A'").withColumn("satisfied", F.lit(1000).cast("long"))
    out = survey.progress(keys, done, ["name", "site"], {"satisfied": None})
    return out.select("name", "site", F.coalesce("satisfied", F.lit(0)).alias("fetched"), quota.needs_recheck(F.col("satisfied"), 1200).alias("recheck"))


# --- co-occurrence -----------------------------------------------------------------------------------------------------

_PAIRS = f"WITH {BAG_SQL}, pairs AS (SELECT a.tag, b.tag AS other, count(*) AS n_both FROM bag a JOIN bag b USING (item) WHERE a.tag <> b.tag GROUP BY 1, 2), counts AS (SELECT tag, count(*) AS n FROM bag GROUP BY tag)"
_HARD = f"{_PAIRS}, hard AS (SELECT p.tag, p.other, n_both, o.n AS n_other, o.n - n_both AS counter, n_both / t.n AS ratio, row_number() OVER (PARTITION BY p.tag ORDER BY n_both / t.n DESC, o.n - n_both DESC, p.other) AS rank FROM pairs p JOIN counts t ON t.tag = p.tag JOIN counts o ON o.tag = p.other WHERE n_both / t.n >= 0.13 AND o.n - n_both >= 15)"


@query(f"{_PAIRS} SELECT tag, other, n_both FROM pairs")
def tag_pair_counts(spark, d):
    return cooccur.pair_counts(st.bag(spark, d))


@query(f"{_HARD} SELECT tag, other, n_both, n_other, counter, round(ratio, 9) AS ratio, rank FROM hard")
def hard_negative_sources(spark, d):
    out = cooccur.hard_negative_sources(st.bag(spark, d), 0.13, 15)
    return out.withColumn("ratio", F.round("ratio", 9)).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_HARD}, top AS (SELECT * FROM hard WHERE rank <= 3) SELECT tag, rank AS step, other || ' -' || tag AS query, 'negative:cooccur:' || other AS phase, other AS label FROM top UNION ALL SELECT tag, 1 + (SELECT count(*) FROM top WHERE top.tag = counts.tag), '-' || tag, 'negative', 'background' FROM counts")
def negative_query_plan(spark, d):
    bags = st.bag(spark, d)
    return cooccur.negative_query_plan(bags.select("tag"), bags, 0.13, 15, 3).withColumn("step", F.col("step").cast("long"))


@query(f"WITH {BAG_SQL}, t AS (SELECT count(DISTINCT item) AS total FROM bag) SELECT tag, count(*) AS positives, greatest(CAST(0 AS BIGINT), 14000 - (total - count(*))) AS missing FROM bag, t GROUP BY tag, total")
def negative_shortfall(spark, d):
    bags = st.bag(spark, d)
    total = bags.select("item").distinct().count()
    counts = cooccur.tag_counts(bags)
    return counts.select("tag", F.col("n_items").alias("positives"), quota.negative_shortfall(F.lit(total), F.col("n_items"), 14000).cast("long").alias("missing"))


@query("WITH c AS (SELECT p_brand AS tag, l_returnflag AS site, count(*) AS own FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT tag, CAST(sum(own) AS BIGINT) AS combined FROM c GROUP BY tag) SELECT tag, site, own, combined, CAST(ceil(2400 / 3.0) AS BIGINT) AS floor, own < ceil(2400 / 3.0) OR combined < 2400 AS continues FROM c JOIN t USING (tag)")
def site_floor(spark, d):
    own = st.lines(spark, d).groupBy(F.col("p_brand").alias("tag"), F.col("l_returnflag").alias("site")).agg(F.count("*").alias("own"))
    both = own.join(own.groupBy("tag").agg(F.sum("own").alias("combined")), "tag")
    return both.select("tag", "site", "own", "combined", quota.site_floor(2400, 3).alias("floor"), quota.site_continues(F.col("own"), F.col("combined"), 2400, 3).alias("continues"))


@query(f"WITH {BAG_SQL} SELECT tag, count(*) AS n_items FROM bag GROUP BY tag HAVING count(*) >= 2200")
def corpus_tag_having(spark, d):
    return cooccur.tag_counts(st.bag(spark, d)).where("n_items >= 2200")


# --- vocabulary --------------------------------------------------------------------------------------------------------

_VOCAB = f"WITH {MENTION_SQL}, vocab AS (SELECT row_number() OVER (ORDER BY min(pos), tag) - 1 AS row_index, tag, count(*) AS image_count FROM mention GROUP BY tag)"


@query(f"{_VOCAB} SELECT * FROM vocab")
def vocabulary_rows(spark, d):
    return vocabulary.build(st.mentions(spark, d))


@query(f"{_VOCAB}, base AS (SELECT row_index, tag, image_count, 'WarmStartOnly' AS status FROM vocab WHERE row_index < 20), log AS (SELECT {st.POSITION_SQL} AS line, p_brand AS tag, CAST(l_quantity AS BIGINT) AS image_count, CASE l_linestatus WHEN 'O' THEN 'Trained' ELSE 'WarmStartOnly' END AS status FROM lineitem JOIN part ON l_partkey = p_partkey), last AS (SELECT tag, arg_max(image_count, line) AS image_count, arg_max(status, line) AS status, min(line) AS line FROM log GROUP BY tag) SELECT row_index, b.tag, coalesce(l.image_count, b.image_count) AS image_count, coalesce(l.status, b.status) AS status FROM base b LEFT JOIN last l USING (tag) UNION ALL SELECT 19 + row_number() OVER (ORDER BY line, tag), tag, image_count, status FROM last WHERE tag NOT IN (SELECT tag FROM base)")
def vocabulary_delta_replay(spark, d):
    base = vocabulary.build(st.mentions(spark, d)).where("row_index < 20").withColumn("status", F.lit(vocabulary.WARM_START))
    log = st.lines(spark, d).select(st.position().alias("line"), F.col("p_brand").alias("tag"), F.col("l_quantity").cast("long").alias("image_count"), F.when(F.col("l_linestatus") == "O", vocabulary.TRAINED).otherwise(vocabulary.WARM_START).alias("status"))
    return vocabulary.replay(cut(base), log)


@query(f"{_VOCAB} SELECT tag, image_count, CASE WHEN image_count >= 2400 THEN 'Trained' ELSE 'WarmStartOnly' END AS status FROM vocab")
def promote_status(spark, d):
    rows = vocabulary.build(st.mentions(spark, d)).withColumn("status", F.lit(vocabulary.WARM_START))
    return vocabulary.promote(rows, 2400).select("tag", "image_count", "status")


@query(f"{_VOCAB} SELECT item, list_sort(list(DISTINCT row_index)) AS rows FROM mention JOIN vocab USING (tag) GROUP BY item")
def item_tag_rows(spark, d):
    m = st.mentions(spark, d)
    return vocabulary.rows_of(m, vocabulary.build(m))


# --- sampling ----------------------------------------------------------------------------------------------------------

_WEIGHTS = f"WITH {BAG_SQL}, n AS (SELECT tag, count(*) AS n FROM bag GROUP BY tag), w AS (SELECT item, 1.0 / min(n) AS weight FROM bag JOIN n USING (tag) GROUP BY item)"


@query(f"{_WEIGHTS} SELECT item, round(CAST(weight AS DOUBLE), 9) AS weight, round(CAST(sum(CAST(weight AS DOUBLE)) OVER (ORDER BY item) AS DOUBLE), 6) AS high FROM w")
def rare_tag_weights(spark, d):
    out = sampling.cumulative(sampling.rare_weights(st.bag(spark, d)))
    return out.select("item", F.round("weight", 9).alias("weight"), F.round("high", 6).alias("high"))


@query(f"{_WEIGHTS}, c AS (SELECT item, sum(CAST(weight AS DOUBLE)) OVER (ORDER BY item) AS high FROM w), t AS (SELECT max(high) AS total FROM c), draws AS (SELECT range AS draw, (range + 0.37) / 200 AS u FROM range(200)) SELECT draw, min(item) AS item FROM draws, t, c WHERE high >= u * total GROUP BY draw")
def rare_tag_draws(spark, d):
    draws = spark.range(200).select(F.col("id").alias("draw"), ((F.col("id") + 0.37) / 200).alias("u"))
    return sampling.weighted_draws(sampling.rare_weights(st.bag(spark, d)), draws)


@query(f"WITH {BAG_SQL}, m AS (SELECT item, bool_or(tag IN ('Brand#11', 'Brand#12')) AS hit FROM bag GROUP BY item), p AS (SELECT item FROM m WHERE hit ORDER BY md5('0p' || item), item LIMIT 500), n AS (SELECT item FROM m WHERE item NOT IN (SELECT item FROM p) ORDER BY md5('0n' || item), item LIMIT (SELECT count(*) FROM p)) SELECT item, 1 AS positive FROM p UNION ALL SELECT item, 0 FROM n")
def balanced_sample(spark, d):
    return sampling.balanced(st.bag(spark, d), ["Brand#11", "Brand#12"], 500)


@query(f"""WITH RECURSIVE {BAG_SQL}, every AS (SELECT DISTINCT item FROM bag),
turns AS (SELECT tag, list(item ORDER BY item) AS items, row_number() OVER (ORDER BY count(*), min(item), tag) AS turn FROM bag GROUP BY tag),
walk(turn, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT t.turn, list_concat(w.taken, list_filter(t.items, lambda x: NOT list_contains(w.taken, x))[1:least(15, 200 - len(w.taken))]) FROM walk w JOIN turns t ON t.turn = w.turn + 1),
chosen AS (SELECT unnest(taken) AS item FROM (SELECT taken FROM walk ORDER BY turn DESC LIMIT 1)),
rest AS (SELECT item FROM every WHERE item NOT IN (SELECT item FROM chosen) ORDER BY item LIMIT (SELECT 200 - count(*) FROM chosen))
SELECT item FROM every WHERE (SELECT count(*) FROM every) <= 200 OR item IN (SELECT item FROM chosen UNION ALL SELECT item FROM rest)""")
def coverage_sample(spark, d):
    return sampling.coverage(st.bag(spark, d).withColumn("pos", F.col("item")), 200, 15)


@query(f"WITH {BAG_SQL}, i AS (SELECT DISTINCT item FROM bag), v AS (SELECT item FROM i ORDER BY md5('split' || item), item LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM i)) SELECT item, item IN (SELECT item FROM v) AS validation FROM i")
def train_val_split(spark, d):
    return sampling.train_split(st.bag(spark, d).select("item").distinct(), 0.1)


# --- duplicates --------------------------------------------------------------------------------------------------------


def _hashes(spark, d):
    return st.vectors(spark, d).select("item", bits.median_hash(F.col("v")).alias("h"))


def _near_hashes(spark, d):
    """Hashes, and for each a copy with one bit and a copy with two bits changed."""
    own = _hashes(spark, d)
    flip = lambda by, shift: own.select((F.col("item") + by).alias("item"), F.col("h").bitwiseXOR(F.expr(f"shiftleft(1L, cast(item % 61 as int)) {shift}")).alias("h"))
    return own.unionByName(flip(1_000_000, "")).unionByName(flip(2_000_000, "| shiftleft(1L, cast(item % 61 as int) + 2)"))


_NEAR_SQL = f"{HASH_SQL}, near AS (SELECT item, h FROM hash UNION ALL SELECT item + 1000000, xor(h, CAST(1 AS BIGINT) << (item % 61)) FROM hash UNION ALL SELECT item + 2000000, xor(h, (CAST(1 AS BIGINT) << (item % 61)) | (CAST(1 AS BIGINT) << (item % 61 + 2))) FROM hash)"
_NEAR = f"WITH {_NEAR_SQL}"


@query(f"WITH {HASH_SQL} SELECT item, h FROM hash")
def phash64_bits(spark, d):
    return _hashes(spark, d)


@query(f"{_NEAR} SELECT a.item AS a, b.item AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM near a JOIN near b ON a.item < b.item WHERE bit_count(xor(a.h, b.h)) <= 2")
def hamming_pairs(spark, d):
    return dedup.hamming_pairs(_near_hashes(spark, d), 2).select("a", "b", "distance")


@query(f"{_NEAR}, own AS (SELECT h, min(item) AS item, count(*) AS n FROM near GROUP BY h) SELECT a.item AS a, b.item AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance, a.n * b.n AS pairs FROM own a JOIN own b ON a.item < b.item WHERE bit_count(xor(a.h, b.h)) <= 2")
def hamming_groups(spark, d):
    """Pairs between different hashes, and how many pairs of items each of them stands for."""
    members, pairs = dedup.hamming_groups(_near_hashes(spark, d), 2)
    sizes = members.groupBy("first").agg(F.count("*").alias("n"))
    out = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return out.select("a", "b", "distance", (F.col("na") * F.col("nb")).alias("pairs"))


_LEADERS = f"""WITH RECURSIVE {_NEAR_SQL}, first AS (SELECT h, min(item) AS item FROM near GROUP BY h), arrival AS (SELECT row_number() OVER (ORDER BY item) AS r, item, h FROM first),
walk(r, heads, h, leader) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(item BIGINT, h BIGINT)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) UNION ALL
  SELECT r, CASE WHEN found IS NULL THEN list_append(heads, {{'item': item, 'h': h}}) ELSE heads END, h, coalesce(found.item, item)
  FROM (SELECT a.r, w.heads, a.item, a.h, list_sort(list_transform(list_filter(w.heads, lambda x: bit_count(xor(x.h, a.h)) <= 2), lambda x: {{'band': CASE WHEN xor(x.h, a.h) & 2097151 = 0 THEN 0 WHEN (xor(x.h, a.h) >> 21) & 2097151 = 0 THEN 1 ELSE 2 END, 'item': x.item}}))[1] AS found FROM walk w JOIN arrival a ON a.r = w.r + 1) s),
led AS (SELECT near.item, walk.leader FROM near JOIN walk ON walk.h = near.h)"""


@query(f"{_LEADERS} SELECT item, leader FROM led")
def near_dup_leaders(spark, d):
    return dedup.leaders(_near_hashes(spark, d), 2)


@query(f"{_LEADERS} SELECT leader, list_sort(list(DISTINCT 't' || item % 1000)) AS tags FROM led GROUP BY leader")
def merged_tags(spark, d):
    led = dedup.leaders(_near_hashes(spark, d), 2)
    bags = _near_hashes(spark, d).select("item", F.concat(F.lit("t"), (F.col("item") % 1000).cast("string")).alias("tag"))
    return dedup.merged_tags(led, bags)


@query("SELECT md5(text) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def exact_dedup(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    return dedup.exact_first(rows, "digest", "doc_id")


@query("SELECT count(*) AS n FROM (SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0'))")
def unknown_digests(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    return dedup.unknown(rows, rows.where("source = 'src0'"), "digest").agg(F.count("*").alias("n"))


# --- reconciliation ----------------------------------------------------------------------------------------------------

_SAID = f"WITH {SOURCE_SQL}, {BAG_SQL}, every AS (SELECT s.item, CASE WHEN o.item IS NOT NULL THEN coalesce(o.tags, []) ELSE s.tags END AS tags FROM snapshots s LEFT JOIN observed o ON o.item = s.item AND o.source = s.source), said AS (SELECT DISTINCT item, unnest(tags) AS tag FROM every), gone AS (SELECT b.item, b.tag FROM bag b ANTI JOIN said USING (item, tag) WHERE b.item IN (SELECT item FROM observed) AND b.item NOT IN (SELECT item FROM every WHERE tags IS NULL))"


def _reconciled(spark, d):
    return rec.reconcile(st.item_tags(spark, d), st.snapshots(spark, d), st.observed(spark, d))


@query(f"{_SAID} SELECT b.item, b.tag FROM bag b ANTI JOIN gone USING (item, tag) WHERE b.item IN (SELECT item FROM observed)")
def reconcile_tags(spark, d):
    return _reconciled(spark, d).select("item", F.explode("tags").alias("tag"))


@query(f"{_SAID} SELECT tag, -count(*) AS delta FROM gone GROUP BY tag")
def reconcile_deltas(spark, d):
    return rec.deltas(_reconciled(spark, d))


@query(f"{_SAID}, c AS (SELECT tag, count(*) AS n FROM bag GROUP BY tag) SELECT c.tag, c.n - coalesce(g.k, 0) AS positives FROM c LEFT JOIN (SELECT tag, count(*) AS k FROM gone GROUP BY tag) g USING (tag)")
def reconcile_counts(spark, d):
    counts = cooccur.tag_counts(st.bag(spark, d)).withColumnRenamed("n_items", "positives")
    return rec.apply_deltas(counts, rec.deltas(_reconciled(spark, d)))


@query(f"{_SAID} SELECT (SELECT count(*) FROM observed) AS sources_checked, (SELECT count(DISTINCT item) FROM gone) AS items_changed")
def refresh_counters(spark, d):
    return rec.refresh_counters(_reconciled(spark, d), st.observed(spark, d))


_FIRST = f"WITH {MENTION_SQL}, f AS (SELECT item, tag, arg_min(site, pos) AS site, min(pos) AS pos FROM mention GROUP BY 1, 2)"


def _sightings(spark, d):
    return st.mentions(spark, d).withColumnRenamed("pos", "seq")


@query(f"{_FIRST} SELECT tag, count(*) AS positives FROM f GROUP BY tag")
def combined_counts(spark, d):
    return quota.combined_counts(_sightings(spark, d))


@query(f"{_FIRST} SELECT m.site, m.tag, count(*) AS credit FROM mention m JOIN f USING (item, tag) WHERE m.pos = f.pos OR m.tag = 'Brand#11' GROUP BY 1, 2")
def site_credit(spark, d):
    return quota.site_credit(_sightings(spark, d), F.col("tag") == "Brand#11")


@query(f"{_FIRST} SELECT m.site, m.tag, count(*) AS duplicates FROM mention m JOIN f USING (item, tag) WHERE m.pos <> f.pos GROUP BY 1, 2")
def site_duplicates(spark, d):
    return quota.site_duplicates(_sightings(spark, d))


@query(f"{_FIRST} SELECT tag, count(*) AS positives, 2300 - count(*) AS missing FROM f GROUP BY tag HAVING count(*) < 2300")
def shortfalls(spark, d):
    return quota.shortfalls(quota.combined_counts(_sightings(spark, d)), 2300)


_POSTS = "posts AS (SELECT l_orderkey AS item, l_returnflag AS site, l_orderkey * 16 + l_linenumber AS post_id FROM lineitem)"


def _posts(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("site"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("post_id"))


@query(f"WITH {_POSTS}, {BAG_SQL} SELECT item, site, post_id FROM posts WHERE site IN ('A', 'N') AND item IN (SELECT item FROM bag WHERE tag = 'Brand#21')")
def targeted_refresh_sources(spark, d):
    return rec.targeted(_posts(spark, d), st.bag(spark, d), ["Brand#21"], ["A", "N"])


@query(f"WITH {_POSTS} SELECT item, site, post_id FROM posts WHERE site = 'A' AND post_id > 1000 ORDER BY post_id LIMIT 50")
def refresh_batch(spark, d):
    return rec.next_batch(_posts(spark, d), "A", 1000, 50)


@query("WITH r AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 1000 = 7 THEN o_orderkey - 1 ELSE o_orderkey END AS row_index FROM orders), u AS (SELECT row_index, count(*) AS n FROM r GROUP BY 1) SELECT row_index, n, CASE WHEN row_index < 0 OR row_index >= 14000 THEN 'out of bounds' ELSE 'duplicate' END AS problem FROM u WHERE row_index < 0 OR row_index >= 14000 OR n > 1")
def cache_violations(spark, d):
    rows = read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 1000 == 7, F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("row_index"))
    return store.cache_violations(rows, 14000)


@query("WITH o AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, upper(c_mktsegment) AS name, 1.5 AS v FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, CASE WHEN o.k IS NOT NULL THEN o.v ELSE CAST(n.v AS DOUBLE) END AS v FROM o FULL OUTER JOIN n ON o.k = n.k")
def table_upsert(spark, d):
    c = read(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_mktsegment").alias("name"), F.lit(1.5).alias("v"))
    return store.upsert(old, new, ["k"], keep=["v"])


# --- geometry ----------------------------------------------------------------------------------------------------------

_BOX = "s AS (SELECT p_partkey, p_size AS w, CAST(floor(p_retailprice) AS INT) AS h, least(224.0::DOUBLE / p_size, 224.0::DOUBLE / floor(p_retailprice)) AS z FROM part), b AS (SELECT p_partkey, w, h, least(224, greatest(1, CAST(round_even(w * z, 0) AS INT))) AS width, least(224, greatest(1, CAST(round_even(h * z, 0) AS INT))) AS height FROM s), box AS (SELECT p_partkey, w, h, (224 - width) // 2 AS x, (224 - height) // 2 AS y, width, height FROM b)"


def _boxes(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("w"), F.floor("p_retailprice").cast("int").alias("h"))
    return part.withColumn("box", spatial.letterbox(F.col("w"), F.col("h"), 224))


@query(f"WITH {_BOX} SELECT p_partkey, x, y, width, height FROM box")
def letterbox_geometry(spark, d):
    return _boxes(spark, d).select("p_partkey", "box.*")


@query("SELECT p_partkey, 12 + coalesce(sum(16 + p_size * CAST(floor(p_retailprice) AS BIGINT) * 3) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM part")
def record_offsets(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_size", F.floor("p_retailprice").alias("h"))
    return prefix.record_offsets(part, "p_partkey", F.col("p_size"), F.col("h")).select("p_partkey", "offset")


@query(f"WITH {_BOX}, g AS (SELECT y.range AS cy, x.range AS cx FROM range(8) y, range(8) x), v AS (SELECT p_partkey, CAST(cy AS INT) AS cy, CAST(cx AS INT) AS cx FROM box, g WHERE (cy + 0.5) * 28 >= y AND (cy + 0.5) * 28 < y + height AND (cx + 0.5) * 28 >= x AND (cx + 0.5) * 28 < x + width) SELECT p_partkey, cy, cx FROM v UNION ALL SELECT p_partkey, CAST(least(7, greatest(0, floor((y + height / 2) / 28))) AS INT), CAST(least(7, greatest(0, floor((x + width / 2) / 28))) AS INT) FROM box WHERE p_partkey NOT IN (SELECT p_partkey FROM v)")
def spatial_validity(spark, d):
    cells = _boxes(spark, d).select("p_partkey", F.explode(spatial.valid_cells(F.col("box"), 224, 8, 8)).alias("c"))
    return cells.select("p_partkey", F.col("c.y").alias("cy"), F.col("c.x").alias("cx"))


_HEAT = "h AS (SELECT vec_id AS item, generate_subscripts(embedding, 1) - 1 AS k, 1 / (1 + exp(-CAST(unnest(embedding) AS DOUBLE))) AS v FROM embeddings), lim AS (SELECT item, min(v) AS low, max(v) AS high, greatest(0.5, min(v) + 0.6 * (max(v) - min(v))) AS least FROM h GROUP BY item)"


def _heat(spark, d):
    return st.vectors(spark, d).select("item", spatial.heat(F.col("v")).alias("values"))


@query(f"WITH {_HEAT} SELECT item, round(low, 6) AS low, round(high, 6) AS high, round(least, 6) AS threshold FROM lim")
def heatmap_threshold(spark, d):
    v = F.col("values")
    return _heat(spark, d).select("item", F.round(F.array_min(v), 6).alias("low"), F.round(F.array_max(v), 6).alias("high"), F.round(spatial.effective_threshold(v, 0.5, 0.6), 6).alias("threshold"))


_PARTS = f"WITH RECURSIVE {_HEAT}, hot AS (SELECT item, k // 8 AS y, k % 8 AS x, k, v FROM h JOIN lim USING (item) WHERE v >= least), reach(item, k, root) AS (SELECT item, k, k FROM hot UNION SELECT r.item, b.k, r.root FROM reach r JOIN hot a ON a.item = r.item AND a.k = r.k JOIN hot b ON b.item = a.item AND abs(a.y - b.y) + abs(a.x - b.x) = 1), comp AS (SELECT item, k, min(root) AS root FROM reach GROUP BY 1, 2), bound AS (SELECT item, root, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS cells, max(v) AS confidence FROM comp JOIN hot USING (item, k) GROUP BY 1, 2), numbered AS (SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY root) AS INT) AS component, CAST(min_x AS INT) AS min_x, CAST(min_y AS INT) AS min_y, CAST(max_x AS INT) AS max_x, CAST(max_y AS INT) AS max_y, CAST(cells AS INT) AS cells, confidence FROM bound)"


@query(f"{_PARTS} SELECT item, component, min_x, min_y, max_x, max_y, cells, round(confidence, 6) AS confidence FROM numbered")
def heatmap_components(spark, d):
    return spatial.components(_heat(spark, d), 8, 8, 0.5, 0.6).withColumn("confidence", F.round("confidence", 6))


@query(f"{_PARTS} SELECT item, component, CAST(floor(least(640.0, greatest(0, (min_x * 28 - 0) * 640.0 / 224))) AS INT) AS x, CAST(floor(least(320.0, greatest(0, (min_y * 28 - 56) * 320.0 / 112))) AS INT) AS y, CAST(floor(least(640.0, greatest(0, ceil(((max_x + 1) * 28 - 0) * 640.0 / 224)))) AS INT) - CAST(floor(least(640.0, greatest(0, (min_x * 28 - 0) * 640.0 / 224))) AS INT) AS width, CAST(floor(least(320.0, greatest(0, ceil(((max_y + 1) * 28 - 56) * 320.0 / 112)))) AS INT) - CAST(floor(least(320.0, greatest(0, (min_y * 28 - 56) * 320.0 / 112))) AS INT) AS height FROM numbered")
def detect_boxes(spark, d):
    found = spatial.components(_heat(spark, d), 8, 8, 0.5, 0.6)
    w, h = F.lit(640), F.lit(320)
    return spatial.to_image(found, 8, 8, 224, spatial.letterbox(w, h, 224), w, h).select("item", "component", "x", "y", "width", "height")


@query("WITH c AS (SELECT vec_id AS item, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT item, CAST(k % 4 AS BIGINT) AS dim, round(avg(v), 6) AS v FROM c WHERE (k // 4) BETWEEN 4 AND 11 GROUP BY 1, 2")
def masked_pool(spark, d):
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("v", k * 4 + 1, 4))
    valid = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: k.between(4, 11))
    pooled = st.vectors(spark, d).select("item", F.posexplode(spatial.masked_mean(cells, valid, 4)).alias("dim", "v"))
    return pooled.select("item", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


# --- losses ------------------------------------------------------------------------------------------------------------


@query(f"WITH {VEC_SQL}, z AS (SELECT e.item, e.label = t.label AS own, sum(CAST(e.x AS DOUBLE) * t.x) AS z FROM e JOIN tagvec t USING (k) GROUP BY e.item, t.label, e.label), y AS (SELECT CASE WHEN own THEN -z ELSE z END AS m FROM z) SELECT round(avg(greatest(m, 0) + ln(1 + exp(-abs(m)))), 6) AS loss FROM y")
def contrastive_loss(spark, d):
    items, tags = st.vectors(spark, d), st.tag_vectors(spark, d)
    conf = scoring.score(items, tags, None).join(items.select("item", F.col("label").alias("own")), "item")
    logits = conf.select(F.log(F.col("conf") / (1 - F.col("conf"))).alias("logit"), F.when(F.col("own") == F.col("label"), 1).otherwise(-1).alias("y"))
    return losses.contrastive(logits).withColumn("loss", F.round("loss", 6))


@query("WITH c AS (SELECT vec_id AS item, label, CAST(unnest(embedding) AS DOUBLE) / 0.35 AS v FROM embeddings), p AS (SELECT item, CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END AS y, 0.35 * (max(v) + ln(sum(exp(v)) / exp(max(v))) - ln(64)) AS z FROM c GROUP BY item, label) SELECT round(avg(greatest(-y * z, 0) + ln(1 + exp(-abs(y * z)))), 6) AS loss FROM p")
def localized_loss(spark, d):
    maps = st.vectors(spark, d).select(F.col("v").alias("cells"), F.when(F.col("label") % 2 == 0, 1).otherwise(-1).alias("y"))
    return losses.localized(maps, 0.35).withColumn("loss", F.round("loss", 6))


@query("WITH p AS (SELECT CAST(embedding AS DOUBLE[]) AS a, CAST(embedding[33:64] || embedding[1:32] AS DOUBLE[]) AS b FROM embeddings), c AS (SELECT list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) / ((sqrt(list_sum(list_transform(a, lambda x: x * x))) + 1e-8) * (sqrt(list_sum(list_transform(b, lambda x: x * x))) + 1e-8)) AS s FROM p) SELECT round(-avg(s), 6) AS loss FROM c")
def consistency_loss(spark, d):
    turned = F.concat(F.slice("v", 33, 32), F.slice("v", 1, 32))
    pairs = st.vectors(spark, d).select(F.col("v").alias("a"), F.col("v").alias("pa"), turned.alias("b"), turned.alias("pb"))
    return losses.consistency(pairs).withColumn("loss", F.round("loss", 6))


@query(f"WITH {BAG_SQL}, t AS (SELECT DISTINCT tag FROM bag), i AS (SELECT DISTINCT item FROM bag) SELECT i.item, t.tag, CASE WHEN b.item IS NULL THEN -1 ELSE 1 END AS y FROM i CROSS JOIN t LEFT JOIN bag b ON b.item = i.item AND b.tag = t.tag")
def label_matrix(spark, d):
    bags = st.bag(spark, d)
    return losses.label_matrix(bags, bags)


@query("SELECT round(sum(avg_v * n) / sum(n), 4) AS loss FROM (SELECT round(avg(value), 6) AS avg_v, count(*) AS n FROM events GROUP BY user_id)")
def validation_loss(spark, d):
    batches = read(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("loss"), F.count("*").alias("n"))
    return losses.validation_loss(batches).withColumn("loss", F.round("loss", 4))


@query("""WITH RECURSIVE e AS (SELECT user_id AS run, event_id AS step, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
walk(run, r, step, loss, best, waited) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST('inf' AS DOUBLE), 0 FROM events UNION ALL
  SELECT e.run, e.r, e.step, e.loss, CASE WHEN e.loss < w.best - 0.0001 THEN e.loss ELSE w.best END, CASE WHEN e.loss < w.best - 0.0001 THEN 0 ELSE w.waited + 1 END FROM walk w JOIN e ON e.run = w.run AND e.r = w.r + 1)
SELECT run, step, loss, waited >= 3 AS stops FROM walk WHERE r > 0""")
def early_stopping(spark, d):
    runs = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return quota.early_stopping(runs, patience=3)


@query()
def add_tag_fit(spark, d):
    items = st.vectors(spark, d).select("v", F.when(F.col("label") == 3, 1).otherwise(-1).alias("y"))
    row, _ = training.fit_tag(cut(items), steps=15)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(row)], "dim long, value double")


# --- text and events ---------------------------------------------------------------------------------------------------


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, href, url_decode(href) AS link FROM l")
def page_links(spark, d):
    links = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.select("page_id", "href", text.url_unescape(F.col("href")).alias("link"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&') AS title FROM pages")
def page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", text.unescape_basic(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def asctime_roundtrip(spark, d):
    said = text.as_asctime(F.col("ts"))
    return read(spark, d, "events").select("event_id", text.asctime(said, F.current_timestamp()).cast("timestamp_ntz").alias("ts"))


@query("SELECT event_id, upper(substr(event_type, 1, 1)) AS letter, string_split(event_type || '  ' || upper(event_type), ' ')[1] AS first, 2 AS n FROM events")
def tag_strings(spark, d):
    tags = text.tag_list(F.concat_ws("  ", "event_type", F.upper("event_type")))
    return read(spark, d, "events").select("event_id", text.rating_letter(F.upper("event_type")).alias("letter"), F.element_at(tags, 1).alias("first"), F.size(tags).alias("n"))


@query("SELECT CASE CAST(p_size % 8 AS INT) WHEN 1 THEN 'artist:' WHEN 3 THEN 'series:' WHEN 4 THEN 'character:' WHEN 5 THEN 'meta:' ELSE '' END || p_brand AS identity, p_brand AS raw, count(*) AS n FROM part GROUP BY 1, 2")
def identities(spark, d):
    name = taxonomy.identity(F.col("p_brand"), taxonomy.category_of(F.col("p_size") % 8))
    rows = read(spark, d, "part").select(name.alias("identity"))
    return rows.groupBy("identity").agg(F.count("*").alias("n")).select("identity", taxonomy.raw_name(F.col("identity")).alias("raw"), "n")


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def event_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT user_id AS item, list_sort(list(DISTINCT event_type)) AS tags FROM events GROUP BY user_id")
def events_cursor_ingest(spark, d):
    """Events through the resumable ingestion: one item a user, its hash from its number, tags its event types."""
    import uuid

    from tessera.session import ensure_checkpoint_dir
    from tessera.streaming.ingest import Ingest

    folder = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    source = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    rows = source.select(F.col("event_id").alias("seq"), F.col("event_type").alias("site"), F.col("user_id").alias("item"), F.xxhash64("user_id").alias("h"), F.array("event_type").alias("tags"))
    work = Ingest(spark, f"{folder}/tables")
    work.run(rows, f"{folder}/checkpoint").awaitTermination()
    return work.tags().groupBy("item").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@query(f"WITH {BAG_SQL} SELECT count(*) AS n_pairs, count(DISTINCT item) AS n_items, count(DISTINCT tag) AS n_tags FROM bag")
def corpus_counts(spark, d):
    return st.bag(spark, d).agg(F.count("*").alias("n_pairs"), F.count_distinct("item").alias("n_items"), F.count_distinct("tag").alias("n_tags"))


from tessera.plans import landed as _landed, pictures as _pictures, tables as _tables  # noqa: E402, F401  they register their queries


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return tag_scores(spark, folder)


