"""Tables of the tagging domain, derived from the given ones by the same rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.taxonomy import category_of
from tessera.functions.vectors import mean_vectors
from tessera.session import read

#: An alias table with a chain, a cycle and a name of the corpus at either end.
ALIASES = (("Brand#11", "Brand#12"), ("Brand#12", "Brand#13"), ("old_a", "old_b"), ("old_b", "Brand#21"), ("loop_a", "loop_b"), ("loop_b", "loop_a"), ("to_loop", "loop_a"))
SECOND_ALIASES = (("Brand#11", "Brand#55"), ("Brand#44", "Brand#45"))

BAG_SQL = "bag AS (SELECT DISTINCT l_orderkey AS item, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"
ALIAS_SQL = "alias(antecedent, consequent) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ")"
POSITION_SQL = "((l_orderkey * 16 + l_linenumber) * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 1000000 + l_partkey"
MENTION_SQL = f"mention AS (SELECT l_orderkey AS item, {POSITION_SQL} AS pos, p_brand AS tag, l_returnflag AS site FROM lineitem JOIN part ON l_partkey = p_partkey)"
CATEGORY_SQL = "CASE CAST(substr(raw, 7) AS INT) % 7 WHEN 1 THEN 'artist' WHEN 3 THEN 'series' WHEN 4 THEN 'character' WHEN 5 THEN 'meta' ELSE 'general' END"
LISTING_SQL = f"""listed AS (SELECT CASE l_returnflag WHEN 'A' THEN 'a' ELSE 'b' END AS site, p_brand AS raw, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2),
listing AS (SELECT site, raw, {CATEGORY_SQL} AS category, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, raw) AS pos FROM listed)"""
IDENTITY_SQL = "CASE WHEN {c} = 'general' THEN {r} ELSE {c} || ':' || {r} END"
CLOSURE_SQL = """walk(raw, cur, path, stop) AS (
  SELECT antecedent, antecedent, CAST([] AS VARCHAR[]), false FROM alias
  UNION ALL
  SELECT w.raw, CASE WHEN list_contains(w.path, w.cur) THEN w.cur ELSE a.consequent END, list_append(w.path, w.cur), list_contains(w.path, w.cur)
  FROM walk w JOIN alias a ON a.antecedent = w.cur WHERE NOT w.stop),
closed AS (SELECT raw, arg_max(cur, len(path)) AS canonical FROM walk GROUP BY raw)"""
VEC_SQL = """e AS (SELECT vec_id AS item, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
tagvec AS (SELECT label, k, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY label, k),
scores AS (SELECT e.item, t.label, 1 / (1 + exp(-sum(CAST(e.x AS DOUBLE) * t.x))) AS conf FROM e JOIN tagvec t USING (k) GROUP BY e.item, t.label)"""
HASH_SQL = """flat AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v, list_sort(CAST(embedding AS DOUBLE[])) AS s FROM embeddings),
bit AS (SELECT item, unnest(v) AS x, generate_subscripts(v, 1) AS k, (s[32] + s[33]) / 2 AS m FROM flat),
hash AS (SELECT item, CAST(sum(CASE WHEN x > m THEN CASE WHEN k = 1 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << (64 - k) END ELSE 0 END) AS BIGINT) AS h FROM bit GROUP BY item)"""
SOURCE_SQL = """src AS (SELECT l_orderkey AS item, l_returnflag AS source, list_sort(list(DISTINCT p_brand)) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
snapshots AS (SELECT item, source, CASE WHEN source = 'R' AND item % 2 = 1 THEN NULL ELSE tags END AS tags FROM src),
observed AS (SELECT l_orderkey AS item, 'A' AS source, list(DISTINCT p_brand) FILTER (l_linestatus = 'O') AS tags FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    items = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    return items.join(read(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


def bag(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select(F.col("l_orderkey").alias("item"), F.col("p_brand").alias("tag")).distinct()


def position() -> Column:
    """A line's place in the corpus; what an order lists twice under a number is told apart by flag and part."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 4 + flag) * 1_000_000 + F.col("l_partkey")


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select(F.col("l_orderkey").alias("item"), position().alias("pos"), F.col("p_brand").alias("tag"), F.col("l_returnflag").alias("site"))


def aliases(spark: SparkSession, rows=ALIASES) -> DataFrame:
    return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(rows)], "antecedent string, consequent string, pos long")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = lines(spark, folder).where(F.col("l_returnflag").isin("A", "N")).groupBy(F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("site"), F.col("p_brand").alias("raw")).agg(F.count("*").alias("n"))
    code = F.substring("raw", 7, 9).cast("int") % 7
    return rows.select("site", "raw", category_of(code).alias("category"), "n", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "raw")).alias("pos"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"), "label")


def tag_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return mean_vectors(vectors(spark, folder), "label", "v")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).groupBy(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("source")).agg(F.array_sort(F.collect_set("p_brand")).alias("tags"))
    never = (F.col("source") == "R") & (F.col("item") % 2 == 1)
    return rows.select("item", "source", F.when(~never, F.col("tags")).alias("tags"))


def observed(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("item"))
    said = rows.agg(F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("p_brand")))).alias("tags"))
    return said.select("item", F.lit("A").alias("source"), F.when(F.size("tags") > 0, F.col("tags")).alias("tags"))


def item_tags(spark: SparkSession, folder: str) -> DataFrame:
    return bag(spark, folder).groupBy("item").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
