"""Queries of the image kernels, over pictures whose pixels follow from the items' numbers, and their SQL.

Rounded results are scaled by a factor without a short form first, so that hardly
a value lies on the border between two (a grey of exactly 100 does). A picture's red, green and blue are whole numbers made of item, row and column, so SQL draws the same picture. Where a
kernel works on doubles, its SQL does the same operations in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators import images, spatial
from tessera.plans import standins as st
from tessera.plans.registry import query
from tessera.session import read

CANVAS = 8
PICTURE_SQL = """pic AS (SELECT vec_id AS item, CAST(9 + vec_id % 7 AS INT) AS w, CAST(9 + vec_id % 5 AS INT) AS h FROM embeddings),
pixel AS (SELECT item, w, h, y, x, c, CAST((item * 31 + y * 17 + x * 13 + c * 71 + x * x * y * 7 + y * y * x * 29) % 256 AS DOUBLE) AS v FROM pic, unnest(range(h)) AS a(y), unnest(range(w)) AS b(x), unnest(range(3)) AS d(c))"""


def _axis(to: str, size: str, name: str) -> str:
    """The two neighbours and the share of the second one, for each of ``to`` places on an axis of ``size``."""
    return f"""{name}_at AS (SELECT *, least(greatest((CAST(i AS DOUBLE) + 0.5) * (CAST({size} AS DOUBLE) / {to}) - 0.5, 0), {size} - 1) AS p FROM {name}_in),
{name} AS (SELECT *, CAST(floor(p) AS INT) AS i0, least(CAST(floor(p) AS INT) + 1, {size} - 1) AS i1, p - floor(p) AS f FROM {name}_at)"""


def resized_sql(source: str, box: str, into: str = "resized") -> str:
    """``into`` (item, i, j, c, v): every picture of ``source`` (item, y, x, c, v) at the size that ``box`` (item, w, h, tw, th) gives."""
    ys, xs = f"{into}_y", f"{into}_x"
    return f"""{ys}_in AS (SELECT item, h, th, unnest(range(th)) AS i FROM {box}), {_axis('th', 'h', ys)},
{xs}_in AS (SELECT item, w, tw, unnest(range(tw)) AS i FROM {box}), {_axis('tw', 'w', xs)},
{into} AS (SELECT y.item, y.i AS i, x.i AS j, a.c,
  (a.v * (1 - x.f) + b.v * x.f) * (1 - y.f) + (c.v * (1 - x.f) + d.v * x.f) * y.f AS v
  FROM {ys} y JOIN {xs} x ON y.item = x.item
  JOIN {source} a ON a.item = y.item AND a.y = y.i0 AND a.x = x.i0
  JOIN {source} b ON b.item = y.item AND b.y = y.i0 AND b.x = x.i1 AND b.c = a.c
  JOIN {source} c ON c.item = y.item AND c.y = y.i1 AND c.x = x.i0 AND c.c = a.c
  JOIN {source} d ON d.item = y.item AND d.y = y.i1 AND d.x = x.i1 AND d.c = a.c)"""


BOX_SQL = f"""scaled AS (SELECT item, w, h, least({CANVAS} / CAST(w AS DOUBLE), {CANVAS} / CAST(h AS DOUBLE)) AS s FROM pic),
sized AS (SELECT item, w, h, CAST(least(greatest(round_even(w * s, 0), 1), {CANVAS}) AS INT) AS tw, CAST(least(greatest(round_even(h * s, 0), 1), {CANVAS}) AS INT) AS th FROM scaled),
box AS (SELECT *, ({CANVAS} - tw) // 2 AS ox, ({CANVAS} - th) // 2 AS oy FROM sized)"""
CONTENT_SQL = f"""{PICTURE_SQL}, {BOX_SQL}, {resized_sql('pixel', 'box')},
content AS (SELECT r.item, i, j, c, CAST(least(greatest(round_even(v, 0), 0), 255) AS INT) AS v, ox, oy, tw, th FROM resized r JOIN box ON box.item = r.item)"""
CANVAS_SQL = f"""canvas AS (SELECT pic.item, y, x, d.c, coalesce(content.v, CASE d.c WHEN 0 THEN 124 WHEN 1 THEN 116 ELSE 104 END) AS v, content.v IS NOT NULL AS inside
  FROM pic, unnest(range({CANVAS})) AS a(y), unnest(range({CANVAS})) AS b(x), unnest(range(3)) AS d(c) JOIN box ON box.item = pic.item LEFT JOIN content ON content.item = pic.item AND content.i = y - box.oy AND content.j = x - box.ox AND content.c = d.c)"""


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """(item, width, height, pixels) by the rule of ``PICTURE_SQL``."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), (9 + F.col("vec_id") % 7).cast("int").alias("width"), (9 + F.col("vec_id") % 5).cast("int").alias("height"))
    place = F.sequence(F.lit(0), F.col("width") * F.col("height") * 3 - 1)

    def value(k: Column) -> Column:
        at = F.floor(k / 3)
        y, x, c = F.floor(at / F.col("width")), at % F.col("width"), k % 3
        return F.lpad(F.hex(((F.col("item") * 31 + y * 17 + x * 13 + c * 71 + x * x * y * 7 + y * y * x * 29) % 256).cast("long")), 2, "0")

    return rows.withColumn("pixels", F.unhex(F.array_join(F.transform(place, value), "")))


def _each(df: DataFrame, make, schema: str) -> DataFrame:
    """A row for each picture: ``make(row)`` gives what follows the item."""
    names = [x.split()[0] for x in schema.split(", ")]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.item, *make(r)) for r in b.itertuples(index=False)], columns=["item", *names])

    return df.mapInPandas(made, f"item long, {schema}")


def _array(r) -> np.ndarray:
    return np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)


@query(f"WITH {CONTENT_SQL}, {CANVAS_SQL} SELECT item, list(v ORDER BY y, x, c) AS pixels FROM canvas GROUP BY item")
def letterbox_pixels(spark, d):
    return _each(pictures(spark, d), lambda r: (images.letterbox(_array(r), CANVAS)[0].reshape(-1).tolist(),), "pixels array<int>")


_NORMAL = "(CAST(v AS FLOAT) / CAST(255 AS FLOAT) - CASE c WHEN 0 THEN CAST(0.485 AS FLOAT) WHEN 1 THEN CAST(0.456 AS FLOAT) ELSE CAST(0.406 AS FLOAT) END) / CASE c WHEN 0 THEN CAST(0.229 AS FLOAT) WHEN 1 THEN CAST(0.224 AS FLOAT) ELSE CAST(0.225 AS FLOAT) END"


@query(f"WITH {CONTENT_SQL}, {CANVAS_SQL} SELECT item, list(CAST(round({_NORMAL} * 1000) AS INT) ORDER BY c, y, x) AS thousandths FROM canvas GROUP BY item")
def normalised_input(spark, d):
    """Decoded, letterboxed and normalised, channel by channel."""
    made = lambda r: (_thousandths(images.normalise(images.letterbox(_array(r), CANVAS)[0])),)
    return _each(pictures(spark, d), made, "thousandths array<int>")


def _thousandths(values: np.ndarray) -> list[int]:
    scaled = values.reshape(-1) * np.float32(1000)
    return (np.sign(scaled) * np.floor(np.abs(scaled) + np.float32(0.5))).astype(int).tolist()


@query(f"WITH {CONTENT_SQL} SELECT item, ox AS x, oy AS y, tw AS width, th AS height, upper(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY i, j, c)) AS pixels FROM content GROUP BY ALL")
def stored_content(spark, d):
    return images.encode_images(pictures(spark, d), CANVAS).withColumn("pixels", F.hex("pixels"))


@query(f"WITH {CONTENT_SQL}, {CANVAS_SQL} SELECT item, list(CASE WHEN inside THEN CAST(round({_NORMAL} * 1000) AS INT) ELSE 0 END ORDER BY c, y, x) AS thousandths FROM canvas GROUP BY item")
def reconstructed_input(spark, d):
    """The input from stored content: the bars are exactly 0."""
    made = lambda r: (_thousandths(images.reconstruct(r.pixels, (r.x, r.y, r.width, r.height), CANVAS)),)
    return _each(images.encode_images(pictures(spark, d), CANVAS), made, "thousandths array<int>")


@query(f"WITH {CONTENT_SQL} SELECT item, list(v ORDER BY i, j, c) AS pixels FROM content GROUP BY item")
def stripped_content(spark, d):
    """Content that comes back from the float input."""
    def made(r):
        box = (r.x, r.y, r.width, r.height)
        return (list(images.strip(images.reconstruct(r.pixels, box, CANVAS), box)),)

    return _each(images.encode_images(pictures(spark, d), CANVAS), made, "pixels array<int>")


@query(f"WITH {CONTENT_SQL} SELECT item, list(v ORDER BY c, i, j) AS planes, list(v ORDER BY i, j, c) AS pixels FROM content GROUP BY item")
def channel_order(spark, d):
    """Planes of channels and back to pixels."""
    def made(r):
        planes = _array(r).transpose(2, 0, 1)
        return planes.reshape(-1).tolist(), planes.transpose(1, 2, 0).reshape(-1).tolist()

    return _each(images.encode_images(pictures(spark, d), CANVAS).drop("x", "y"), made, "planes array<int>, pixels array<int>")


def _rounded(values: np.ndarray, places: int) -> np.ndarray:
    """Rounded as SQL does: what lies on a border goes away from zero, not to the even neighbour."""
    scaled = values * 10.0**places
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0)) / 10.0**places


def _grey_sql(size: int) -> str:
    return f"""{PICTURE_SQL}, box AS (SELECT item, w, h, {size} AS tw, {size} AS th FROM pic), {resized_sql('pixel', 'box')},
grey AS (SELECT item, i, j, sum(v * CASE c WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END) AS v FROM resized GROUP BY item, i, j)"""


def _dct_sql(size: int, keep: int) -> str:
    cosine = f"cos(pi() / {size} * ({{x}} + 0.5) * {{u}})"
    return f"""across AS (SELECT item, i, u, sum(v * {cosine.format(x='j', u='u')}) AS v FROM grey, unnest(range({keep})) AS a(u) GROUP BY item, i, u),
low AS (SELECT item, t, u, sum(v * {cosine.format(x='i', u='t')}) AS v FROM across, unnest(range({keep})) AS b(t) GROUP BY item, t, u)"""


@query(f"WITH {_grey_sql(CANVAS)} SELECT item, list(round(v * 0.7310585, 4) ORDER BY i, j) AS plane FROM grey GROUP BY item")
def grey_plane(spark, d):
    return _each(pictures(spark, d), lambda r: (_rounded(images.grey(_array(r), CANVAS) * 0.7310585, 4).reshape(-1).tolist(),), "plane array<double>")


@query(f"WITH {_grey_sql(CANVAS)}, {_dct_sql(CANVAS, CANVAS)} SELECT item, list(round(v * 0.7310585, 3) + 0.0 ORDER BY t, u) AS coefficients FROM low GROUP BY item")
def dct_plane(spark, d):
    return _each(pictures(spark, d), lambda r: ((_rounded(images.transform(images.grey(_array(r), CANVAS), CANVAS) * 0.7310585, 3) + 0.0).reshape(-1).tolist(),), "coefficients array<double>")


@query(f"""WITH {_grey_sql(32)}, {_dct_sql(32, 8)}, middle AS (SELECT item, median(v) AS m FROM low GROUP BY item)
SELECT low.item, string_agg(CASE WHEN v > m THEN '1' ELSE '0' END, '' ORDER BY t, u) AS bits FROM low JOIN middle ON middle.item = low.item GROUP BY low.item""")
def picture_hashes(spark, d):
    """The 64-bit hash of each picture, as its bits."""
    return images.hash_images(pictures(spark, d)).select("item", F.lpad(F.bin("h"), 64, "0").alias("bits"))


HEAT_SQL = "heat AS (SELECT vec_id AS item, CAST((k - 1) // 8 AS INT) AS y, CAST((k - 1) % 8 AS INT) AS x, 0 AS c, 1 / (1 + exp(-CAST(v AS DOUBLE))) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings))"


def _heat(spark, d) -> DataFrame:
    return st.vectors(spark, d).select("item", F.transform("v", lambda x: 1 / (1 + F.exp(-x))).alias("values"))


@query(f"WITH {HEAT_SQL}, box AS (SELECT DISTINCT item, 8 AS w, 8 AS h, 16 AS tw, 16 AS th FROM heat), {resized_sql('heat', 'box')} SELECT item, list(round(v, 6) ORDER BY i, j) AS plane FROM resized GROUP BY item")
def bilinear_upsample(spark, d):
    return _each(_heat(spark, d), lambda r: (np.round(images.resize(np.asarray(r.values).reshape(8, 8), 16, 16), 6).reshape(-1).tolist(),), "plane array<double>")


_REFINE = 12


@query(f"""WITH {HEAT_SQL}, {PICTURE_SQL}, up_box AS (SELECT item, 8 AS w, 8 AS h, {_REFINE} AS tw, {_REFINE} AS th FROM pic),
guide_box AS (SELECT item, w, h, {_REFINE} AS tw, {_REFINE} AS th FROM pic),
{resized_sql('heat', 'up_box', 'up')},
{resized_sql('pixel', 'guide_box')},
guide AS (SELECT item, i, j, max(v) FILTER (c = 0) / 255 AS r, max(v) FILTER (c = 1) / 255 AS g, max(v) FILTER (c = 2) / 255 AS b FROM resized GROUP BY item, i, j),
both_ AS (SELECT guide.*, up.v FROM guide JOIN up ON up.item = guide.item AND up.i = guide.i AND up.j = guide.j),
taps AS (SELECT a.item, a.i, a.j, b.v, exp(-((b.i - a.i) * (b.i - a.i) + (b.j - a.j) * (b.j - a.j)) / 18.0 - ((b.r - a.r) ** 2 + (b.g - a.g) ** 2 + (b.b - a.b) ** 2) / (2 * 0.15 ** 2)) AS w
  FROM both_ a JOIN both_ b ON a.item = b.item AND b.i BETWEEN a.i - 4 AND a.i + 4 AND b.j BETWEEN a.j - 4 AND a.j + 4),
fine AS (SELECT item, i, j, sum(w * v) / sum(w) AS v FROM taps GROUP BY item, i, j)
SELECT item, list(round(v, 5) ORDER BY i, j) AS plane FROM fine GROUP BY item""")
def refined_heatmap(spark, d):
    """A heatmap refined along the edges of its picture."""
    def made(r):
        guide = images.resize(_array(r).astype(np.float64), _REFINE, _REFINE) / 255
        return (np.round(images.refine(np.asarray(r.values).reshape(8, 8), guide), 5).reshape(-1).tolist(),)

    return _each(_heat(spark, d).join(pictures(spark, d), "item"), made, "plane array<double>")


@query(f"""WITH {HEAT_SQL}, {PICTURE_SQL}, span AS (SELECT item, min(v) AS low, greatest(max(v) - min(v), 1e-6) AS span FROM heat GROUP BY item),
shown AS (SELECT heat.item, y, x, c, (v - low) / span AS v FROM heat JOIN span ON span.item = heat.item),
box AS (SELECT item, 8 AS w, 8 AS h, w AS tw, h AS th FROM pic), {resized_sql('shown', 'box')},
mixed AS (SELECT p.item, p.y, p.x, p.c, p.v * (1 - r.v * 0.6) + CASE p.c WHEN 0 THEN 255 ELSE 0 END * (r.v * 0.6) AS v FROM pixel p JOIN resized r ON r.item = p.item AND r.i = p.y AND r.j = p.x)
SELECT item, list(CAST(least(greatest(round_even(v, 0), 0), 255) AS INT) ORDER BY y, x, c) AS pixels FROM mixed GROUP BY item""")
def heatmap_overlay(spark, d):
    made = lambda r: (images.overlay(_array(r).astype(np.float64), np.asarray(r.values).reshape(8, 8)).reshape(-1).tolist(),)
    return _each(_heat(spark, d).join(pictures(spark, d), "item"), made, "pixels array<int>")


@query(f"""WITH {PICTURE_SQL}, {BOX_SQL}, cell AS (SELECT item, r, c, (r + 0.5) * {CANVAS} / 4 >= oy AND (r + 0.5) * {CANVAS} / 4 < oy + th AND (c + 0.5) * {CANVAS} / 4 >= ox AND (c + 0.5) * {CANVAS} / 4 < ox + tw AS inside FROM box, unnest(range(4)) AS a(r), unnest(range(4)) AS b(c))
SELECT item, string_agg(CASE WHEN inside THEN '1' ELSE '0' END, '' ORDER BY r, c) AS mask FROM cell GROUP BY item""")
def spatial_mask(spark, d):
    made = lambda r: ("".join("01"[int(x)] for x in images.valid_mask((r.x, r.y, r.width, r.height), CANVAS, 4, 4).reshape(-1)),)
    return _each(images.encode_images(pictures(spark, d), CANVAS), made, "mask string")


@query("""WITH cell AS (SELECT vec_id AS item, (k - 1) // 4 AS cell, (k - 1) % 4 AS dim, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)),
tag(label, dim, t) AS (VALUES ('a', 0, 1.0), ('a', 1, -0.5), ('a', 2, 0.25), ('a', 3, 2.0), ('b', 0, 0.0), ('b', 1, 3.0), ('b', 2, -1.0), ('b', 3, 0.5)),
dots AS (SELECT item, label, cell, sum(v * t) AS s FROM cell JOIN tag USING (dim) GROUP BY ALL)
SELECT item, label, list(round(1 / (1 + exp(-s)), 6) ORDER BY cell) AS values FROM dots GROUP BY item, label""")
def patch_heatmaps(spark, d):
    """How much each cell of a feature map speaks for a tag."""
    cells = st.vectors(spark, d).select("item", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("v", k * 4 + 1, 4)).alias("cells"))
    tags = spark.createDataFrame([("a", [1.0, -0.5, 0.25, 2.0]), ("b", [0.0, 3.0, -1.0, 0.5])], "label string, v array<double>")
    return spatial.heatmaps(cells, tags).select("item", "label", F.transform("values", lambda x: F.round(x, 6)).alias("values"))


@query("""WITH cell AS (SELECT vec_id AS item, (k - 1) // 4 AS cell, (k - 1) % 4 AS dim, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)),
d AS (SELECT DISTINCT item, dim FROM cell)
SELECT d.item, d.dim, round(coalesce(sum(v) FILTER (cell < d.item % 3), 0) / greatest(count(*) FILTER (cell < d.item % 3), 1e-6), 6) AS v FROM d JOIN cell ON cell.item = d.item AND cell.dim = d.dim GROUP BY d.item, d.dim""")
def training_pool(spark, d):
    """The training side's pooling: divided by the count of valid cells, but never by 0."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("v", k * 4 + 1, 4))
    valid = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: k < F.col("item") % 3)
    pooled = st.vectors(spark, d).select("item", F.posexplode(spatial.masked_mean(cells, valid, 4, floor=1e-6)).alias("dim", "v"))
    return pooled.select("item", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


@query(f"""WITH {CONTENT_SQL}, wanted AS (SELECT item, row_number() OVER (ORDER BY md5('7' || item), item) - 1 AS place FROM pic), {CANVAS_SQL}
SELECT place // 16 AS batch, place % 16 AS row, wanted.item, list(CASE WHEN inside THEN CAST(round({_NORMAL} * 1000) AS INT) ELSE 0 END ORDER BY c, y, x) AS thousandths FROM canvas JOIN wanted ON wanted.item = canvas.item GROUP BY ALL""")
def training_batches(spark, d):
    """Stored pictures in a shuffled order as batches of inputs."""
    from tessera.operators.training import batches

    stored = images.encode_images(pictures(spark, d), CANVAS).withColumnRenamed("item", "row_index")
    out = batches(stored, 16, CANVAS, "7")
    made = out.select("batch", "row", F.col("row_index").alias("item"), F.transform("values", lambda v: F.round(v * F.lit(1000.0).cast("float"), 0).cast("int")).alias("thousandths"))
    return made


_FINE = 32


@query(f"""WITH {HEAT_SQL}, box AS (SELECT DISTINCT item, 8 AS w, 8 AS h, {_FINE} AS tw, {_FINE} AS th FROM heat), {resized_sql('heat', 'box')},
taps AS (SELECT a.item, a.i, a.j, b.v, exp(-((b.i - a.i) * (b.i - a.i) + (b.j - a.j) * (b.j - a.j)) / 18.0 - 3 * (b.v - a.v) ** 2 / (2 * 0.15 ** 2)) AS w
  FROM resized a JOIN resized b ON a.item = b.item AND b.i BETWEEN a.i - 4 AND a.i + 4 AND b.j BETWEEN a.j - 4 AND a.j + 4),
fine AS (SELECT item, i, j, sum(w * v) / sum(w) AS v FROM taps GROUP BY item, i, j)
SELECT item, round(min(v), 6) AS low, round(max(v), 6) AS high FROM fine GROUP BY item""")
def heatmap_refined(spark, d):
    """The range of a heatmap that is refined along its own edges."""
    def made(r):
        grid = np.asarray(r.values).reshape(8, 8)
        peak = images.refine(grid, np.repeat(images.resize(grid, _FINE, _FINE)[..., None], 3, axis=2))
        return round(float(peak.min()), 6), round(float(peak.max()), 6)

    return _each(_heat(spark, d), made, "low double, high double")


@query(f"""WITH grid AS (SELECT vec_id AS item, CAST((k - 1) // 8 AS INT) AS y, CAST((k - 1) % 8 AS INT) AS x, 0 AS c, CAST(least(255, greatest(0, round((CAST(v AS DOUBLE) + 0.5) * 255))) AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)),
box AS (SELECT DISTINCT item, 8 AS w, 8 AS h, 32 AS tw, 32 AS th FROM grid), {resized_sql('grid', 'box')}, grey AS (SELECT item, i, j, v * 0.299 + v * 0.587 + v * 0.114 AS v FROM resized), {_dct_sql(32, 8)},
middle AS (SELECT item, median(v) AS m FROM low GROUP BY item)
SELECT low.item, CAST(sum(CASE WHEN v <= m THEN 0 WHEN t = 0 AND u = 0 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << CAST(63 - t * 8 - u AS INT) END) AS BIGINT) AS h FROM low JOIN middle ON middle.item = low.item GROUP BY low.item""")
def image_hashes(spark, d):
    """Hashes of grey pictures that are made of embeddings."""
    pixel = F.transform("v", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.round((x + 0.5) * 255).cast("int"))))
    hexes = F.array_join(F.transform(pixel, lambda p: F.repeat(F.lpad(F.hex(p.cast("long")), 2, "0"), 3)), "")
    return images.hash_images(st.vectors(spark, d).select("item", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(hexes).alias("pixels")))


_VALID = f"""valid AS (SELECT item, cy, cx, (cy + 0.5) * {CANVAS} / 2 >= oy AND (cy + 0.5) * {CANVAS} / 2 < oy + th AND (cx + 0.5) * {CANVAS} / 2 >= ox AND (cx + 0.5) * {CANVAS} / 2 < ox + tw AS inside FROM box, unnest(range(2)) AS a(cy), unnest(range(2)) AS b(cx))"""


@query(f"""WITH {CONTENT_SQL}, {CANVAS_SQL}, {_VALID}, cell AS (SELECT item, y // 4 AS cy, x // 4 AS cx, c, avg(CAST(CASE WHEN inside THEN {_NORMAL} ELSE 0 END AS DOUBLE)) AS v FROM canvas GROUP BY ALL)
SELECT cell.item, list(round(m * 0.7310585, 2) + 0.0 ORDER BY c) AS v FROM (SELECT cell.item, c, avg(v) AS m FROM cell JOIN valid ON valid.item = cell.item AND valid.cy = cell.cy AND valid.cx = cell.cx WHERE valid.inside GROUP BY cell.item, c) cell GROUP BY cell.item""")
def encoded_pictures(spark, d):
    """Stored pictures through a finished encoder (here one that takes means of 4x4 pixels), pooled over the cells inside the box."""
    from tessera.models.graph import Graph

    graph = Graph("means")
    means = graph.node("AveragePool", graph.input("pixel_values", [1, 3, CANVAS, CANVAS]), kernel_shape=[4, 4], strides=[4, 4])
    graph.output(means, "spatial_features")
    out = images.run_onnx(images.encode_images(pictures(spark, d), CANVAS), graph.bytes(), CANVAS)
    return out.select("item", F.transform("v", lambda x: F.round(x.cast("double") * 0.7310585, 2) + F.lit(0.0)).alias("v"))


@query("""WITH letter AS (SELECT p_partkey AS tag, ascii(unnest(string_split(p_name, ''))) % 16 AS k FROM part), e(j) AS (VALUES (0), (1), (2))
SELECT tag, list(round(m, 4) + 0.0 ORDER BY j) AS v FROM (SELECT tag, j, avg((k * (j + 3)) % 7 - 3) AS m FROM letter, e GROUP BY tag, j) GROUP BY tag""")
def embedded_texts(spark, d):
    """Texts through a finished text encoder (here the mean of the letters' rows), with the caller's own tokenizer."""
    from tessera.models.graph import Graph
    from tessera.models.run import embed_texts

    graph = Graph("letters")
    ids, mask = graph.input("input_ids", ["n", "length"], whole=True), graph.input("attention_mask", ["n", "length"])
    table = graph.constant(np.array([[(k * (j + 3)) % 7 - 3 for j in range(3)] for k in range(16)], np.float32))
    wide = graph.node("Unsqueeze", mask, graph.constant(np.array([2])))
    total = graph.node("ReduceSum", graph.node("Mul", graph.node("Gather", table, ids), wide), graph.constant(np.array([1])), keepdims=0)
    size = graph.node("ReduceSum", wide, graph.constant(np.array([1])), keepdims=0)
    graph.output(graph.node("Div", total, size), "embedding")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("tag"), F.col("p_name").alias("text"))
    out = embed_texts(rows, graph.bytes(), lambda t: [ord(c) % 16 for c in t])
    return out.select("tag", F.transform("v", lambda x: F.round(x.cast("double"), 4) + F.lit(0.0)).alias("v"))


@query("SELECT * FROM (VALUES ('both', 'CUDAExecutionProvider'), ('processor', 'CPUExecutionProvider'), ('none', 'CPUExecutionProvider')) t(machine, device)")
def device_choice(spark, d):
    from tessera.models.run import devices

    machines = {"both": ["CPUExecutionProvider", "CUDAExecutionProvider"], "processor": ["CPUExecutionProvider"], "none": []}
    return spark.createDataFrame([(k, devices(v)[0]) for k, v in machines.items()], "machine string, device string")
