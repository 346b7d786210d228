"""Grids of patch scores: letterbox geometry, valid cells, pooling, components, boxes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions.vectors import clamp, sigmoid

BOX = "struct<x:int,y:int,width:int,height:int>"


def letterbox(width: Column, height: Column, canvas: int) -> Column:
    """Where an image lies on a square canvas: scaled to fit (halves to even), centred, at least one pixel either way."""
    scale = F.least(F.lit(float(canvas)) / width, F.lit(float(canvas)) / height)
    w, h = (clamp(F.bround(x * scale).cast("int"), 1, canvas) for x in (width, height))
    return F.struct(F.floor((F.lit(canvas) - w) / 2).cast("int").alias("x"), F.floor((F.lit(canvas) - h) / 2).cast("int").alias("y"), w.alias("width"), h.alias("height"))


def _inside(start: Column, length: Column, cells: int, stride: float) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: ((k + 0.5) * stride >= start) & ((k + 0.5) * stride < start + length))


def valid_cells(box: Column, canvas: int, rows: int, cols: int) -> Column:
    """Cells (y, x) whose centre is inside the box; if there is none, the one that the box's middle is in."""
    dy, dx = canvas / rows, canvas / cols
    ys, xs = _inside(box["y"], box["height"], rows, dy), _inside(box["x"], box["width"], cols, dx)
    grid = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))
    near = lambda start, length, stride, cells: clamp(F.floor((start + length / 2) / stride).cast("int"), 0, cells - 1)
    only = F.array(F.struct(near(box["y"], box["height"], dy, rows).alias("y"), near(box["x"], box["width"], dx, cols).alias("x")))
    return F.when(F.size(grid) > 0, grid).otherwise(only)


def heat(cells: Column) -> Column:
    return F.transform(cells, lambda c: sigmoid(c.cast("double")))


def heatmaps(items: DataFrame, tags: DataFrame) -> DataFrame:
    """(item, label, values): for each cell of (item, cells) how much it speaks for each tag of (label, v); the tags go to the items block by block."""
    from tessera.operators.scoring import _blocks

    schema = T.StructType([items.schema["item"], tags.schema["label"], T.StructField("values", T.ArrayType(T.DoubleType()))])

    def shown(labels: list, table: np.ndarray):
        def of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for item, cells in zip(batch["item"], batch["cells"], strict=True):
                    values = 1 / (1 + np.exp(-(table @ np.stack(list(cells)).astype(np.float64).T)))
                    yield pd.DataFrame({"item": [item] * len(labels), "label": labels, "values": list(values)})

        return of_batch

    out = items.sparkSession.createDataFrame([], schema)
    for labels, table in _blocks(tags, "label", "v"):
        out = out.unionByName(items.select("item", "cells").mapInPandas(shown(labels, table), schema))
    return out


def effective_threshold(values: Column, threshold: float, percentile: float) -> Column:
    low, high = F.array_min(values), F.array_max(values)
    return F.greatest(F.lit(threshold), low + F.lit(percentile) * (high - low))


def masked_mean(cells: Column, valid: Column, dim: int, floor: float | None = None) -> Column:
    """Mean of the vectors (array of arrays) where ``valid`` holds; ``floor``: the least divisor, else the plain count."""
    kept = F.filter(F.zip_with(cells, valid, lambda c, v: F.struct(c.alias("c"), v.alias("v"))), lambda s: s["v"])
    count = F.size(kept).cast("double")
    divisor = F.greatest(count, F.lit(floor)) if floor is not None else count
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.element_at(x["c"], k).cast("double")) / divisor)


def label_components(grid: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers from 1 on for 4-connected cells at or above ``threshold``, in row-major order of their first cell; 0 below."""
    hot = grid >= threshold
    out = np.zeros(grid.shape, np.int64)
    number = 0
    for seed in zip(*np.nonzero(hot), strict=True):
        if out[seed]:
            continue
        number += 1
        out[seed] = number
        border = deque([seed])
        while border:
            y, x = border.popleft()
            for cell in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                if 0 <= cell[0] < grid.shape[0] and 0 <= cell[1] < grid.shape[1] and hot[cell] and not out[cell]:
                    out[cell] = number
                    border.append(cell)
    return out


COMPONENT = "item bigint, component int, min_x int, min_y int, max_x int, max_y int, cells int, confidence double"


def components(grids: DataFrame, rows: int, cols: int, threshold: float, percentile: float) -> DataFrame:
    """Bounds, size and peak of the connected regions of each item's grid (item, values: row-major)."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, values in zip(batch["item"], batch["values"], strict=True):
                grid = np.asarray(values, np.float64).reshape(rows, cols)
                least = max(threshold, grid.min() + percentile * (grid.max() - grid.min()))
                marks = label_components(grid, least)
                for k in range(1, marks.max() + 1):
                    y, x = np.nonzero(marks == k)
                    out.append((item, k, x.min(), y.min(), x.max(), y.max(), len(x), grid[y, x].max()))
            yield pd.DataFrame(out, columns=["item", "component", "min_x", "min_y", "max_x", "max_y", "cells", "confidence"])

    return grids.select("item", "values").mapInPandas(found, COMPONENT)


def propagate(cells: DataFrame) -> DataFrame:
    """(item, y, x, component) of hot cells by least-label propagation in Spark alone; the component's name is its least y * 2**20 + x.

    The relational form of ``label_components``, for grids too large for one row.
    """
    from tessera.session import cut

    own = F.col("y").cast("long") * (1 << 20) + F.col("x")
    state = cut(cells.select("item", "y", "x", own.alias("component")))
    moves = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    while True:
        told = state.withColumn("m", F.explode(moves)).select("item", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), F.col("component").alias("near"))
        least = told.groupBy("item", "y", "x").agg(F.min("near").alias("near"))
        step = cut(state.join(least, ["item", "y", "x"]).select("item", "y", "x", "component", "near"))
        changed = step.where("near < component").limit(1).count()
        state = step.select("item", "y", "x", F.col("near").alias("component"))
        if not changed:
            return state


def to_image(found: DataFrame, rows: int, cols: int, canvas: int, box: Column, width: Column, height: Column) -> DataFrame:
    """Components as boxes in pixels of the image behind the letterbox ``box``; its bars clamp to the image's edge."""
    gx, gy = canvas / cols, canvas / rows
    sx, sy = width / box["width"], height / box["height"]
    left, top = F.col("min_x") * F.lit(gx), F.col("min_y") * F.lit(gy)
    right, bottom = F.ceil((F.col("max_x") + 1) * F.lit(gx)), F.ceil((F.col("max_y") + 1) * F.lit(gy))
    x = F.floor(clamp((left - box["x"]) * sx, 0.0, width.cast("double"))).cast("int")
    y = F.floor(clamp((top - box["y"]) * sy, 0.0, height.cast("double"))).cast("int")
    r = F.floor(clamp(F.ceil((right - box["x"]) * sx).cast("double"), 0.0, width.cast("double"))).cast("int")
    b = F.floor(clamp(F.ceil((bottom - box["y"]) * sy).cast("double"), 0.0, height.cast("double"))).cast("int")
    return found.withColumns({"x": x, "y": y, "width": r - x, "height": b - y})


