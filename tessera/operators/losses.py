"""Contrastive, localised and consistency losses, label matrices, validation means."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.vectors import cosine, dot, log_sum_exp, softplus


#: Tags of the vocabulary that are sent to the tasks at once.
TAGS_AT_ONCE = 50_000


def label_matrix(bags: DataFrame, tags: DataFrame) -> DataFrame:
    """(item, tag, y): y is 1 for the item's own tags and -1 for all others of ``tags``.

    The dense matrix is what is asked for. An item's tags are brought together once; its row is then made beside the
    vocabulary, which goes to the tasks as one row of at most ``TAGS_AT_ONCE`` names at a time.
    """
    held = bags.groupBy("item").agg(F.collect_set("tag").alias("own")).withColumn("k", F.lit(0))
    kind = tags.schema["tag"].dataType.simpleString()
    names = (r["tag"] for r in tags.select("tag").distinct().orderBy("tag").toLocalIterator())
    out = None
    while block := list(islice(names, TAGS_AT_ONCE)):
        row = bags.sparkSession.createDataFrame([(0, block)], f"k int, every array<{kind}>")
        wide = held.join(F.broadcast(row), "k").select("item", "own", F.explode("every").alias("tag"))
        part = wide.select("item", "tag", F.when(F.array_contains("own", F.col("tag")), 1).otherwise(-1).alias("y"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else bags.select("item", "tag", F.lit(1).alias("y")).limit(0)


def contrastive(logits: DataFrame, logit: str = "logit", y: str = "y") -> DataFrame:
    """One row: the mean of softplus(-y * logit) over all item-tag pairs."""
    return logits.agg(F.avg(softplus(-F.col(y) * F.col(logit))).alias("loss"))


def pooled_logit(cells: Column, temperature: float) -> Column:
    """Log-mean-exp of an array of logits at a temperature: close to the maximum when it is low, to the mean when it is high."""
    scaled = F.transform(cells, lambda c: c.cast("double") / temperature)
    return F.lit(temperature) * (log_sum_exp(scaled) - F.log(F.size(cells).cast("double")))


def localized(maps: DataFrame, temperature: float, cells: str = "cells", y: str = "y") -> DataFrame:
    """One row: the mean contrastive loss of logits pooled over the valid cells (those that the array still has)."""
    return maps.agg(F.avg(softplus(-F.col(y) * pooled_logit(F.col(cells), temperature))).alias("loss"))


def cell_logits(cells: Column, tag: Column) -> Column:
    return F.transform(cells, lambda c: dot(c, tag))


def consistency(pairs: DataFrame, a: str = "a", prediction_a: str = "pa", b: str = "b", prediction_b: str = "pb") -> DataFrame:
    """One row: the symmetric negative cosine of each view's prediction and the other view's vector."""
    one, two = cosine(F.col(prediction_a), F.col(b)), cosine(F.col(prediction_b), F.col(a))
    return pairs.agg((-(F.avg(one) + F.avg(two)) / 2).alias("loss"))


def validation_loss(batches: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    """One row: batch means weighed by batch size."""
    return batches.agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def guard_finite(df: DataFrame, value: str) -> DataFrame:
    """``df``; a value that is no number ends the run."""
    bad = F.isnan(F.col(value)) | F.col(value).isNull()
    return df.withColumn(value, F.when(bad, F.raise_error(F.lit("the loss is not a number")).cast("double")).otherwise(F.col(value)))
