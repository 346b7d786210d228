"""Fitting embedding rows with the item side fixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.prefix import dense_number
from tessera.operators.store import Parts, Table
from tessera.session import cut


def fit_tag(items: DataFrame, steps: int = 200, rate: float = 0.05, patience: int = 5, min_delta: float = 1e-4, start: list[float] | None = None, vector: str = "v", y: str = "y") -> tuple[list[float], list[float]]:
    """An embedding for one tag: the row that minimises the mean contrastive loss of items (v, y in -1, 1), and the losses on the way.

    Every step sends one row to the tasks and brings one gradient back, summed over all items; the items are not collected.
    """
    dim = items.select(F.size(vector)).first()[0]
    row = np.array(start if start is not None else np.random.default_rng(0).uniform(-0.02, 0.02, dim))
    first, second, losses, best, waited = np.zeros(dim), np.zeros(dim), [], np.inf, 0
    for t in range(1, steps + 1):
        loss, grad = loss_and_gradient(items, row, vector, y)
        losses.append(loss)
        if loss < best - min_delta:
            best, waited = loss, 0
        else:
            waited += 1
            if waited >= patience:
                break
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        row = row - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return row.tolist(), losses


def loss_and_gradient(items: DataFrame, row: np.ndarray, vector: str = "v", y: str = "y") -> tuple[float, np.ndarray]:
    import pyarrow as pa

    def summed(batches):
        total, loss, n = np.zeros(len(row)), 0.0, 0
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(row))
            s = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            z = s * (x @ row)
            loss += float(np.logaddexp(0, -z).sum())
            total += (-(s / (1 + np.exp(z)))[:, None] * x).sum(axis=0)
            n += len(s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([loss]), pa.array([n], pa.int64())], names=["g", "loss", "n"])

    parts = items.select(vector, y).mapInArrow(summed, "g array<double>, loss double, n long")
    whole = parts.select(F.posexplode("g").alias("k", "x"), "loss", "n").groupBy("k").agg(F.sum("x").alias("x"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).orderBy("k").collect()
    n = max(1, whole[0]["n"])
    return whole[0]["loss"] / n, np.array([r["x"] for r in whole]) / n


#: Numbers of a block of rows that is sent to the tasks at once.
BLOCK_VALUES = 4_000_000


def _gradients(first: int, table: np.ndarray):
    """For a block of rows: their summed gradients over a task's training items, and the summed losses of training and validation items."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, losses, counts = np.zeros(table.shape), np.zeros((2, len(table))), np.zeros(2, np.int64)
        for b in frames:
            x = np.stack(list(b["v"])).astype(np.float64)
            y = np.full((len(b), len(table)), -1.0)
            for i, own in enumerate(b["rows"]):
                own = np.asarray(own, np.int64) - first
                y[i, own[(own >= 0) & (own < len(table))]] = 1
            z = y * (x @ table.T)
            held = b["validation"].to_numpy(bool)
            for k, part in enumerate((~held, held)):
                losses[k] += np.logaddexp(0, -z[part]).sum(axis=0)
                counts[k] += part.sum()
            total += (-y / (1 + np.exp(z)))[~held].T @ x[~held]
        yield pd.DataFrame({"row_index": range(first, first + len(table)), "g": list(total), "loss": losses[0], "held_loss": losses[1], "n": counts[0], "held_n": counts[1]})

    return summed


class RowTraining:
    """Embedding rows of all tags fitted to frozen item vectors, epoch by epoch, in versions under ``folder``.

    An epoch is one pass over the items for each block of rows, one step of Adam for every row, and the losses before that step.
    Version k of ``rows`` (row_index, w, first, second) is what k epochs have made of them, so a run that died goes on behind its
    last whole epoch, with the same patience: that is worked out from the stored losses.
    """

    def __init__(self, spark: SparkSession, folder: str, rate: float = 0.05, patience: int = 3, min_delta: float = 1e-4) -> None:
        self.rows, self.losses = Table(spark, f"{folder}/rows"), Parts(spark, f"{folder}/losses")
        self.rate, self.patience, self.min_delta = rate, patience, min_delta

    def start(self, rows: DataFrame) -> None:
        """``rows`` (row_index, v) are where training begins, unless it has begun."""
        zeros = F.transform("w", lambda _: F.lit(0.0))
        self.rows.commit(rows.select("row_index", F.col("v").cast("array<double>").alias("w")).withColumns({"first": zeros, "second": zeros}), 0)

    def stopped(self) -> bool:
        """Whether validation has not improved for ``patience`` epochs; a loss that is no number is an error."""
        best, waited = float("inf"), 0
        said = self.losses.read()
        for r in said.orderBy("epoch").collect() if said is not None else []:  # a row an epoch
            if not (r["loss"] == r["loss"] and r["held_loss"] == r["held_loss"]):
                raise ValueError(f"the loss of epoch {r['epoch']} is no number")
            if not r["held_n"]:
                return False  # nothing is held out, so nothing can be said
            best, waited = (r["held_loss"], 0) if r["held_loss"] < best - self.min_delta else (best, waited + 1)
        return waited >= self.patience

    def run(self, items: DataFrame, epochs: int) -> DataFrame:
        """(row_index, v) after ``epochs`` epochs or fewer; ``items`` has (v, rows, validation), ``rows`` an item's own row numbers."""
        items = cut(items.select("v", "rows", "validation"))
        while (done := self.rows.version()) < epochs and not self.stopped():
            self._epoch(items, done)
        return self.rows.read().select("row_index", F.col("w").alias("v"))

    def _epoch(self, items: DataFrame, done: int) -> None:
        now, parts, held = self.rows.read(done), None, []
        schema = "row_index long, g array<double>, loss double, held_loss double, n long, held_n long"

        def add(block: list) -> None:
            nonlocal parts
            part = items.mapInPandas(_gradients(block[0]["row_index"], np.array([r["w"] for r in block])), schema)
            parts = part if parts is None else parts.unionByName(part)

        for r in now.select("row_index", "w").orderBy("row_index").toLocalIterator():
            held.append(r)
            if len(held) * len(r["w"]) >= BLOCK_VALUES:
                add(held)
                held = []
        if held:
            add(held)

        def whole(own: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"row_index": [own["row_index"].iloc[0]], "g": [np.sum(np.stack(list(own["g"])), axis=0)], **{c: [own[c].sum()] for c in ("loss", "held_loss", "n", "held_n")}})

        sums = cut(parts.groupBy("row_index").applyInPandas(whole, schema))
        tags, rate = now.count(), self.rate

        def stepped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in frames:
                g = np.stack(list(b["g"])) / (b["n"].to_numpy()[:, None].clip(1) * tags)
                w, m, v = (np.stack(list(b[c])) for c in ("w", "first", "second"))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
                w = w - rate * (m / (1 - 0.9 ** (done + 1))) / (np.sqrt(v / (1 - 0.999 ** (done + 1))) + 1e-8)
                yield pd.DataFrame({"row_index": b["row_index"], "w": list(w), "first": list(m), "second": list(v)})

        mean = lambda loss, n: (F.sum(loss) / F.greatest(F.sum(n), F.lit(1))).alias(loss)
        self.losses.commit(sums.agg(mean("loss", "n"), mean("held_loss", "held_n"), F.sum("held_n").alias("held_n")).withColumn("epoch", F.lit(done)), done)
        after = now.join(sums, "row_index").mapInPandas(stepped, "row_index long, w array<double>, first array<double>, second array<double>")
        self.rows.commit(after, done + 1)


def shuffled(rows: DataFrame, key: str, size: int, seed: str = "0") -> DataFrame:
    """``rows`` dealt to batches: (batch, row) by the order of a hash of seed and key, the last batch may be smaller."""
    digest = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    marked = rows.withColumn("_h", digest).withColumn("_k", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    placed = dense_number(marked, "_k", "_h", key, into="_place").drop("_h", "_k")
    return placed.withColumns({"batch": F.expr(f"_place div {size}"), "row": F.col("_place") % size}).drop("_place")


def batches(stored: DataFrame, size: int, canvas: int, seed: str = "0") -> DataFrame:
    """(batch, row, row_index, values): stored pictures (row_index, x, y, width, height, pixels) in a shuffled order, each as the encoder's input."""
    from tessera.operators.images import reconstruct

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            values = [reconstruct(r.pixels, (r.x, r.y, r.width, r.height), canvas).reshape(-1) for r in b.itertuples(index=False)]
            yield pd.DataFrame({"batch": b["batch"], "row": b["row"], "row_index": b["row_index"], "values": values})

    dealt = shuffled(stored, "row_index", size, seed).select("batch", "row", "row_index", "x", "y", "width", "height", "pixels")
    return dealt.mapInPandas(made, "batch long, row long, row_index long, values array<float>")


def resume_guard(stored_size: int, size: int, done: int, epochs: int) -> bool:
    """Whether there is anything to do; another vocabulary than the checkpoint's is an error."""
    if stored_size != size:
        raise ValueError("the checkpoint has another vocabulary")
    return done < epochs
