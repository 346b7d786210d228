"""Small state files and logs that live beside the tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources.paths import Store

#: Names that are never written: a resumed run asks for its credentials again.
SECRET = ("key", "token", "password", "secret", "credential")


def save_options(path: str, options: dict) -> None:
    """Options of a run, without credentials."""
    safe = {k: v for k, v in options.items() if not any(x in k.lower() for x in SECRET)}
    Store().write(path, json.dumps(safe, indent=1, sort_keys=True).encode())


def load_options(path: str) -> dict | None:
    store = Store()
    return json.loads(store.read(path)) if store.exists(path) else None


@dataclass
class TrainingState:
    """Where a training run is; enough to go on with the same patience window."""

    epochs_done: int = 0
    best_loss: float | None = None
    waited: int = 0
    losses: list[float] = field(default_factory=list)

    def save(self, path: str) -> None:
        save_options(path, asdict(self))

    @classmethod
    def load(cls, path: str) -> TrainingState:
        return cls(**(load_options(path) or {}))


def log_errors(errors: DataFrame, path: str) -> None:
    """Appends (site, message) with the time to a log table."""
    errors.select(F.current_timestamp().alias("at"), "site", "message").write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(F.format_string("%s [%s] %s", F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "site", "message").alias("line"))
