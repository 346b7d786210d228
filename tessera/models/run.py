"""Finished models over frames: where they run, and texts through them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Devices in order of preference.
PREFERRED = ("CUDAExecutionProvider", "CPUExecutionProvider")


def devices(available: list[str] | None = None) -> list[str]:
    """What a model runs on: the preferred ones of what there is, the processor last."""
    if available is None:
        import onnxruntime

        available = onnxruntime.get_available_providers()
    return [x for x in PREFERRED if x in available] or ["CPUExecutionProvider"]


def embed_texts(rows: DataFrame, model: bytes, encode: Callable[[str], list[int]], key: str = "tag", text: str = "text", output: str = "embedding", batch: int = 64) -> DataFrame:
    """(key, v): texts through a text encoder. ``encode`` is the caller's tokenizer; texts of a batch are padded with 0, and the
    model is told by a mask which ids count, if it asks for two inputs. A null or empty text is what the model makes of no id."""
    kind = rows.schema[key].dataType.simpleString()

    def embedded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=devices())
        names = [x.name for x in session.get_inputs()]
        for b in frames:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                ids = [encode(t or "") for t in part[text]]
                wide = np.zeros((len(ids), max(1, *map(len, ids))), np.int64)
                mask = np.zeros(wide.shape, np.float32)
                for k, own in enumerate(ids):
                    wide[k, : len(own)], mask[k, : len(own)] = own, 1
                (found,) = session.run([output], dict(zip(names, (wide, mask), strict=False)))
                yield pd.DataFrame({key: part[key], "v": [x.tolist() for x in found]})

    return rows.select(key, text).mapInPandas(embedded, f"`{key}` {kind}, v array<float>")
