"""Image kernels in numpy, and the frames that run them batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Channel means and deviations of the encoder's input, and the colour of the bars (their rounded means).
MEAN = np.array([0.485, 0.456, 0.406], np.float32)
STD = np.array([0.229, 0.224, 0.225], np.float32)
PAD = (124, 116, 104)
LUMA = np.array([0.299, 0.587, 0.114])


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with half-pixel centres; the edge is repeated. Works on (h, w) and (h, w, channels)."""
    def axis(size: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(to) + 0.5) * (size / to) - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    extra = (1,) * (image.ndim - 2)
    fy, fx = fy.reshape(-1, 1, *extra), fx.reshape(1, -1, *extra)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def letterbox_box(width: int, height: int, canvas: int) -> tuple[int, int, int, int]:
    scale = min(canvas / width, canvas / height)
    w, h = (int(np.clip(np.round(x * scale), 1, canvas)) for x in (width, height))
    return (canvas - w) // 2, (canvas - h) // 2, w, h


def letterbox(image: np.ndarray, canvas: int) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """An RGB image on a square canvas with bars, 8 bits, and its box."""
    x, y, w, h = box = letterbox_box(image.shape[1], image.shape[0], canvas)
    out = np.empty((canvas, canvas, 3), np.uint8)
    out[:] = PAD
    out[y : y + h, x : x + w] = np.clip(np.round(resize(image.astype(np.float64), h, w)), 0, 255)
    return out, box


def normalise(pixels: np.ndarray) -> np.ndarray:
    """8-bit (h, w, 3) to the encoder's (3, h, w) floats."""
    return ((pixels.astype(np.float32) / 255 - MEAN) / STD).transpose(2, 0, 1)


def denormalise(values: np.ndarray) -> np.ndarray:
    """The encoder's floats back to 8 bits."""
    return np.clip(np.round((values.transpose(1, 2, 0) * STD + MEAN) * 255), 0, 255).astype(np.uint8)


def encode_content(image: np.ndarray, canvas: int) -> tuple[bytes, tuple[int, int, int, int]]:
    """Only what lies inside the box, as RGB bytes."""
    full, (x, y, w, h) = letterbox(image, canvas)
    return full[y : y + h, x : x + w].tobytes(), (x, y, w, h)


def reconstruct(content: bytes, box: tuple[int, int, int, int], canvas: int) -> np.ndarray:
    """The encoder's input from stored content: bars are exactly 0."""
    x, y, w, h = box
    if len(content) != w * h * 3:
        raise ValueError(f"{len(content)} bytes of content; the box asks for {w * h * 3}")
    out = np.zeros((3, canvas, canvas), np.float32)
    out[:, y : y + h, x : x + w] = normalise(np.frombuffer(content, np.uint8).reshape(h, w, 3))
    return out


def strip(values: np.ndarray, box: tuple[int, int, int, int]) -> bytes:
    """Stored content from a full input of the older layout."""
    x, y, w, h = box
    return denormalise(values[:, y : y + h, x : x + w]).tobytes()


def dct(size: int) -> np.ndarray:
    """The cosines of an unnormalised DCT-II; the transform of X is C @ X @ C.T."""
    k = np.arange(size)
    return np.cos(np.pi / size * (k[None, :] + 0.5) * k[:, None])


def transform(plane: np.ndarray, keep: int) -> np.ndarray:
    """The lowest ``keep`` x ``keep`` frequencies of a square plane, along rows and then along columns.

    Terms are added one by one in their order. A matrix product adds in an order of its own, and where two frequencies are
    equal (those of (t, u) and (u, t) can be) the last bit says which of them is above the median.
    """
    c = dct(len(plane))[:keep]
    across = np.add.accumulate(plane[:, :, None] * c.T, axis=1)[:, -1]
    return np.add.accumulate(across[:, None, :] * c.T[:, :, None], axis=0)[-1]


def grey(image: np.ndarray, size: int = 32) -> np.ndarray:
    red, green, blue = np.moveaxis(resize(image[..., :3].astype(np.float64), size, size) * LUMA, -1, 0)
    return red + green + blue


def perceptual_hash(image: np.ndarray, size: int = 32, keep: int = 8) -> int:
    """64 bits (as a signed number): whether each of the lowest frequencies is above their median, row by row, first bit highest."""
    low = transform(grey(image, size), keep).reshape(-1)
    bits = np.packbits(low > np.median(low)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def refine(heatmap: np.ndarray, guide: np.ndarray, radius: int = 4, spatial: float = 3.0, colour: float = 0.15) -> np.ndarray:
    """Joint bilateral filter of an upsampled heatmap: neighbours weigh by distance and by likeness of the guide's colour.

    Each of the window's shifts is one pass over the whole image, so cost is the window's size times the image's.
    """
    size = guide.shape[0]
    up = resize(heatmap.astype(np.float64), size, size)
    total, weights = np.zeros((size, size)), np.zeros((size, size))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            here = (slice(max(0, -dy), size - max(0, dy)), slice(max(0, -dx), size - max(0, dx)))
            there = (slice(max(0, dy), size - max(0, -dy)), slice(max(0, dx), size - max(0, -dx)))
            far = ((guide[there] - guide[here]) ** 2).sum(axis=-1)
            w = np.exp(-(dx * dx + dy * dy) / (2 * spatial**2) - far / (2 * colour**2))
            total[here] += w * up[there]
            weights[here] += w
    return total / weights


def crop_flip(values: np.ndarray, rng: np.random.Generator, least: float = 0.6) -> np.ndarray:
    """A random crop of a (channels, h, w) input, mirrored half the time, at a random place of an otherwise zero input of the same size."""
    h, w = values.shape[1:]
    scale = rng.uniform(least, 1.0)
    ch, cw = (int(np.clip(int(n * scale), 1, n)) for n in (h, w))
    (sy, ty), (sx, tx) = (rng.integers(0, n - c + 1, 2) for n, c in ((h, ch), (w, cw)))
    crop = values[:, sy : sy + ch, sx : sx + cw]
    out = np.zeros_like(values)
    out[:, ty : ty + ch, tx : tx + cw] = crop[:, :, ::-1] if rng.integers(2) else crop
    return out


def overlay(image: np.ndarray, heatmap: np.ndarray, strength: float = 0.6) -> np.ndarray:
    """A heatmap, stretched to its own range, as red over an image."""
    span = max(float(heatmap.max() - heatmap.min()), 1e-6)
    alpha = resize((heatmap - heatmap.min()) / span, *image.shape[:2])[..., None] * strength
    return np.clip(np.round(image * (1 - alpha) + np.array([255, 0, 0]) * alpha), 0, 255).astype(np.uint8)


def hash_images(images: DataFrame) -> DataFrame:
    """(item, h) of (item, width, height, pixels: RGB bytes)."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item": b["item"], "h": [perceptual_hash(np.frombuffer(p, np.uint8).reshape(h, w, 3)) for w, h, p in zip(b["width"], b["height"], b["pixels"], strict=True)]})

    return images.select("item", "width", "height", "pixels").mapInPandas(hashed, "item bigint, h bigint")


def encode_images(images: DataFrame, canvas: int = 224) -> DataFrame:
    """(item, x, y, width, height, pixels): the stored form of images."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, w, h, p in zip(b["item"], b["width"], b["height"], b["pixels"], strict=True):
                content, box = encode_content(np.frombuffer(p, np.uint8).reshape(h, w, 3), canvas)
                rows.append((item, *box, content))
            yield pd.DataFrame(rows, columns=["item", "x", "y", "width", "height", "pixels"])

    return images.select("item", "width", "height", "pixels").mapInPandas(encoded, "item bigint, x int, y int, width int, height int, pixels binary")


def run_onnx(images: DataFrame, model: bytes, canvas: int = 224, name: str = "spatial_features") -> DataFrame:
    """(item, v): stored images through an encoder, its map pooled over the cells inside the box; one session a worker."""

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        from tessera.models.run import devices

        session = onnxruntime.InferenceSession(model, providers=devices())
        for b in batches:
            out = []
            for item, x, y, w, h, p in b[["item", "x", "y", "width", "height", "pixels"]].itertuples(index=False):
                (m,) = session.run([name], {session.get_inputs()[0].name: reconstruct(p, (x, y, w, h), canvas)[None]})
                out.append((item, pool(m[0], (x, y, w, h), canvas).tolist()))
            yield pd.DataFrame(out, columns=["item", "v"])

    return images.mapInPandas(pooled, "item bigint, v array<float>")


def valid_mask(box: tuple[int, int, int, int], canvas: int, rows: int, cols: int) -> np.ndarray:
    x, y, w, h = box
    cy, cx = ((np.arange(n) + 0.5) * canvas / n for n in (rows, cols))
    out = ((cy >= y) & (cy < y + h))[:, None] & ((cx >= x) & (cx < x + w))[None, :]
    if not out.any():
        out[int(np.clip((y + h / 2) * rows // canvas, 0, rows - 1)), int(np.clip((x + w / 2) * cols // canvas, 0, cols - 1))] = True
    return out


def pool(features: np.ndarray, box: tuple[int, int, int, int], canvas: int) -> np.ndarray:
    """Mean over the valid cells of a (channels, rows, cols) map."""
    return features[:, valid_mask(box, canvas, *features.shape[1:])].mean(axis=1)
