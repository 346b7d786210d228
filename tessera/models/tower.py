"""The image tower: a patch stem, stages of residual blocks with a 7x7 depthwise convolution each, and a projection.

The network is said once, in ``tower``, over a handful of operations. Over arrays it is evaluated; over a graph the same words write
an ONNX model of primitive operations, with outputs ``spatial_features`` and ``pooled``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tessera.models.graph import Graph

EPSILON = 1e-3
#: What a new block's branch counts for: next to nothing, so that a new tower is nearly its stem.
FIRST_SCALE = 1e-6


@dataclass(frozen=True)
class Config:
    dim: int = 512
    stem: int = 64
    patch: int = 4
    channels: tuple[int, ...] = (64, 128, 256)
    blocks: tuple[int, ...] = (2, 2, 2)


def new_weights(config: Config = Config(), seed: int = 0) -> dict[str, np.ndarray]:
    """Random weights by name: kernels uniform within the inverse root of their fan-in."""
    rng, out = np.random.default_rng(seed), {}

    def kernel(name: str, to: int, of: int, size: int) -> None:
        bound = 1 / math.sqrt(of * size * size)
        out[f"{name}.w"] = rng.uniform(-bound, bound, (to, of, size, size)).astype(np.float32)
        out[f"{name}.b"] = rng.uniform(-bound, bound, to).astype(np.float32)

    def norm(name: str, n: int) -> None:
        out[f"{name}.scale"], out[f"{name}.shift"] = np.ones(n, np.float32), np.zeros(n, np.float32)

    kernel("stem", config.stem, 3, config.patch)
    norm("stem.norm", config.stem)
    now = config.stem
    for s, (n, many) in enumerate(zip(config.channels, config.blocks, strict=True)):
        if n != now:
            norm(f"{s}.down.norm", now)
            kernel(f"{s}.down", n, now, 2)
            now = n
        for k in range(many):
            kernel(f"{s}.{k}.deep", n, 1, 7)
            norm(f"{s}.{k}.norm", n)
            kernel(f"{s}.{k}.wide", 4 * n, n, 1)
            kernel(f"{s}.{k}.back", n, 4 * n, 1)
            out[f"{s}.{k}.part"] = np.full(n, FIRST_SCALE, np.float32)
    kernel("projection", config.dim, now, 1)
    return out


def tower(ops, x, w: dict[str, np.ndarray], config: Config):
    """The spatial features of ``x`` and their mean over all places, in terms of ``ops``."""

    def conv(x, name, **how):
        return ops.conv(x, w[f"{name}.w"], w[f"{name}.b"], **how)

    def norm(x, name):
        return ops.normed(x, w[f"{name}.scale"], w[f"{name}.shift"])

    x = norm(conv(x, "stem", stride=config.patch), "stem.norm")
    now = config.stem
    for s, (n, many) in enumerate(zip(config.channels, config.blocks, strict=True)):
        if n != now:
            x = conv(norm(x, f"{s}.down.norm"), f"{s}.down", stride=2)
            now = n
        for k in range(many):
            name = f"{s}.{k}"
            branch = norm(conv(x, f"{name}.deep", pad=3, groups=n), f"{name}.norm")
            branch = conv(ops.gelu(conv(branch, f"{name}.wide")), f"{name}.back")
            x = ops.plus(x, ops.scaled(branch, w[f"{name}.part"]))
    spatial = conv(x, "projection")
    return spatial, ops.mean(spatial)


class OnArrays:
    """The operations on (n, channels, height, width) arrays."""

    @staticmethod
    def conv(x, w, b, stride=1, pad=0, groups=1):
        x = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
        seen = np.lib.stride_tricks.sliding_window_view(x, w.shape[2:], axis=(2, 3))[:, :, ::stride, ::stride]
        out = np.einsum("nchwij,cij->nchw", seen, w[:, 0]) if groups > 1 else np.einsum("nchwij,ocij->nohw", seen, w, optimize=True)
        return out + b[:, None, None]

    @staticmethod
    def normed(x, scale, shift):
        away = x - x.mean(axis=(1, 2, 3), keepdims=True)
        return away / np.sqrt((away**2).mean(axis=(1, 2, 3), keepdims=True) + EPSILON) * scale[:, None, None] + shift[:, None, None]

    @staticmethod
    def gelu(x):
        return 0.5 * x * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))

    @staticmethod
    def scaled(x, part):
        return x * part[:, None, None]

    @staticmethod
    def plus(x, y):
        return x + y

    @staticmethod
    def mean(x):
        return x.mean(axis=(2, 3))


class OnGraph:
    """The same operations as nodes of a graph."""

    def __init__(self, graph: Graph) -> None:
        self.g = graph

    def conv(self, x, w, b, stride=1, pad=0, groups=1):
        return self.g.node("Conv", x, self.g.constant(w), self.g.constant(b), kernel_shape=list(w.shape[2:]), strides=[stride] * 2, pads=[pad] * 4, group=groups)

    def _wide(self, values):
        return self.g.constant(np.asarray(values, np.float32).reshape(1, -1, 1, 1))

    def normed(self, x, scale, shift):
        g = self.g
        away = g.node("Sub", x, g.node("ReduceMean", x, axes=[1, 2, 3], keepdims=1))
        spread = g.node("ReduceMean", g.node("Mul", away, away), axes=[1, 2, 3], keepdims=1)
        plain = g.node("Div", away, g.node("Sqrt", g.node("Add", spread, g.constant(EPSILON))))
        return g.node("Add", g.node("Mul", plain, self._wide(scale)), self._wide(shift))

    def gelu(self, x):
        g = self.g
        erf = g.node("Erf", g.node("Mul", x, g.constant(1 / math.sqrt(2))))
        return g.node("Mul", g.node("Mul", x, g.constant(0.5)), g.node("Add", erf, g.constant(1.0)))

    def scaled(self, x, part):
        return self.g.node("Mul", x, self._wide(part))

    def plus(self, x, y):
        return self.g.node("Add", x, y)

    def mean(self, x):
        return self.g.node("Flatten", self.g.node("GlobalAveragePool", x), axis=1)


def evaluate(images: np.ndarray, weights: dict[str, np.ndarray], config: Config = Config()) -> tuple[np.ndarray, np.ndarray]:
    return tower(OnArrays, images, weights, config)


def export(weights: dict[str, np.ndarray], config: Config = Config(), size: int = 224) -> bytes:
    """An ONNX model of the tower for inputs of ``size``."""
    graph = Graph("image_tower")
    spatial, pooled = tower(OnGraph(graph), graph.input("pixel_values", [1, 3, size, size]), weights, config)
    graph.output(spatial, "spatial_features")
    graph.output(pooled, "pooled", [1, config.dim])
    return graph.bytes()


def predicted(x: np.ndarray, hidden: tuple[np.ndarray, np.ndarray], output: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The prediction head: two affine maps with a ramp between them."""
    return np.maximum(x @ hidden[0].T + hidden[1], 0) @ output[0].T + output[1]
