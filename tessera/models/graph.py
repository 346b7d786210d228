"""A small writer of ONNX models: the protocol-buffer fields that inference graphs need, and nothing else."""

from __future__ import annotations

import struct
from itertools import count

import numpy as np

IR_VERSION, OPSET = 8, 13
_FLOAT, _INT64 = 1, 7


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _attribute(name: str, value: int | float | list[int]) -> bytes:
    if isinstance(value, float):
        return _block(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", value) + _number(20, 1)
    if isinstance(value, int):
        return _block(1, name) + _number(3, value) + _number(20, 2)
    return _block(1, name) + b"".join(_number(8, v) for v in value) + _number(20, 7)


def _tensor(name: str, values: np.ndarray) -> bytes:
    whole = values.dtype.kind == "i"
    data = np.ascontiguousarray(values, "<i8" if whole else "<f4")
    return b"".join(_number(1, n) for n in data.shape) + _number(2, _INT64 if whole else _FLOAT) + _block(8, name) + _block(9, data.tobytes())


def _value(name: str, shape: list[int | str] | None, kind: int) -> bytes:
    dims = b"" if shape is None else _block(2, b"".join(_block(1, _block(2, n) if isinstance(n, str) else _number(1, n)) for n in shape))
    return _block(1, name) + _block(2, _block(1, _number(1, kind) + dims))


class Graph:
    """A graph that grows node by node; a node's result is known by its name."""

    def __init__(self, name: str) -> None:
        self.name, self.numbers = name, count()
        self.nodes, self.constants, self.inputs, self.outputs = [], [], [], []

    def input(self, name: str, shape: list[int | str], whole: bool = False) -> str:
        self.inputs.append(_value(name, shape, _INT64 if whole else _FLOAT))
        return name

    def constant(self, values: np.ndarray | float) -> str:
        name = f"c{next(self.numbers)}"
        self.constants.append(_tensor(name, np.asarray(values, None if isinstance(values, np.ndarray) else np.float32)))
        return name

    def node(self, kind: str, *inputs: str, into: str | None = None, **attributes) -> str:
        into = into or f"v{next(self.numbers)}"
        body = b"".join(_block(1, x) for x in inputs) + _block(2, into) + _block(4, kind)
        self.nodes.append(body + b"".join(_block(5, _attribute(k, v)) for k, v in attributes.items()))
        return into

    def output(self, value: str, name: str, shape: list[int | str] | None = None) -> None:
        self.node("Identity", value, into=name)
        self.outputs.append(_value(name, shape, _FLOAT))

    def bytes(self) -> bytes:
        parts = [(1, self.nodes), (5, self.constants), (11, self.inputs), (12, self.outputs)]
        graph = _block(2, self.name) + b"".join(_block(field, x) for field, held in parts for x in held)
        return _number(1, IR_VERSION) + _block(7, graph) + _block(8, _block(1, "") + _number(2, OPSET))
