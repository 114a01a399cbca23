"""ONNX files of dense networks, written without the onnx package: for models whose weights are at hand as arrays.

Only the few message fields that a chain of matrix products, biases and rectifiers needs are written, in the wire format
of protocol buffers: a tag (field number and kind), then a varint or a length and bytes.
"""

from __future__ import annotations

import numpy as np

_FLOAT, _INT8, _HALF = 1, 3, 10
_RAW = {_FLOAT: "<f4", _INT8: "<i1", _HALF: "<f2"}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _node(kind: str, inputs: list[str], output: str, **whole: int) -> bytes:
    attributes = b"".join(_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in whole.items())
    return b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(3, output) + _field(4, kind) + attributes


def _tensor(name: str, x: np.ndarray, kind: int = _FLOAT) -> bytes:
    return b"".join(_field(1, int(d)) for d in x.shape) + _field(2, kind) + _field(8, name) + _field(9, x.astype(_RAW[kind]).tobytes())


def _value(name: str, width: int) -> bytes:
    shape = _field(1, _field(2, "n")) + _field(1, _field(1, width))
    return _field(1, name) + _field(2, _field(1, _field(1, _FLOAT) + _field(2, shape)))


def dense_network(layers: list[tuple[np.ndarray, np.ndarray]], weights: str = "float") -> bytes:
    """A model file: input x (rows, width), each layer a product with its weights (in, out) plus its bias, rectified but for
    the last one; output y. Weights are kept as "float", "half", or "int8" with a scale for each layer."""
    nodes, tensors, last = [], [], "x"
    for i, (w, b) in enumerate(layers):
        tensors.append(_tensor(f"b{i}", b))
        if weights == "int8":
            scale = max(float(np.abs(w).max(initial=0)), 1e-30) / 127
            tensors += [_tensor(f"q{i}", np.round(w / scale), _INT8), _tensor(f"s{i}_scale", np.array(scale))]
            nodes.append(_node("DequantizeLinear", [f"q{i}", f"s{i}_scale"], f"w{i}"))
        elif weights == "half":
            tensors.append(_tensor(f"h{i}", w, _HALF))
            nodes.append(_node("Cast", [f"h{i}"], f"w{i}", to=_FLOAT))
        else:
            tensors.append(_tensor(f"w{i}", w))
        final = i == len(layers) - 1
        nodes += [_node("MatMul", [last, f"w{i}"], f"m{i}"), _node("Add", [f"m{i}", f"b{i}"], "y" if final else f"s{i}")]
        if not final:
            nodes.append(_node("Relu", [f"s{i}"], f"r{i}"))
            last = f"r{i}"
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "dense") + b"".join(_field(5, t) for t in tensors) + _field(11, _value("x", layers[0][0].shape[0])) + _field(12, _value("y", layers[-1][0].shape[1]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def export(layers: list[tuple[np.ndarray, np.ndarray]], sample: np.ndarray, drop: float = 0.05) -> tuple[str, bytes]:
    """The smallest file whose outputs over sample rows are off by at most `drop` of their spread: int8, half or float."""
    import onnxruntime

    def run(model: bytes) -> np.ndarray:
        return onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]).run(None, {"x": sample.astype(np.float32)})[0]

    want, top = run(dense_network(layers)), max(float(np.abs(w).max(initial=0)) for w, _ in layers)
    for kind in ("int8", *(["half"] if top <= float(np.finfo(np.float16).max) else [])):
        small = dense_network(layers, kind)
        if np.abs(run(small) - want).mean() <= drop * max(float(want.std()), 1e-30):
            return kind, small
    return "float", dense_network(layers)
