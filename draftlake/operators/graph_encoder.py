"""Forward pass of a graph encoder with given weights: message passing, normalisation, pooling and readout.

A graph is a row: its node features and edges are arrays, as contracts hold them, so
graphs are encoded where they are read, in Arrow batches, and nothing is shuffled. The
weights are a parameter of bounded size and are broadcast. Training isn't part of this.

Edge cases: null or empty features are one node of zeros; edges to nodes that don't exist are ignored; a zero
embedding stays zero; rows without an id are encoded like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Layer:
    """own and other are (in, out); ``other`` weighs the neighbours' mean (sage) and is None for a normalised sum (gcn)."""

    own: np.ndarray
    other: np.ndarray | None
    bias: np.ndarray
    gain: np.ndarray
    shift: np.ndarray


@dataclass
class Readout:
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def seeded_weights(n_in: int, n_hidden: int = 32, n_out: int = 16, n_layers: int = 3, gcn: bool = False, seed: int = 42) -> tuple[list[Layer], Readout]:
    """Weights drawn from a seed, for tests and as a baseline of an untrained encoder."""
    if n_layers < 2:
        raise ValueError("an encoder has at least two layers")
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
    layers = []
    for k in range(n_layers):
        a = n_in if k == 0 else n_hidden
        layers.append(Layer(draw(a, n_hidden), None if gcn else draw(a, n_hidden), np.zeros(n_hidden), np.ones(n_hidden), np.zeros(n_hidden)))
    return layers, Readout(draw(2 * n_hidden, n_hidden), np.zeros(n_hidden), draw(n_hidden, n_out), np.zeros(n_out))


def convolve(x: np.ndarray, src: np.ndarray, dst: np.ndarray, layer: Layer) -> np.ndarray:
    n = len(x)
    if layer.other is not None:
        total = np.zeros_like(x)
        np.add.at(total, dst, x[src])
        degree = np.bincount(dst, minlength=n)[:, None]
        return x @ layer.own + (total / np.maximum(degree, 1)) @ layer.other + layer.bias
    # each node is its own neighbour too, and messages are weighed by both ends' degrees
    degree = np.bincount(dst, minlength=n) + 1.0
    share = 1 / np.sqrt(degree)
    total = x * (share**2)[:, None]
    np.add.at(total, dst, x[src] * (share[src] * share[dst])[:, None])
    return total @ layer.own + layer.bias


def normalise_layer(x: np.ndarray, gain: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(axis=1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + eps) * gain + shift


def encode(x: np.ndarray, src: np.ndarray, dst: np.ndarray, layers: list[Layer], readout: Readout) -> np.ndarray:
    """Unit embedding of one graph."""
    for layer in layers:
        x = np.maximum(normalise_layer(convolve(x, src, dst, layer), layer.gain, layer.shift), 0)
    pooled = np.concatenate([x.mean(axis=0), x.max(axis=0)])
    out = np.maximum(pooled @ readout.hidden + readout.hidden_bias, 0) @ readout.out + readout.out_bias
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def encode_graphs(graphs: DataFrame, layers: list[Layer], readout: Readout) -> DataFrame:
    """id, embedding of graphs(id, x array<array<double>>, src array<int>, dst array<int>)."""
    spread = graphs.sparkSession.sparkContext.broadcast(([vars(k) for k in layers], vars(readout)))
    n_in = layers[0].own.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = spread.value
        mine, end = [Layer(**k) for k in held], Readout(**last)
        for b in batches:
            out = []
            for x, src, dst in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                m = np.array(x if x else [[0.0] * n_in], dtype=np.float64)
                s, d = np.array(src or [], dtype=np.int64), np.array(dst or [], dtype=np.int64)
                known = (s >= 0) & (s < len(m)) & (d >= 0) & (d < len(m))
                out.append(encode(m, s[known], d[known], mine, end))
            yield pa.record_batch({"id": b.column(0), "embedding": pa.array([v.tolist() for v in out], pa.list_(pa.float64()))})

    kind = graphs.schema["id"].dataType.simpleString()
    return graphs.select("id", "x", "src", "dst").mapInArrow(run, f"id {kind}, embedding array<double>")
