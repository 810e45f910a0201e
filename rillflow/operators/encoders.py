"""Encoders that Spark's own functions don't express: a small network, and an ONNX session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Network:
    """Linear, batch norm and ReLU, a few times, then Linear and L2. Batch norm is folded into the layer before it."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.layers = [(w.astype(np.float32), b.astype(np.float32)) for w, b in layers]

    @classmethod
    def folded(cls, layers: list[dict]) -> Network:
        """From layers with weight, bias and, but for the last, gamma, beta, mean, var (eps 1e-5)."""
        out = []
        for x in layers:
            w, b = x["weight"], x["bias"]
            if "gamma" in x:
                k = x["gamma"] / np.sqrt(x["var"] + 1e-5)
                w, b = w * k[:, None], (b - x["mean"]) * k + x["beta"]
            out.append((w, b))
        return cls(out)

    @classmethod
    def seeded(cls, dims: tuple[int, ...] = (20, 256, 128, 64, 32), seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        return cls([(rng.standard_normal((b, a)) / np.sqrt(a), np.zeros(b)) for a, b in zip(dims, dims[1:], strict=False)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w.T + b
            if i + 1 < len(self.layers):
                x = np.maximum(x, 0)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def encode_mlp(flows: DataFrame, network: Network, column: str = "z") -> DataFrame:
    """``flows`` with v, the network's embedding of an array of numbers. The weights are a few hundred kB."""
    shipped = flows.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("array<float>")
    def run(z: pd.Series) -> pd.Series:
        return pd.Series(list(shipped.value(np.stack(z.to_list()).astype(np.float32)))) if len(z) else pd.Series([], dtype=object)

    return flows.withColumn("v", run(F.col(column)))


def onnx_encoder(flows: DataFrame, path: str) -> Column:
    """A function of an array column: the first output of a model file, with one session per worker."""
    context, name = flows.sparkSession.sparkContext, path.rsplit("/", 1)[-1]
    context.addFile(path)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime

        session = onnxruntime.InferenceSession(SparkFiles.get(name), providers=["CPUExecutionProvider"])
        entry = session.get_inputs()[0].name
        for z in batches:
            yield pd.Series(list(session.run(None, {entry: np.stack(z.to_list()).astype(np.float32)})[0])) if len(z) else pd.Series([], dtype=object)

    return run
