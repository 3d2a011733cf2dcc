"""Tensor arithmetic on array columns: the building blocks of the encoder, and the block quantizers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32
#: Parts of a histogram of codes, and the least and largest code of each block format.
BINS = 16
CODES = {"q4_0": (0, 15), "q4_1": (0, 15), "q5_0": (0, 31), "q5_1": (0, 31), "q8_0": (-127, 127)}


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once per row also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def layer_norm(v: Column, eps: float = 1e-12) -> Column:
    """(x - mean) / sqrt(population variance + eps)."""
    def scaled(spread: Column) -> Column:
        return let(F.sqrt(dot(spread, spread) / F.size(spread) + eps), lambda sd: F.transform(spread, lambda x: x / sd))

    return let(mean(v), lambda m: let(F.transform(v, lambda x: x - m), scaled))


def pooled(rows: DataFrame, *keys: str, x: str = "x") -> DataFrame:
    """(keys, avg_pool, max_pool) of long rows: the mean and the maximum of a text's states in each dimension, a relation's form of the pools."""
    return rows.groupBy(*keys).agg(F.avg(x).alias("avg_pool"), F.max(x).alias("max_pool"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column) -> Column:
    """The Euclidean distance of two vectors; null if their lengths differ."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def softmax(v: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(total(e), lambda t: F.transform(e, lambda x: x / t))

    return let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), shares))


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(0.7978845608 * (x + 0.044715 * x * x * x)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def resolve_layer(layer: int, n: int) -> int:
    """0 the embeddings, 1 to n a layer's output, -1 the last, -n the first; others are errors."""
    out = layer + n + 1 if layer < 0 else layer
    if not 0 <= out <= n or (layer < 0 and out == 0):
        raise ValueError(f"output layer {layer} of {n}")
    return out


# Fixed values: (bits per weight, scale divisor of the largest magnitude, offset, levels) of block formats are in the code
# of each format below; a block has 32 values and 16-bit scales.
def quantize_blocks(x: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, minimum, codes) of rows of 32 values."""
    x = np.asarray(x, np.float32).reshape(-1, BLOCK)
    at = np.abs(x).argmax(1)
    extreme = x[np.arange(len(x)), at]
    low, high = x.min(1), x.max(1)
    zero = np.zeros(len(x), np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "q8_0":
            d = np.abs(extreme) / 127
            q = np.sign(x) * np.floor(np.abs(np.where(d[:, None] > 0, x / d[:, None], 0)) + 0.5)
            return d, zero, q.astype(np.int16)
        if kind in ("q4_0", "q5_0"):
            half = 8 if kind == "q4_0" else 16
            d = extreme / -half
            q = np.minimum(2 * half - 1, np.floor(np.where(d[:, None] != 0, x / d[:, None], 0) + half + 0.5))
            return d, -half * d, q.astype(np.int16)
        if kind in ("q4_1", "q5_1"):
            top = 15 if kind == "q4_1" else 31
            d = (high - low) / top
            q = np.minimum(top, np.floor(np.where(d[:, None] > 0, (x - low[:, None]) / d[:, None], 0) + 0.5))
            return d, low, q.astype(np.int16)
    raise ValueError(f"unknown block format {kind}")


def dequantize_blocks(d: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (q * d[:, None] + m[:, None]).astype(np.float32)


def histogram(codes: np.ndarray, kind: str) -> np.ndarray:
    """How many codes of a block format fall into each of BINS equal parts of the codes it can have."""
    low, high = CODES[kind]
    return np.bincount(np.minimum((np.ravel(codes).astype(np.int64) - low) * BINS // (high - low + 1), BINS - 1), minlength=BINS)


def _batch_codes(rows: pd.Series, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """(place, codes) of the arrays of a batch that aren't null, quantized together."""
    places = [i for i, x in enumerate(rows) if x is not None]
    arrays = [np.asarray(rows.iloc[i], np.float32) for i in places]
    if wrong := next((len(x) for x in arrays if len(x) % BLOCK), None):
        raise ValueError(f"an array of {wrong} values; blocks hold {BLOCK}")
    if arrays:
        codes = quantize_blocks(np.concatenate(arrays), kind)[2].ravel()
        yield from zip(places, np.split(codes, np.cumsum([len(x) for x in arrays])[:-1]))


def block_codes(v: Column, kind: str) -> Column:
    """The codes of an array of values, of a multiple of BLOCK, in a block format; null for null."""

    @F.pandas_udf("array<int>")
    def codes(rows: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        for i, q in _batch_codes(rows, kind):
            out[i] = q.astype(np.int32)
        return pd.Series(out, dtype=object)

    return codes(v)


def block_histogram(v: Column, kind: str) -> Column:
    """The histogram of the codes of an array of values; null for null."""

    @F.pandas_udf("array<long>")
    def bins(rows: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        for i, q in _batch_codes(rows, kind):
            out[i] = histogram(q, kind)
        return pd.Series(out, dtype=object)

    return bins(v)
