"""Preconditioning: zero-padding, random signs and an orthonormal fast transform, as columns and as numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchmeans.functions.hashing import signs
from sketchmeans.plans.params import next_power_of_two


def pad(x: Column, p: int, p2: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0.0), p2 - p)) if p2 > p else x


def sign_flip(x: Column, s: np.ndarray) -> Column:
    return F.zip_with(x, F.array(*[F.lit(float(v)) for v in s]), lambda a, b: a * b)


def fwht(x: Column, p: int) -> Column:
    """Unnormalised Walsh-Hadamard transform in natural order, p a power of two over 1: p log2 p additions."""
    if p < 2 or p & (p - 1):
        raise ValueError(f"{p} is not a power of two over 1")
    stages = F.array(*[F.lit(1 << s) for s in range(p.bit_length() - 1)])
    step = lambda y, b: F.transform(y, lambda v, j: F.when(j.bitwiseAND(b) == 0, v + F.get(y, j.bitwiseOR(b))).otherwise(F.get(y, j.bitwiseXOR(b)) - v))
    return F.aggregate(stages, x, step)


def fwht_orthonormal(x: Column, p: int) -> Column:
    return F.transform(fwht(x, p), lambda v: v / F.lit(float(np.sqrt(p))))


def hadamard_rows(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row."""
    n, p = x.shape
    y, h = x.astype(float).copy(), 1
    while h < p:
        y = y.reshape(n, p // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, p)
        h *= 2
    return y / np.sqrt(p)


def _turns(p: int) -> np.ndarray:
    return np.exp(-0.5j * np.pi * np.arange(p // 2 + 1) / p)


def _cosine_norms(p: int) -> np.ndarray:
    norms = np.full(p, np.sqrt(2 / p))
    norms[0] = np.sqrt(1 / p)
    return norms


def dct_rows(x: np.ndarray) -> np.ndarray:
    """Orthonormal DCT-II of each row by one real Fourier transform of its even entries and its odd ones turned round."""
    n, p = x.shape
    turned = _turns(p) * np.fft.rfft(np.concatenate([x[:, ::2], x[:, 1::2][:, ::-1]], axis=1), axis=1)
    y, half = np.empty((n, p)), p // 2 + 1
    y[:, :half] = turned.real
    y[:, half:] = -turned[:, 1 : p - half + 1].imag[:, ::-1]
    return y * _cosine_norms(p)


def idct_rows(y: np.ndarray) -> np.ndarray:
    """The inverse of dct_rows, which is its transpose."""
    n, p = y.shape
    y, half = y / _cosine_norms(p), p // 2 + 1
    late = np.concatenate([np.zeros((n, 1)), y[:, :0:-1]], axis=1)[:, :half]  # y[p - k], and 0 for k = 0
    v = np.fft.irfft((y[:, :half] - 1j * late) / _turns(p), p, axis=1)
    x, even = np.empty((n, p)), (p + 1) // 2
    x[:, ::2], x[:, 1::2] = v[:, :even], v[:, even:][:, ::-1]
    return x


def rows_udf(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A function of matrices of row vectors as a vectorised column function."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(f(np.stack([np.asarray(v, float) for v in x]))))

    return run


def map_rows(df: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, x) with f over the matrix of each batch's vectors."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            if batch.num_rows:
                y = f(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(y).ravel()))], ["id", "x"])

    return df.select("id", "x").mapInArrow(run, "id long, x array<double>")


class Transform:
    """mix = H D pad, unmix = first p of D H'; kinds hadamard, dct, none, or a pair of functions on row matrices."""

    def __init__(self, kind: str | tuple[Callable, Callable], p: int, seed: int = 0, sign_kind: str = "random"):
        self.kind, self.p = kind, p
        self.p2 = next_power_of_two(p) if kind == "hadamard" else p
        self.signs = signs(self.p2, seed, sign_kind)
        if not isinstance(kind, str):
            probe = np.asarray(kind[0](np.zeros((1, p))))
            self.p2 = probe.shape[1]

    def forward(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "none":
            return x
        if self.kind == "hadamard":
            return hadamard_rows(np.pad(x, ((0, 0), (0, self.p2 - self.p))) * self.signs)
        if self.kind == "dct":
            return dct_rows(x * self.signs)
        return np.asarray(self.kind[0](x * self.signs[: self.p]), float)

    def adjoint(self, y: np.ndarray) -> np.ndarray:
        if self.kind == "none":
            return y
        if self.kind == "hadamard":
            return (hadamard_rows(y) * self.signs)[:, : self.p]
        if self.kind == "dct":
            return idct_rows(y) * self.signs
        return np.asarray(self.kind[1](y), float) * self.signs[: self.p]

    def column(self, x: Column) -> Column:
        """The mixed vector; Hadamard up to 256 entries stays in the JVM, the rest goes through Arrow."""
        if self.kind == "none":
            return x
        if self.kind == "hadamard" and self.p2 <= 256:
            return fwht_orthonormal(sign_flip(pad(x, self.p, self.p2), self.signs), self.p2)
        return rows_udf(self.forward)(x)
