"""Sampling a fixed number of coordinates of each vector, and the sketch as a whole: one narrow pass, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchmeans.functions.hashing import bits32
from sketchmeans.functions.transforms import Transform
from sketchmeans.plans.clock import Clock
from sketchmeans.plans.params import SketchShape

#: Widths up to this are sampled by column functions; wider vectors by numpy over Arrow batches.
WIDE = 256
SKETCH = "id long, idx array<int>, val array<double>"


def sample_indices(id_col: Column, p2: int, m: int, seed: int, hashing: str = "md5") -> Column:
    """m of the p2 places, those with the smallest hashes for this id, in ascending order."""
    if not 0 < m <= p2:
        raise ValueError(f"can't take {m} of {p2} places")
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(p2 - 1)), lambda j: F.struct(bits32(hashing, F.lit(seed), F.lit("mask"), id_col, j).alias("h"), j.alias("j"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, m), lambda s: s["j"]))


def sketch(vectors: DataFrame, transform: Transform, shape: SketchShape, seed: int = 0, hashing: str = "xxhash64", carry: tuple[str, ...] = (), clock: Clock | None = None) -> DataFrame:
    """(id, idx, val): the mixed vectors' sampled coordinates, unscaled, with their places; and the columns `carry`."""
    if hashing == "xxhash64" and shape.p2 > WIDE:
        return _sketch_wide(vectors, transform, shape, seed, carry, clock or Clock())
    mixed = vectors.select("id", transform.column(F.col("x")).alias("y"), *carry)
    placed = mixed.select("id", "y", sample_indices(F.col("id"), shape.p2, shape.m, seed, hashing).alias("idx"), *carry)
    return placed.select("id", "idx", F.transform("idx", lambda j: F.get(F.col("y"), j)).alias("val"), *carry)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sketch_wide(vectors: DataFrame, transform: Transform, shape: SketchShape, seed: int, carry: tuple[str, ...], clock: Clock) -> DataFrame:
    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        # Floyd's draw: step by step a hashed place among the first j + 1, or j itself if that one is taken. Where more than
        # half of the places are kept, those to leave out are drawn.
        few = min(shape.m, shape.p2 - shape.m)
        steps = np.arange(shape.p2 - few, shape.p2)
        salts = _mix(steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

        def draw(column, n: int) -> np.ndarray:
            ids = column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, row = _mix(ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), np.arange(n)
            drawn = np.zeros((n, shape.p2), bool)
            for j, salt in zip(steps.tolist(), salts, strict=True):
                at = (_mix(keys ^ salt) % np.uint64(j + 1)).astype(np.int64)
                at[drawn[row, at]] = j
                drawn[row, at] = True
            return np.nonzero(drawn if few == shape.m else ~drawn)[1].reshape(n, shape.m)

        for batch in clock.reading(it, "read"):
            n = batch.num_rows
            if not n:
                continue
            with clock.of("mix"):
                y = transform.forward(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, shape.p))
            with clock.of("sample"):
                idx = draw(batch.column(0), n)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * shape.m)
            cols = [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(idx.ravel().astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(np.take_along_axis(y, idx, axis=1).ravel()))]
            yield pa.RecordBatch.from_arrays([*cols, *[batch.column(2 + i) for i in range(len(carry))]], ["id", "idx", "val", *carry])

    schema = vectors.selectExpr("id", "cast(null as array<int>) idx", "cast(null as array<double>) val", *carry).schema
    return vectors.select("id", F.col("x").alias("mixed"), *carry).mapInArrow(run, schema)


def from_zeros(vectors: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A sketch whose mask is the entries that aren't zero, for sources in which zero means missing."""
    idx = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda j: F.get(F.col("x"), j) != 0)
    return vectors.select("id", idx.alias("idx"), F.filter("x", lambda v: v != 0).alias("val"), *carry)


def sketch_density(sketched: DataFrame, p2: int) -> DataFrame:
    return sketched.agg((F.sum(F.size("idx")) / (F.count(F.lit(1)) * F.lit(float(p2)))).alias("density"))


def value_range(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.min(F.array_min(column)).alias("least"), F.max(F.array_max(column)).alias("most"))
