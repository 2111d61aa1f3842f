"""Any Spark source as vectors (id, x array<double>), and what is known of it before it is read in full."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchmeans.sources.matrix import read_matrix


def read(spark: SparkSession, source: str | DataFrame, fmt: str = "parquet", partition_mb: float | None = None, samples: str = "rows") -> DataFrame:
    """A frame as it is, a path through Spark's readers; a path that doesn't exist raises AnalysisException.

    Matrix files (a path that ends in .npy, or fmt "npy") are read in partitions of at most partition_mb, whichever way
    their samples lie. Spark's own sources are split as the session says, at spark.sql.files.maxPartitionBytes; where that is more than
    partition_mb, they are read by a session of their own, with this one's settings and that one changed.
    """
    if isinstance(source, DataFrame):
        return source
    if fmt == "npy" or source.rstrip("/").endswith(".npy"):
        return read_matrix(spark, source, samples, partition_mb or 128)
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if partition_mb and partition_mb * 2**20 < most:
        own = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(key):
                own.conf.set(key, value)
        own.conf.set("spark.sql.files.maxPartitionBytes", str(int(partition_mb * 2**20)))
        spark = own
    return spark.read.format(fmt).load(source)


def vector_column(df: DataFrame) -> str:
    """The only column of numbers in arrays; ValueError if there is none or more than one."""
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]
    if len(found) != 1:
        raise ValueError(f"name the vector column: {found or 'none'} found")
    return found[0]


def scan_vectors(df: DataFrame, id_col: str = "id", x_col: str | None = None, samples: str = "rows") -> DataFrame:
    """(id bigint, x array<double>); numbers are widened before any arithmetic.

    With samples "columns", a frame (j, x[, first]) of coordinate-major rows or (j, id, v) of single cells is transposed.
    """
    if samples == "columns" and "j" in df.columns:
        return columns_as_samples(df) if "v" in df.columns else transposed(df)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(x_col or vector_column(df)).cast("array<double>").alias("x"))


def columns_as_samples(df: DataFrame, j: str = "j", id_col: str = "id", v: str = "v") -> DataFrame:
    """Long form (row j, sample id, value v) as vectors: the transpose of a matrix whose samples are columns."""
    rows = df.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(j).alias("j"), F.col(v).cast("double").alias("v")))).alias("cells"))
    # Places must be 0 to p - 1, each once; else the vector is null, which checked_shape() refuses.
    js = F.col("cells.j")
    whole = (F.array_min(js) == 0) & (F.array_max(js) == F.size(js) - 1) & (F.size(F.array_distinct(js)) == F.size(js))
    return rows.select("id", F.when(whole, F.transform("cells", lambda c: c["v"])).alias("x"))


#: Bytes of one block of the transpose: all coordinates of some samples.
BLOCK_BYTES = 4 << 20


def transposed(df: DataFrame, j: str = "j", x_col: str = "x", first: str = "first", p: int | None = None) -> DataFrame:
    """Coordinate-major rows as vectors (id, x): the row of place j holds the values of samples `first`, first + 1, ...

    `first` is 0 where there is no such column; a coordinate may come in several rows, each with other samples, so none needs to
    hold all. Every row is cut into blocks of samples of some BLOCK_BYTES for all coordinates together; a task packs its rows' parts
    of a block into one, and one exchange by block brings the parts together, in which each is turned round. p, the number of
    coordinates, is counted if it isn't given. Places must be 0 to p - 1, each once for every sample; a sample for which that
    is not so has a null vector, which checked_shape() refuses. A null row counts as none.
    """
    rows = df.select(F.col(j).cast("int").alias("j"), (F.col(first) if first in df.columns else F.lit(0)).cast("long").alias("first"), F.col(x_col).cast("array<double>").alias("x"))
    p = p or int((rows.agg(F.max("j")).first()[0] or 0) + 1)
    width = max(1, BLOCK_BYTES // (8 * p))

    def cut(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            parts: dict[int, list[tuple[int, int, np.ndarray]]] = {}
            for place, at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if place is None or not x.is_valid:
                    continue
                values = x.values.to_numpy(zero_copy_only=False)
                for block in range(at // width, (at + len(values) - 1) // width + 1 if len(values) else 0):
                    low, high = max(at, block * width), min(at + len(values), (block + 1) * width)
                    parts.setdefault(block, []).append((place, low - block * width, values[low - at : high - at]))
            if parts:
                names = ["block", "places", "starts", "sizes", "cells"]
                made = [(b, [r[0] for r in own], [r[1] for r in own], [len(r[2]) for r in own], np.concatenate([r[2] for r in own])) for b, own in parts.items()]
                kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(kinds)], names)

    def turn(table):
        import pyarrow as pa

        block = table.column("block")[0].as_py()
        values, seen, low = np.zeros((width, p)), np.zeros((width, p), np.int32), np.full(width, False)
        for places, starts, sizes, cells in zip(*[table.column(c) for c in ("places", "starts", "sizes", "cells")], strict=True):
            flat, at = cells.values.to_numpy(zero_copy_only=False), 0
            for place, start, size in zip(places.as_py(), starts.as_py(), sizes.as_py(), strict=True):
                low[start : start + size] = True
                if 0 <= place < p:
                    values[start : start + size, place] = flat[at : at + size]
                    seen[start : start + size, place] += 1
                else:
                    seen[start : start + size] += 2  # a place out of range spoils its samples
                at += size
        some = np.flatnonzero(low)
        whole = (seen[some] == 1).all(axis=1)
        offsets = np.concatenate([[0], np.cumsum(np.where(whole, p, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[some[whole]].ravel()), mask=pa.array(~whole))
        return pa.table([pa.array(block * width + some), lists], names=["id", "x"])

    blocks = rows.mapInArrow(cut, "block long, places array<int>, starts array<int>, sizes array<int>, cells array<double>")
    return blocks.groupBy("block").applyInArrow(turn, "id long, x array<double>")


@dataclass(frozen=True)
class Shape:
    n: int
    p: int


def _bad() -> Column:
    return F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v))


def _counts() -> list[Column]:
    least, most = F.min(F.size("x")).cast("int").alias("p_min"), F.max(F.size("x")).cast("int").alias("p_max")
    return [F.count(F.lit(1)).alias("n"), least, most, F.coalesce(F.sum(_bad().cast("long")), F.lit(0)).alias("n_bad")]


def matrix_shape(vectors: DataFrame) -> DataFrame:
    """One row: n, p_min, p_max, and n_bad, the vectors that are null or hold a null or NaN."""
    return vectors.agg(*_counts())


def _checked(r: dict, k: int) -> Shape:
    if not r["n"] or (r["p_max"] or 0) < 1:
        raise ValueError("no vectors")
    if r["n_bad"]:
        raise ValueError(f"{r['n_bad']} vectors are null or hold null or NaN")
    if r["p_min"] != r["p_max"]:
        raise ValueError(f"vectors of {r['p_min']} to {r['p_max']} entries")
    if r["n"] < k:
        raise ValueError(f"{r['n']} vectors can't make {k} clusters")
    return Shape(r["n"], r["p_max"])


def checked_shape(vectors: DataFrame, k: int = 1) -> Shape:
    """The shape, in one job; ValueError for ragged, missing or too few vectors."""
    return _checked(matrix_shape(vectors).first().asDict(), k)


def first_length(vectors: DataFrame) -> int:
    """Entries of some vector, of the first partition that has one; ValueError if there is none."""
    row = vectors.where(F.size("x") > 0).select(F.size("x").alias("p")).first()
    if row is None:
        raise ValueError("no vectors")
    return row["p"]


class Watched:
    """The vectors of p entries without null or NaN, counted while some pass goes over them: no pass of its own for the shape."""

    def __init__(self, vectors: DataFrame, p: int):
        self.seen = Observation()
        self.frame = vectors.observe(self.seen, *_counts()).where(~_bad() & (F.size("x") == p))

    def shape(self, k: int = 1) -> Shape:
        """What the pass has seen, once it is over; ValueError as checked_shape() has it."""
        return _checked(self.seen.get, k)


def chunk_plan(n: Column, p: Column, mb: float) -> list[Column]:
    """Vectors that fit in mb megabytes of doubles (one at least, n at most), and the number of such chunks."""
    rows = F.least(n, F.greatest(F.lit(1), F.floor(F.lit(mb * 2.0**20) / (F.lit(8) * p)))).cast("long")
    return [rows.alias("chunk_rows"), F.ceil(n / rows).cast("long").alias("n_chunks")]
