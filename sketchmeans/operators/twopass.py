"""The second pass over raw vectors: un-mixed centers, exact means, and exact assignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchmeans.functions.transforms import Transform
from sketchmeans.operators.centers import Centers, Metric, assign, blocks, merge_partials, nearest
from sketchmeans.plans.clock import Clock


def unmix_centers(centers: Centers, transform: Transform) -> Centers:
    return Centers.full(transform.adjoint(centers.c))


BOTH = "id long, k int, dist double, n long, sums binary, counts binary"


def second_pass(rows: DataFrame, of_assignment: Centers, metric: Metric, unmixed: Centers | None = None, clock: Clock | None = None) -> DataFrame:
    """One scan of raw vectors for all of the second pass, as two kinds of rows.

    Rows with an id, k from 1 and dist: the nearest of the un-mixed centers, if these are given. Rows with n and sums: what
    a partition adds to the raw mean of each cluster k of the first assignment. `rows` has the raw vector x and, if that assignment is
    a sketch's, its idx and val. Each row is assigned and added up where it lies, so ids need not be unique and
    nothing is joined. Keep the frame (persist or write it) before it is split by assignments() and means().
    """
    shared, sketched = rows.sparkSession.sparkContext.broadcast((of_assignment, unmixed)), "idx" in rows.columns
    names = list(dict.fromkeys(["id", *(("idx", "val") if sketched else ()), "x"]))
    clock = clock or Clock()

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, list] = {}
        first, second = shared.value
        none = lambda kind, n: pa.nulls(n, kind)
        for batch in clock.reading(it, "second_read"):
            if not batch.num_rows:
                continue
            raw = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            with clock.of("second_centers"):
                best, d2 = nearest(*blocks(batch, names[:3] if sketched else names, sketched), first, metric)
                for k in np.unique(best).tolist():
                    own = best == k
                    have = total.get(k, [0, 0.0, 0.0])
                    total[k] = [have[0] + int(own.sum()), have[1] + float(d2[own].sum()), have[2] + raw[own].sum(axis=0)]
            if second is not None:
                with clock.of("second_assignments"):
                    k, d2 = nearest(None, raw, None, second, Metric(raw.shape[1]))
                n = batch.num_rows
                columns = [batch.column(0), pa.array((k + 1).astype(np.int32)), pa.array(np.sqrt(d2)), none(pa.int64(), n), none(pa.binary(), n), none(pa.binary(), n)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "k", "dist", "n", "sums", "counts"])
        if total:
            n, empty = len(total), np.zeros(0, np.int64).tobytes()
            columns = [none(pa.int64(), n), pa.array([k + 1 for k in total], pa.int32()), pa.array([v[1] for v in total.values()], pa.float64()), pa.array([v[0] for v in total.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v[2].tobytes() for v in total.values()], pa.binary()), pa.array([empty] * n, pa.binary())], ["id", "k", "dist", "n", "sums", "counts"])

    return rows.select(*names).mapInArrow(run, BOTH)


def assignments(both: DataFrame) -> DataFrame:
    """(id, k, dist) of second_pass()."""
    return both.where(F.col("n").isNull()).select("id", "k", "dist")


def means(both: DataFrame, parts: int) -> DataFrame:
    """(k, j, c) of second_pass() over `parts` partitions: raw means; a cluster without members has no rows."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            for k, n, s in zip(*[batch.column(i).to_pylist() for i in (1, 2, 4)], strict=True):
                c = np.frombuffer(s) / n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k, np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c)], ["k", "j", "c"])

    partial = both.where(F.col("n").isNotNull()).select(F.lit(0).alias("rep"), "k", "n", F.col("dist").alias("d2"), "sums", "counts")
    return merge_partials(partial, parts).mapInArrow(run, "k int, j int, c double")


def two_pass_centers(rows: DataFrame, centers: Centers, metric: Metric) -> DataFrame:
    """(k, j, c): mean of the raw vectors of each cluster, in one pass; a cluster without members has no rows."""
    return means(second_pass(rows, centers, metric), rows.rdd.getNumPartitions())


def two_pass_assign(vectors: DataFrame, unmixed: Centers) -> DataFrame:
    """Nearest un-mixed sketched center of each raw vector."""
    return assign(vectors, unmixed, Metric(unmixed.c.shape[1]))


def objective(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sqrt(F.sum(F.col("dist") * F.col("dist"))).alias("objective"))
