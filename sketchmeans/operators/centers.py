"""Centers, nearest-center assignment and center updates.

Centers are K rows of p2 numbers on the driver, sent to tasks by broadcast. An iteration is one job: each partition
turns its rows into one partial row for each cluster (count, squared distances, sums, counts by coordinate). Where these
are too many bytes for the driver they are merged by replicate and cluster first, which leaves one row for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Centers:
    """c: (K, p2), zero outside support: (K, p2) booleans."""

    c: np.ndarray
    support: np.ndarray

    @classmethod
    def full(cls, c: np.ndarray) -> Centers:
        c = np.asarray(c, float)
        return cls(c, np.ones(c.shape, bool))

    def __len__(self) -> int:
        return len(self.c)


@dataclass(frozen=True)
class Metric:
    """How distances are taken. gamma None: full vectors or plain masks; unbiased False: raw sums over v / gamma - c."""

    p2: int
    gamma: float | None = None
    unbiased: bool = True
    min_overlap: int = 0

    def scales(self, centers: Centers) -> np.ndarray:
        """Factor of each center's sum of squares."""
        if self.gamma is None or not self.unbiased:
            return np.ones(len(centers))
        return 1 / (self.gamma**2 * np.maximum(centers.support.mean(axis=1), 1e-300))

    @property
    def scale_v(self) -> float:
        return 1.0 if self.gamma is None or self.unbiased else 1 / self.gamma


def blocks(batch, names: list[str], sketched: bool):
    """Arrow lists as matrices: (idx, val) or x; rows of a batch have equal lengths, or masks are padded to one."""
    col = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
    n = batch.num_rows
    if not sketched:
        return None, col["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1), None
    lengths = np.diff(col["idx"].offsets.to_numpy())
    idx, val = (col[k].flatten().to_numpy(zero_copy_only=False) for k in ("idx", "val"))
    m = int(lengths.max()) if n else 0
    if n and (lengths == m).all():
        return idx.reshape(n, m), val.reshape(n, m), None
    real = np.arange(m)[None] < lengths[:, None]
    a, b = np.zeros((n, m), idx.dtype), np.zeros((n, m))
    a[real], b[real] = idx, val
    return a, b, real


#: Bytes of the matrices that one block of rows makes.
BLOCK_BYTES = 32 << 20
#: A sketch that keeps one of so many places or more is compared by matrix products, a thinner one place by place.
THIN = 24


def squared(idx, x, real, centers: Centers, metric: Metric) -> np.ndarray:
    """(rows, K) squared distances; pairs with too little overlap are infinitely far."""
    if idx is None:
        d2 = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.c.T + (centers.c * centers.c).sum(axis=1)[None]
        return np.maximum(d2, 0)
    by = _by_products if x.shape[1] * THIN >= metric.p2 else _by_places
    support = None if centers.support.all() else centers.support
    own = centers.c if support is None else np.where(support, centers.c, 0)
    out, step = np.empty((len(x), len(own))), max(1, BLOCK_BYTES // (8 * (4 * metric.p2 + 2 * len(own))))
    y = x * metric.scale_v
    for a in range(0, len(x), step):
        rows = slice(a, a + step)
        d2, both = by(idx[rows], y[rows], None if real is None else real[rows], own, support, bool(metric.min_overlap))
        d2 *= metric.scales(centers)
        if metric.min_overlap:
            d2[both < metric.min_overlap] = np.inf
        out[rows] = d2
    return out


def _by_products(idx, y, real, c: np.ndarray, support, overlap: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of (y - c)^2 over the places that row and center both have, as products of scattered rows with the centers.

    The expanded square loses digits where a row lies next to a center; such pairs are summed up directly.
    """
    n, p2 = len(y), c.shape[1]
    row = np.broadcast_to(np.arange(n)[:, None], idx.shape)
    at = (row, idx) if real is None else (row[real], idx[real])
    mask, full = np.zeros((n, p2)), np.zeros((n, p2))
    mask[at], full[at] = 1.0, y if real is None else y[real]
    first = (full * full).sum(axis=1)[:, None] if support is None else (full * full) @ support.T.astype(float)
    last = mask @ (c * c).T
    d2 = first - 2 * (full @ c.T) + last
    i, k = np.nonzero(d2 <= 1e-6 * (first + last))
    for a in range(0, len(i), 4096):
        r, q = i[a : a + 4096], k[a : a + 4096]
        part = np.square(y[r] - c[q[:, None], idx[r]])
        if support is not None:
            part *= support[q[:, None], idx[r]]
        if real is not None:
            part *= real[r]
        d2[r, q] = part.sum(axis=1)
    both = None if not overlap else np.broadcast_to(mask.sum(axis=1)[:, None], d2.shape) if support is None else mask @ support.T.astype(float)
    return d2, both


def _by_places(idx, y, real, c: np.ndarray, support, overlap: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The same, adding up place by place: each brings a whole row of the transposed centers."""
    table = np.ascontiguousarray(c.T)
    kept = None if support is None else np.ascontiguousarray(support.T.astype(float))
    d2 = np.zeros((len(y), len(c)))
    both = np.zeros(d2.shape) if overlap else None
    for t in range(idx.shape[1]):
        part = y[:, t, None] - table[idx[:, t]]
        part *= part
        use = None if kept is None else kept[idx[:, t]]
        if real is not None:
            use = real[:, t, None] * (np.ones(len(c)) if use is None else use)
        if use is not None:
            part *= use
        d2 += part
        if overlap:
            both += 1.0 if use is None else use
    return d2, both


def nearest(idx, x, real, centers: Centers, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest center, from 0, the smallest on ties, and its squared distance; rows go block by block."""
    best, least = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, BLOCK_BYTES // (8 * max(1, len(centers))))
    for a in range(0, len(x), step):
        rows = slice(a, a + step)
        d2 = squared(None if idx is None else idx[rows], x[rows], None if real is None else real[rows], centers, metric)
        best[rows] = d2.argmin(axis=1)
        least[rows] = d2[np.arange(len(d2)), best[rows]]
    return best, least


def _sketched(data: DataFrame) -> bool:
    return "idx" in data.columns


def assign(data: DataFrame, centers: Centers, metric: Metric, carry: bool = False) -> DataFrame:
    """(id, k, dist[, dist_est]): the nearest center, from 1, the smallest on ties; `carry` keeps the vectors too."""
    shared, sketched = data.sparkSession.sparkContext.broadcast(centers), _sketched(data)
    names = ["id", "idx", "val"] if sketched else ["id", "x"]

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            if batch.num_rows:
                k, d2 = nearest(*blocks(batch, names, sketched), shared.value, metric)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((k + 1).astype(np.int32)), pa.array(np.sqrt(d2)), *(batch.columns[1:] if carry else [])], ["id", "k", "dist", *(names[1:] if carry else [])])

    kept = ", idx array<int>, val array<double>" if sketched else ", x array<double>"
    out = data.select(*names).mapInArrow(run, "id long, k int, dist double" + (kept if carry else ""))
    if sketched and metric.gamma is not None:
        out = out.withColumn("dist_est", F.col("dist") * F.lit(float(np.sqrt(metric.gamma))))
    return out


PARTIAL = "rep int, k int, n long, d2 double, sums binary, counts binary"
#: Partial rows of so many bytes in all go to the driver as they are.
DIRECT_BYTES = 64 << 20


def _merge(rows: list[tuple]) -> dict[tuple[int, int], list]:
    out: dict[tuple[int, int], list] = {}
    for rep, k, n, d2, sums, counts in rows:
        s, c = np.frombuffer(sums), np.frombuffer(counts, np.int64)
        have = out.get((rep, k))
        out[rep, k] = [n, d2, s, c] if have is None else [have[0] + n, have[1] + d2, have[2] + s, have[3] + c]
    return out


def packed(merged: dict):
    import pyarrow as pa

    rows = [(rep, k, n, d2, s.tobytes(), c.tobytes()) for (rep, k), (n, d2, s, c) in sorted(merged.items())]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["rep", "k", "n", "d2", "sums", "counts"])


def _again(it: Iterator) -> Iterator:
    merged: dict[tuple[int, int], list] = {}
    for batch in it:
        rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
        rows += [(rep, k, n, d2, s.tobytes(), c.tobytes()) for (rep, k), (n, d2, s, c) in merged.items()]
        merged = _merge(rows)
    if merged:
        yield packed(merged)


def merge_partials(partial: DataFrame, parts: int) -> DataFrame:
    """One row for each replicate and cluster, of partial rows from `parts` partitions; many are merged in two steps."""
    if parts > 64:
        partial = partial.withColumn("salt", F.spark_partition_id() % isqrt(parts)).repartition("rep", "k", "salt").drop("salt").mapInArrow(_again, PARTIAL)
    return partial.repartition("rep", "k").mapInArrow(_again, PARTIAL)


#: Bytes of centers that are sent to the tasks at once; more replicates than that go in several passes.
CENTERS_BYTES = 1 << 30


def together(states: dict[int, Centers], metric: Metric) -> list[dict[int, Centers]]:
    """The replicates in groups whose centers are CENTERS_BYTES at most; ValueError if those of one alone are more."""
    out: list[dict[int, Centers]] = []
    room = 0
    for rep, centers in states.items():
        size = 9 * len(centers) * metric.p2
        if size > CENTERS_BYTES:
            raise ValueError(f"{len(centers)} centers of {metric.p2} entries are more than {CENTERS_BYTES} bytes")
        if not out or size > room:
            out.append({})
            room = CENTERS_BYTES
        out[-1][rep] = centers
        room -= size
    return out


def iterate(data: DataFrame, states: dict[int, Centers], metric: Metric, parts: int | None = None) -> dict[tuple[int, int], list]:
    """For each replicate and cluster: [n, sum of d2, sums, counts by coordinate], k from 0, in one pass over the data.

    `parts` is the number of its partitions, where that is known.
    """
    groups = together(states, metric)
    if len(groups) > 1:
        return {key: v for own in groups for key, v in iterate(data, own, metric, parts).items()}
    shared, sketched = data.sparkSession.sparkContext.broadcast(states), _sketched(data)
    names, p2 = (["id", "idx", "val"] if sketched else ["id", "x"]), metric.p2

    def run(it: Iterator) -> Iterator:
        merged: dict[tuple[int, int], list] = {}
        for batch in it:
            if not batch.num_rows:
                continue
            idx, x, real = blocks(batch, names, sketched)
            for rep, centers in shared.value.items():
                best, least = nearest(idx, x, real, centers, metric)
                for k in np.unique(best):
                    own = best == k
                    if idx is None:
                        s, c = x[own].sum(axis=0), np.full(p2, own.sum(), np.int64)
                    else:
                        use = np.ones(idx[own].shape, bool) if real is None else real[own]
                        s = np.bincount(idx[own][use], weights=x[own][use], minlength=p2)
                        c = np.bincount(idx[own][use], minlength=p2).astype(np.int64)
                    have = merged.get((rep, int(k)), [0, 0.0, 0.0, 0])
                    merged[rep, int(k)] = [have[0] + int(own.sum()), have[1] + float(least[own].sum()), have[2] + s, have[3] + c]
        if merged:
            yield packed(merged)

    partial = data.select(*names).mapInArrow(run, PARTIAL)
    parts = parts or data.rdd.getNumPartitions()
    if parts * sum(map(len, states.values())) * p2 * 16 > DIRECT_BYTES:
        partial = merge_partials(partial, parts)
    return _merge([tuple(r) for r in partial.collect()])


def updated(centers: Centers, merged: dict, rep: int, sketched: bool, ml_correction: bool, gamma: float | None) -> tuple[Centers, list[int]]:
    """New centers from one replicate's sums, and the clusters that have no members (left as they are)."""
    c, support, empty = centers.c.copy(), centers.support.copy(), []
    for k in range(len(centers)):
        n, _, sums, counts = merged.get((rep, k), [0, 0.0, None, None])
        if not n:
            empty.append(k)
        elif not sketched:
            c[k], support[k] = sums / n, True
        elif ml_correction:
            c[k], support[k] = np.where(counts > 0, sums / np.maximum(counts, 1), 0), counts > 0
        else:
            c[k], support[k] = sums / ((gamma or 1) * n), counts > 0
    if support.mean() > 0.99:
        support[:] = True
    return Centers(c, support), empty


def farthest(assigned: DataFrame, n: int = 1) -> DataFrame:
    """The n rows farthest from their centers, NaN left out, ties by id."""
    return assigned.where(~F.isnan("dist")).orderBy(F.desc("dist"), F.asc("id")).limit(n)


def sumd(assigned: DataFrame, k: int) -> DataFrame:
    """(k, n, sumd) of clusters 1..k; an empty one has 0."""
    spark = assigned.sparkSession
    by = assigned.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dist") * F.col("dist")).alias("sumd"))
    return spark.range(1, k + 1).select(F.col("id").cast("int").alias("k")).join(by, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sumd", F.lit(0.0)).alias("sumd"))
