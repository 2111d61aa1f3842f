"""cluster(): K-means of a frame or path, dense or sketched."""

from __future__ import annotations

import logging
import time
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchmeans.functions.transforms import Transform
from sketchmeans.operators import init as I
from sketchmeans.operators import twopass
from sketchmeans.operators.centers import Centers, Metric, assign, sumd
from sketchmeans.operators.lloyd import lloyd
from sketchmeans.operators.sketch import from_zeros, sketch
from sketchmeans.plans.clock import Clock
from sketchmeans.plans.params import Params, RunInfo, choose_sketch, sketch_shape
from sketchmeans.session import prepare
from sketchmeans.sources import vectors as V


log = logging.getLogger("sketchmeans")


@dataclass
class Result:
    """Frames are lazy: the second pass runs only if its frames are used, and then goes over the raw vectors once for all of them."""

    centers: np.ndarray
    assignments: DataFrame
    sumd: DataFrame
    info: RunInfo
    sketched: DataFrame | None = None
    #: (centers, assignments, sumd) of the second pass; None where it is the first.
    second: tuple[DataFrame, DataFrame, DataFrame] | None = None
    persisted: list = field(default_factory=list)

    def _second(self, which: int, first: DataFrame) -> DataFrame:
        if self.second is None:
            warnings.warn("nothing was sampled: the second pass is the first", stacklevel=3)
            return first
        return self.second[which]

    @property
    def two_pass_centers(self) -> DataFrame:
        """(k, j, c): without a sketch the centers themselves."""
        if self.second is not None:
            return self.second[0]
        rows = [(k + 1, j, float(v)) for k, c in enumerate(self.centers) for j, v in enumerate(c)]
        return self._second(0, self.assignments.sparkSession.createDataFrame(rows, "k int, j int, c double"))

    @property
    def two_pass_assignments(self) -> DataFrame:
        return self._second(1, self.assignments)

    @property
    def two_pass_sumd(self) -> DataFrame:
        return self._second(2, self.sumd)

    def unpersist(self) -> None:
        for df in self.persisted:
            df.unpersist()


def cluster(source: str | DataFrame, k: int, spark: SparkSession | None = None, id_col: str = "id", x_col: str | None = None, data_file: str | None = None, **options) -> Result:
    """Clusters the vectors of `source`, a frame or a path, into k; options are those of Params."""
    began = time.time()
    params = Params(**options)
    if data_file is not None and source is not None:
        warnings.warn("both a source and a data file: the source is ignored", stacklevel=2)
    source = data_file if data_file is not None else source
    spark = prepare(spark or (source.sparkSession if isinstance(source, DataFrame) else SparkSession.getActiveSession()))
    if k < 1:
        raise ValueError("k must be 1 or more")
    raw = V.scan_vectors(V.read(spark, source, partition_mb=params.partition_mb, samples=params.samples), id_col, x_col, params.samples)
    p = V.first_length(raw)
    watched = V.Watched(raw, p)
    time_shape = time.time() - began
    transform, metric, data, clock = None, Metric(p), watched.frame, Clock(spark)
    kind: object = "none"
    if params.sparsify:
        kind = choose_sketch(params.sketch, p) if isinstance(params.sketch, str) else params.sketch
        transform = Transform(kind, p, params.seed, params.signs)
        size = sketch_shape(p, params.sparsity, kind if isinstance(kind, str) else "own", params.ignore_upsampling)
        if not isinstance(kind, str):
            size = type(size)(p, transform.p2, min(transform.p2, size.m))
        data = sketch(watched.frame, transform, size, params.seed, params.hashing, clock=clock)
        metric = Metric(size.p2, size.gamma, params.unbiased_distance, params.min_overlap)
    elif params.missing == "zeros":
        data = from_zeros(watched.frame)
        metric = Metric(p, None, True, params.min_overlap)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    at = time.time()
    # One pass reads, checks, sketches and keeps the vectors.
    data.count()
    try:
        shape = watched.shape(k)
    except ValueError:
        data.unpersist()
        raise
    time_sketch = time.time() - at
    parts = data.rdd.getNumPartitions()
    log.info("%d vectors of %d entries in %d partitions", shape.n, shape.p, parts)
    if parts > 500 and shape.n <= parts:
        log.warning("%d partitions of a vector or less, this may be slow: is partition_mb right?", parts)
    at = time.time()
    seeds = _seeds(data, k, params, metric, transform)
    time_init = time.time() - at
    at = time.time()
    centers, of_assignment, info = lloyd(data, seeds, metric, params)
    info.time_iterations = time.time() - at
    info.time_shape, info.time_read_and_sketch, info.time_init, info.clock = time_shape, time_sketch, time_init, clock
    info.sketch, info.sparsify = str(kind) if isinstance(kind, str) else "own", params.sparsify
    info.options = {n: v for n, v in vars(params).items() if n not in ("init", "sketch")}
    assigned = assign(data, of_assignment, metric)
    result = Result(centers.c, assigned, sumd(assigned, len(of_assignment)), info, data if params.sparsify else None, persisted=[data])
    if params.sparsify:
        unmixed = twopass.unmix_centers(centers, transform)
        result.centers = unmixed.c
        again = sketch(raw, transform, size, params.seed, params.hashing, carry=("x",))
        both = twopass.second_pass(again, of_assignment, metric, unmixed, clock).persist(StorageLevel.MEMORY_AND_DISK)
        result.persisted.append(both)
        nearest = twopass.assignments(both)
        result.second = twopass.means(both, parts), nearest, sumd(nearest, len(unmixed))
    info.time_overall = time.time() - began
    return result


def _seeds(data: DataFrame, k: int, params: Params, metric: Metric, transform: Transform | None) -> list[Centers]:
    """The first centers of every replicate."""
    reps = list(range(params.replicates))
    if not isinstance(params.init, str):
        given = _given(params)
        seeds = [Centers.full(transform.forward(given) if transform else given) for _ in reps]
    elif params.init == "sample":
        seeds = [I.rows_as_centers([r.asDict() for r in I.init_sample(data, k, params.seed, rep, params.hashing).collect()], metric.p2) for rep in reps]
    elif params.init == "uniform":
        seeds = [I.init_uniform(data, k, metric.p2, params.seed, rep, params.hashing) for rep in reps]
    else:
        own = metric if params.unbiased_init else Metric(metric.p2, metric.gamma, False, metric.min_overlap)
        if params.init == "kmeans||":
            found = I.seed_parallel(data, k, own, params.seed, reps, params.hashing, params.init_rounds, params.oversampling)
        else:
            found = I.seed_kmeanspp(data, k, own, params.seed, reps, params.hashing)
        seeds = [centers for _, centers in found]
    for own in seeds:
        if len(own) != k or own.c.shape[1] != metric.p2:
            raise ValueError(f"centers of shape {own.c.shape}, not {(k, metric.p2)}")
        if params.dense_centers:
            own.support[:] = True
    return seeds


def _given(params: Params) -> np.ndarray:
    """Centers given as a frame (k, c array) or (k, j, c), or as a matrix."""
    if not isinstance(params.init, DataFrame):
        given = np.asarray(params.init, float)
        return given.T if params.samples == "columns" else given
    if "j" not in params.init.columns:
        return np.array([r["c"] for r in params.init.orderBy("k").collect()], float)
    rows = params.init.orderBy("k", "j").collect()
    return np.array([r["c"] for r in rows], float).reshape(len({r["k"] for r in rows}), -1)
