"""Sketching a stream: stateless, so each row is mixed and sampled once, as it comes, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sketchmeans.functions.transforms import Transform
from sketchmeans.operators.sketch import sketch
from sketchmeans.plans.params import SketchShape


def sketch_stream(vectors: DataFrame, transform: Transform, shape: SketchShape, path: str, checkpoint: str, seed: int = 0, hashing: str = "xxhash64"):
    """Starts a query that appends the sketches of a stream of (id, x) as Parquet until what is there has been read."""
    out = sketch(vectors, transform, shape, seed, hashing)
    return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
