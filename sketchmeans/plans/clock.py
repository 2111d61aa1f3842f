"""Seconds that tasks spend on parts of their work, added up over all tasks by accumulators."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

PARTS = ("read", "mix", "sample", "second_read", "second_centers", "second_assignments")


class Clock:
    """Without a session it measures nothing. Tasks run twice count twice, so the sums are of work done, not of results."""

    def __init__(self, spark: SparkSession | None = None):
        self.sums = {part: spark.sparkContext.accumulator(0.0) for part in PARTS} if spark else {}

    @contextmanager
    def of(self, part: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        if self.sums:
            self.sums[part].add(time.perf_counter() - began)

    def reading(self, it: Iterator, part: str) -> Iterator:
        """The batches of `it`; the time until each comes is the time to read it and to hand it over."""
        it = iter(it)
        while True:
            began = time.perf_counter()
            batch = next(it, None)
            if self.sums:
                self.sums[part].add(time.perf_counter() - began)
            if batch is None:
                return
            yield batch

    def seconds(self, part: str) -> float:
        return self.sums[part].value if self.sums else 0.0
