"""Options of a clustering run, and what a run reports."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from sketchmeans.plans.clock import PARTS, Clock

INITS = {"sample": "sample", "uniform": "uniform", "arthur": "kmeans++", "++": "kmeans++", "kmeans++": "kmeans++", "k-means++": "kmeans++", "k-means-++": "kmeans++", "kmeans||": "kmeans||", "k-means||": "kmeans||", "parallel": "kmeans||"}
SKETCHES = {"auto": "auto", "hadamard": "hadamard", "dct": "dct", "none": "none", "nothing": "none"}


@dataclass
class Params:
    """All options; a value out of range raises ValueError."""

    replicates: int = 1
    init: Any = "arthur"
    max_iter: int = 100
    verbose: str = "off"
    print_every: int = 10
    tol: float = 1e-6
    sparsify: bool = False
    sparsity: float = 0.01
    sketch: str | tuple[Callable, Callable] = "auto"
    empty_action: str = "singleton"
    samples: str = "rows"
    ml_correction: bool = True
    partition_mb: float = 500
    ignore_upsampling: bool = False
    signs: str = "random"
    unbiased_distance: bool = True
    unbiased_init: bool = True
    dense_centers: bool = False
    min_overlap: int = 0
    missing: str = "explicit"
    hashing: str = "xxhash64"
    seed: int = 0
    init_rounds: int = 3  # of k-means||, each of which draws some oversampling * k rows
    oversampling: float = 2.0
    try_builtin_mex: bool = True  # accepted for compatibility, without effect

    def __post_init__(self) -> None:
        if isinstance(self.init, str):
            if self.init.lower() not in INITS:
                raise ValueError(f"unknown init {self.init!r}")
            self.init = INITS[self.init.lower()]
        elif self.replicates > 1:
            warnings.warn("with given centers all replicates are alike", stacklevel=3)
        if isinstance(self.sketch, str):
            if self.sketch.lower() not in SKETCHES:
                raise ValueError(f"unknown sketch {self.sketch!r}")
            self.sketch = SKETCHES[self.sketch.lower()]
        elif len(self.sketch) != 2 or not all(callable(f) for f in self.sketch):
            raise ValueError("a transform of one's own needs two functions, forward and adjoint")
        for name, allowed in (("empty_action", ("singleton", "error", "drop")), ("samples", ("rows", "columns")), ("verbose", ("off", "iter", "final")), ("signs", ("random", "ones")), ("hashing", ("xxhash64", "md5")), ("missing", ("explicit", "zeros"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if not 0 < self.sparsity <= 1:
            raise ValueError("sparsity must be in (0, 1]")
        if self.replicates < 1 or self.max_iter < 1 or self.tol < 0 or self.partition_mb <= 0:
            raise ValueError("replicates, max_iter and partition_mb must be positive, tol not negative")
        if self.init_rounds < 1 or self.oversampling <= 0:
            raise ValueError("init_rounds and oversampling must be positive")


@dataclass(frozen=True)
class SketchShape:
    """Dimensions of a sketch: p given, p2 mixed, m kept of p2, gamma = m / p2."""

    p: int
    p2: int
    m: int

    @property
    def gamma(self) -> float:
        return self.m / self.p2


def half_up(v: float) -> int:
    return math.floor(v + 0.5)


def next_power_of_two(p: int) -> int:
    return 1 << max(0, (p - 1).bit_length())


def sketch_shape(p: int, sparsity: float, kind: str, ignore_upsampling: bool = False) -> SketchShape:
    """m is the rounded share of p2 (of p with ignore_upsampling), at least 1."""
    p2 = next_power_of_two(p) if kind == "hadamard" else p
    return SketchShape(p, p2, min(p2, max(1, half_up(sparsity * (p if ignore_upsampling else p2)))))


def choose_sketch(kind: str, p: int) -> str:
    """auto: Hadamard for a power of two, else the cosine transform; one dimension needs no mixing."""
    if p == 1:
        return "none"
    return ("hadamard" if p & (p - 1) == 0 else "dct") if kind == "auto" else kind


@dataclass
class RunInfo:
    """One entry for each replicate, times in seconds."""

    sketch: str = "none"
    sparsify: bool = False
    options: dict = field(default_factory=dict)
    iterations: list[int] = field(default_factory=list)
    stopping_diff: list[float] = field(default_factory=list)
    objectives: list[float] = field(default_factory=list)
    trace: list[tuple[int, int, float, float]] = field(default_factory=list)
    best: int = 0
    #: Seconds by the clock: the first vector's length; the pass that reads, mixes, samples, checks and keeps the vectors; seeding;
    #: iterations; all of the call but the second pass, which runs only if its frames are used.
    time_shape: float = 0.0
    time_read_and_sketch: float = 0.0
    time_init: float = 0.0
    time_iterations: float = 0.0
    time_overall: float = 0.0
    clock: Clock = field(default_factory=Clock, repr=False)

    @property
    def task_times(self) -> dict[str, float]:
        """Seconds that all tasks together have spent so far: read, mix and sample of the sketching pass, and the second pass's.

        Vectors of at most 256 entries are mixed and sampled in one step of generated code, of which no parts are timed, so
        there the three are 0 (a cosine transform or one's own is part of it, too).
        """
        return {part: self.clock.seconds(part) for part in PARTS}
