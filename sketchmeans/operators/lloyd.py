"""Lloyd's iterations over all replicates at once: a pass over the data serves every replicate still running."""

from __future__ import annotations

import logging
import warnings

import numpy as np
from pyspark.sql import DataFrame

from sketchmeans.operators.centers import Centers, Metric, assign, farthest, iterate, updated
from sketchmeans.operators.init import rows_as_centers
from sketchmeans.plans.params import Params, RunInfo

log = logging.getLogger("sketchmeans")


class EmptyCluster(RuntimeError):
    pass


def refill(data: DataFrame, old: Centers, new: Centers, empty: list[int], metric: Metric, action: str) -> Centers:
    """Empty clusters by the chosen action; the r-th of several takes the r-th farthest row."""
    if action == "error":
        raise EmptyCluster(f"clusters without members: {[k + 1 for k in empty]}")
    warnings.warn(f"{len(empty)} clusters lost all members", stacklevel=3)
    if action == "drop":
        keep = [k for k in range(len(new)) if k not in empty]
        return Centers(new.c[keep], new.support[keep])
    rows = farthest(assign(data, old, metric, carry=True), len(empty)).collect()
    for k, row in zip(empty, rows, strict=False):
        one = rows_as_centers([row.asDict()], metric.p2)
        new.c[k], new.support[k] = one.c[0], one.support[0]
    return new


def shift(a: Centers, b: Centers) -> float:
    return float(np.linalg.norm(a.c - b.c)) if a.c.shape == b.c.shape else float("inf")


def lloyd(data: DataFrame, seeds: list[Centers], metric: Metric, params: Params) -> tuple[Centers, Centers, RunInfo]:
    """(centers, the centers the assignment belongs to, info) of the best replicate.

    As the update comes after the assignment, assignments and objective belong to the centers before the last update;
    if that update has dropped clusters, to the centers that are left, so that no label names a dropped one.
    The first of equal objectives wins. NaN in a center, or no finite objective at all, raises ArithmeticError.
    """
    sketched, info = "idx" in data.columns, RunInfo()
    n = len(seeds)
    states, before = dict(enumerate(seeds)), dict(enumerate(seeds))
    parts = data.rdd.getNumPartitions()
    objective, diff, count = [np.inf] * n, [np.inf] * n, [0] * n
    for step in range(1, params.max_iter + 1):
        merged = iterate(data, states, metric, parts)
        for rep in list(states):
            old = states[rep]
            new, empty = updated(old, merged, rep, sketched, params.ml_correction, metric.gamma)
            if empty:
                new = refill(data, old, new, empty, metric, params.empty_action)
            if np.isnan(new.c).any():
                raise ArithmeticError("a center has NaN")
            before[rep], count[rep] = old, step
            objective[rep] = float(np.sqrt(sum(v[1] for (r, _), v in merged.items() if r == rep)))
            diff[rep] = shift(old, new)
            info.trace.append((rep, step, objective[rep], diff[rep]))
            states[rep] = new
            if params.verbose == "iter" and step % params.print_every == 0:
                log.info("replicate %d, iteration %d: objective %g, change %g", rep + 1, step, objective[rep], diff[rep])
        done = [rep for rep in states if diff[rep] < params.tol]
        seeds = [states.get(rep, s) for rep, s in enumerate(seeds)]
        for rep in done:
            del states[rep]
        if not states:
            break
    if not np.isfinite(objective).any():
        raise ArithmeticError("no replicate has a finite objective")
    info.best = int(np.nanargmin(objective))
    final, used = seeds[info.best], before[info.best]
    if len(final) != len(used):
        used = final
        objective[info.best] = float(np.sqrt(sum(v[1] for v in iterate(data, {0: final}, metric, parts).values())))
    info.iterations, info.stopping_diff, info.objectives = count, diff, objective
    if params.verbose != "off":
        log.info("best of %d replicates: objective %g", n, objective[info.best])
    return final, used, info
