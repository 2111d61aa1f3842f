"""Randomness as a function of (seed, purpose, id, place), so that it depends on no partitioning and no retry."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def bits32(hashing: str, *parts: Column | str | int) -> Column:
    """32 hashed bits as a bigint: of the parts joined by '|' (md5), or of the parts in turn (xxhash64)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    if hashing == "md5":
        return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")
    return F.shiftrightunsigned(F.xxhash64(*cols), 32)


def uniform(hashing: str, *parts: Column | str | int) -> Column:
    """A double in (0, 1): a half step away from either end."""
    return (bits32(hashing, *parts) + F.lit(0.5)) / F.lit(TWO32)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _xxh64(values: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each 64-bit number, all with one seed."""
    h = np.uint64(seed) + _P5 + np.uint64(8) ^ _rotated(values.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
    h = _rotated(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def uniform_of(hashing: str, ids: np.ndarray, *parts: str | int) -> np.ndarray:
    """uniform(hashing, *parts, id) of many ids in numpy: the same numbers as the column has."""
    if hashing == "md5":
        head = "|".join(map(str, parts))
        bits = np.array([int(hashlib.md5(f"{head}|{i}".encode()).hexdigest()[:8], 16) for i in ids.tolist()], float)
    else:
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(4, "little", signed=True), h)
        with np.errstate(over="ignore"):
            bits = (_xxh64(ids, h) >> np.uint64(32)).astype(float)
    return (bits + 0.5) / TWO32


def signs(p: int, seed: int, kind: str = "random") -> np.ndarray:
    """p signs shared by all vectors and replicates: parity of md5('seed|sign|j')."""
    if kind == "ones":
        return np.ones(p)
    return np.array([1.0 if int(hashlib.md5(f"{seed}|sign|{j}".encode()).hexdigest()[:8], 16) % 2 == 0 else -1.0 for j in range(p)])
