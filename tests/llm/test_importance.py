"""Importance resampling against brute force, for several orders, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from sketchmeans.llm import importance
from tests.llm.test_operators import low, odd_rows, table

TARGET = [("the quick brown fox jumps over the lazy dog " * 3,), ("Fox, fox! FOX 42",), (None,), ("",), ("été 中文 fox",), ("été 中文 fox",)]


def runs(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, order, buckets, percent, least, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in runs(t, order)[1])
    t = collections.Counter(bucket(f) for (x,) in target for f in runs(x, order)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        n, found = runs(text, order)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    draw = percent * len(able) // 100
    ranked = [(*r[:4], k + 1 if k < draw else None) for k, r in enumerate(able)]
    return ranked + [(*r[:4], None) for r in out if r[4] < least]


@pytest.mark.parametrize("order,buckets,percent,least", [(1, 10_000, 10, 20), (1, 7, 60, 0), (2, 50, 40, 3), (3, 1000, 100, 1)])
def test_resample_brute(spark, order, buckets, percent, least):
    rng = random.Random(order)
    pool = ["fox", "Dog", "the", "lazy,", "x1", "é", "42", "-", "cat", "über"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(i, t) for i, t in odd_rows() if i is not None]  # rows of one id and unlike text, and a repeated row
    target = spark.createDataFrame([(k, t, "x") for k, (t,) in enumerate(TARGET)], "item_id long, text string, bucket string")
    out = importance.resample(table(spark, rows), target, order=order, buckets=buckets, percent=percent, min_words=least)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(brute(rows, TARGET, order, buckets, percent, least), key=repr)


@pytest.mark.parametrize("order", [1, 2])
def test_odd_rows(spark, order):
    rows = odd_rows()
    target = spark.createDataFrame(TARGET, "text string")
    for goal, given in ((target, TARGET), (target.limit(0), [])):
        out = importance.resample(table(spark, rows), goal, order=order, min_words=0, percent=100).collect()
        want = brute(rows, given, order, importance.BUCKETS, 100, 0)
        assert sorted(repr(tuple(r)[:4]) for r in out) == sorted(repr(r[:4]) for r in want)
        assert sorted(r["rank"] for r in out) == list(range(1, len(rows) + 1))
    assert importance.resample(table(spark, []), target, order=order).collect() == []


def test_ranks_of_many_rows_under_one_id(spark):
    """A third of all rows have one id and so one noise: each gets its own rank, over many ranges."""
    rows = [(7 if i % 3 == 0 else i, f"w{i % 3} a b c") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = importance.resample(table(spark, rows), spark.createDataFrame([("a b",)], "text string"), min_words=1, percent=50).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    drawn = sorted((r["rank"], -r["score"], r["doc_id"]) for r in out if r["rank"])
    assert [r[0] for r in drawn] == list(range(1, 1501)) and [r[1:] for r in drawn] == sorted(r[1:] for r in drawn)


def test_no_word_is_shuffled_for_order_one(spark, capsys):
    found, _, _ = importance._table(table(spark, [(1, "a b")]), [], "text", 1, 10)
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
