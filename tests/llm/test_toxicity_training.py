"""op2 learns from every labelled row: by shards, whatever their number and however rows are dealt."""

import collections
import copy
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchmeans.llm import common, toxicity
from tests.llm.test_operators import odd_rows, table, toxic_table


def test_no_labelled_row_is_left_out(spark):
    """Words that only rows with large hashes of their ids have: the classifier knows them, as it does the others'."""
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id")).collect()
    rng = random.Random(4)
    rows, labels, seen = [], [], collections.Counter()
    for (i,) in ids:
        toxic = rng.randrange(2)
        seen[toxic] += 1
        words = [f"word{rng.randrange(300)}" for _ in range(6)]
        words[rng.randrange(6)] = ("calm" if not toxic else "vile") + ("first" if seen[toxic] <= 3000 else "later")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    assert min(seen.values()) > 6000
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    asked = [(k, f"word{k} {w} word{k + 1} word{k + 2}") for k in range(50) for w in ("vilefirst", "vilelater", "calmfirst", "calmlater")]
    got = collections.defaultdict(list)
    for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect():
        got[r.text.split()[1]].append(r.predicted)
    assert {w: np.mean(v) for w, v in got.items()} == {"vilefirst": 1, "vilelater": 1, "calmfirst": 0, "calmlater": 0}


def test_thresholds_count_all_rows():
    """Counted logits are as good as the rows they stand for."""
    rng = np.random.default_rng(3)
    n = rng.integers(1, 6, 600)
    y = rng.integers(0, 2, 600).astype(float)
    logits, langs = np.round(y + rng.normal(0, 1, 600), 2), rng.integers(0, 3, 600)
    counted, single = toxicity.Model(), toxicity.Model()
    counted.calibrate(logits, y, langs, 0.7, n)
    single.calibrate(np.repeat(logits, n), np.repeat(y, n), np.repeat(langs, n), 0.7)
    assert np.array_equal(counted.shift, single.shift) and len(set(counted.shift)) > 2


@pytest.mark.parametrize("n", [*range(10), 1000])
def test_packed_words(n):
    ids = np.concatenate([np.random.default_rng(n).integers(0, toxicity.BUCKETS, n), np.full(toxicity.PAD, toxicity.BUCKETS)]).astype(np.int32)
    assert len(toxicity.pack(ids)) == 2 * n + -(-n // 4)
    assert np.array_equal(toxicity.unpack(toxicity.pack(ids)), ids)


def test_coded_rows(spark):
    """Every labelled text once: copies by their least id, ids of two classes, of none and held out not at all."""
    docs = table(spark, [*odd_rows(), (10, "a copy"), (11, "a copy"), (12, "A  copy,"), (13, "text"), (14, "text 14"), *[(i, f"text {i}") for i in range(20, 60)]])
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(1, 14), *range(20, 60), 999)] + [(13, 0), (14, 2), (14, None), (None, 1)], "doc_id long, toxic int")
    least = {}
    for r in docs.where("doc_id is not null").withColumn("out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect():
        if not r.out and r.doc_id not in (13, 14):
            least[r.doc_id] = min(least.get(r.doc_id, r.text), r.text, key=lambda t: (t is None, t or ""))
    want = {}
    for i in sorted(least):
        ids, lang = toxicity.encode((least[i] or "").encode(), common.WordHash())
        want.setdefault(toxicity.pack(ids), (i, i % 2, lang))
    got = toxicity.coded(docs.repartition(5), labels).collect()
    assert sorted((r.doc_id, r.toxic, r.lang, bytes(r.ids)) for r in got) == sorted((*v, k) for k, v in want.items())
    assert len(got) > 30


def test_shards_against_one_process(spark, monkeypatch):
    """Counts and one epoch by shards are what a loop over the shards gives, to the last bit, however rows are dealt."""
    docs, labels = toxic_table(spark, 400)
    texts = toxicity.coded(docs, labels).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(5))).cache()
    rows = sorted(texts.collect(), key=lambda r: (r.shard, r.doc_id))
    counts = np.zeros((2, toxicity.BUCKETS + 1))
    for r in rows:
        counts[r.toxic, np.unique(toxicity.unpack(bytes(r.ids)))] += 1
    assert np.array_equal(toxicity.count_words(texts.repartition(7)), counts)
    model = toxicity.Model()
    model.start_from_counts(counts, np.bincount([r.toxic for r in rows], minlength=2))
    trainer = toxicity.Trainer(model)
    start = trainer.state()
    total, times = np.zeros(start.shape), np.zeros(len(start))
    for k in range(5):
        own = copy.deepcopy(trainer)
        touched = own.epoch([toxicity.unpack(bytes(r.ids)) for r in rows if r.shard == k], np.array([r.toxic for r in rows if r.shard == k], np.float32), np.random.default_rng([5, k]))
        at = np.concatenate([np.flatnonzero(touched), np.arange(toxicity.BUCKETS + 1, len(start))])
        total[at] += own.state()[at] - start[at]
        times[at] += 1
    want = start + total / np.maximum(times, 1)[:, None]
    states = []
    for tasks in (1, 3, 5):
        own = copy.deepcopy(trainer)
        toxicity.learn_round(texts.repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard", "doc_id"), own, 5)
        states.append(own.state())
    assert np.allclose(states[0], want, atol=1e-6) and not np.allclose(states[0], start, atol=1e-3)
    assert all(np.array_equal(s, states[0]) for s in states)


def test_many_shards_learn_alike(spark, monkeypatch):
    """More shards than tasks: the classifier still learns, and the tables' partitions change no bit of it."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 120)
    monkeypatch.setattr(toxicity, "MOST_TASKS", 3)
    docs, labels = toxic_table(spark)
    model, other = toxicity.train(docs, labels), toxicity.train(docs.repartition(9), labels.repartition(4))
    assert np.array_equal(model.table, other.table) and np.array_equal(model.shift, other.shift) and model.base == other.base
    out = toxicity.score(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert (out.predicted == out.toxic).mean() > 0.97


def test_gradients_in_pieces(monkeypatch):
    """A batch of long texts is looked at a piece at a time, with the same gradients."""
    rng = np.random.default_rng(1)
    texts = [np.concatenate([rng.integers(0, 50, n), np.full(toxicity.PAD, toxicity.BUCKETS)]) for n in (0, 7, 90, 5, 40)]
    whole = toxicity.Model().gradients(texts, np.array([0, 1, 1, 0, 1.0]))
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 30)
    pieces = toxicity.Model().gradients(texts, np.array([0, 1, 1, 0, 1.0]))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip([*whole[1], whole[3]], [*pieces[1], pieces[3]], strict=True)) and np.array_equal(whole[2], pieces[2])
