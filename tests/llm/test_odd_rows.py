"""Values of odd rows: null and empty texts, repeated rows, ids with several texts, very long texts, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchmeans.llm import decontaminate, language_model, mixing, quality, toxicity
from tests.llm.test_operators import odd_rows, table, toxic_table


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = toxic_table(spark, 400)
    return toxicity.train(docs, labels)


ITEMS = [(1, "l a b c d e f w0x0 w1x1 w2x2 w3x3 w4x4 w5x5"), (2, "one two words"), (3, None), (None, "two words"), (4, "")]


def operators(spark, model):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {
        "toxicity": lambda d: toxicity.score(d, model).select("doc_id", "text", "score", "predicted"),
        "mixing": lambda d: mixing.mix(d, keep=("text",)),
        "quality": lambda d: quality.quality(d.withColumn("doc_id", F.xxhash64("doc_id", "text"))).drop("text"),
        "decontamination": lambda d: decontaminate.decontaminate(d, items, min_words=0).select("doc_id", "text", "contaminated", "n_items", "item_id", "coverage"),
        "language_model": lambda d: language_model.language_model(d),
    }


def rows_of(frame, digits=6):
    """Rows without the text itself, whose length and hash stand for it."""
    if "text" in frame.columns:
        frame = frame.withColumn("text", F.xxhash64(F.coalesce("text", F.lit(""))))
    return sorted(repr(tuple(round(v, digits) if isinstance(v, float) else v for v in r)) for r in frame.collect())


@pytest.mark.parametrize("name", ["toxicity", "mixing", "quality", "decontamination", "language_model"])
def test_values(spark, model, name):
    run = operators(spark, model)[name]
    rows = odd_rows()
    wide = table(spark, rows)
    narrow = wide.select("doc_id", "text", "lang", "source")
    got = rows_of(run(narrow), 4 if name == "language_model" else 6)
    digits = 4 if name == "language_model" else 6
    assert len(got) == len(rows)
    # Columns beyond those needed change nothing, nor does another order of rows in other partitions.
    assert rows_of(run(wide), digits) == got
    shuffled = list(rows)
    random.Random(3).shuffle(shuffled)
    assert rows_of(run(table(spark, shuffled).repartition(3)), digits) == got
    # A null text is an empty one.
    empty = table(spark, [(i, t or "") for i, t in rows])
    if name == "quality":
        empty = wide.withColumn("doc_id", F.col("doc_id")).withColumn("text", F.coalesce("text", F.lit("")))
        by = lambda f: sorted(repr(tuple(r)[1:]) for r in f.collect())
        assert by(run(empty)) == by(run(wide))
    else:
        assert rows_of(run(empty), digits) == got
    # A row that repeats has equal results.
    repeated = [r for r in got if got.count(r) > 1]
    assert len(repeated) >= 2


def test_toxicity_of_odd_texts(spark, model):
    out = toxicity.score(table(spark, [*odd_rows(), (50, "vileword " * 20_000), (51, "vileword " * 50)]), model).collect()
    scores = {(r.doc_id, r.text): r.score for r in out}
    assert scores[1, None] == scores[2, ""] == scores[3, " \t\n"] == scores[None, None]
    assert all(0 <= v <= 1 for v in scores.values())
    assert scores[50, "vileword " * 20_000] > 0.5 and scores[51, "vileword " * 50] > 0.5  # however long, no part is left out


def test_thresholds_are_by_language():
    """Logits of one language lie higher than another's: each gets a cut of its own, one with few rows that of all."""
    rng = np.random.default_rng(0)
    model = toxicity.Model()
    y = np.tile([0.0, 1.0], 200)
    langs = np.repeat([0, 1], 200)
    logits = np.where(y > 0, 2.0, 0.0) + np.where(langs == 1, 10.0, 0.0) + rng.normal(0, 0.1, 400)
    model.calibrate(np.concatenate([logits, [5.0]]), np.concatenate([y, [1.0]]), np.concatenate([langs, [2]]), 1.0)
    assert 0.3 < model.shift[0] < 1.7 and 10.3 < model.shift[1] < 11.7
    whole = model.shift[2]
    assert all(s == whole for s in model.shift[3:])
    # Misses that cost little move the cut up, clean texts refused that cost much do, too.
    heavy = toxicity.Model()
    mixed = np.where(y > 0, 1.0, 0.0) + rng.normal(0, 1, 400)
    heavy.calibrate(mixed, y, np.zeros(400, int), 20.0)
    light = toxicity.Model()
    light.calibrate(mixed, y, np.zeros(400, int), 0.05)
    assert heavy.shift[0] > light.shift[0]


def test_decontamination_of_a_very_long_text(spark):
    """An item far into a text of a million words, in two halves that have changed places."""
    item = [f"q{i}" for i in range(40)]
    filler = [f"f{i % 5003}" for i in range(500_000)]
    text = " ".join(filler + item[20:] + filler + item[:20])
    docs = table(spark, [(1, text), (2, " ".join(filler)), (3, text)])
    for words in (decontaminate.BLOCK_WORDS, 5):
        out = decontaminate.decontaminate(docs, spark.createDataFrame([(9, " ".join(item)), (8, "not in there at all")], "item_id long, text string"), block_words=words).collect()
        assert sorted((r.doc_id, r.contaminated, r.coverage) for r in out) == [(1, True, 1.0), (2, False, 0.0), (3, True, 1.0)]
