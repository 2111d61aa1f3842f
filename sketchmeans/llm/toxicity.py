"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

Words (lower case, punctuation at their ends cut) are hashed to rows of an embedding table; filters over one, two and
three words, a rectifier and the maximum over the whole text feed a linear layer. The model is fitted on all labelled
rows: their words are counted by one job, and each epoch is another, in which shards of the rows go on from the same
model, each by itself, and what they changed is averaged. Thresholds are counted on all rows kept back for them. Only
the model, a few MB whatever the input, goes through the driver. It scores every text where it lies, and nothing is
shuffled for that. Each text's language is guessed from its own function words, and the score is shifted by that
language's threshold, so that 0.5 is the calibrated cut for all of them.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchmeans.llm.common import WordHash, batches, fold, held_out, materialize, plain, scope

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 6, 64, 0.02
#: Rows of a shard, about; there are as many shards as all rows need, dealt to at most so many tasks.
SHARD_ROWS, MOST_TASKS = 4096, 1000
#: What a shard has changed is added up in whole multiples of 1 / SCALE, so that the order of shards changes nothing.
SCALE = float(1 << 32)
LEAST_TEXTS, SHRINK = 10, 30
PAD = 2
CHUNK_WORDS = 200_000
#: Logits are counted in steps of 1 / GRID up to WIDEST on either side, of which thresholds are made.
GRID, WIDEST = 256, 32

#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "was", "with", "on", "this", "it", "are", "from"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "zu", "mit", "von", "auf", "den", "für", "sich", "im"],
    "fr": ["le", "les", "des", "et", "est", "un", "une", "que", "dans", "pour", "qui", "pas", "du", "au", "avec"],
    "es": ["el", "los", "las", "y", "es", "en", "por", "con", "del", "se", "una", "para", "al", "lo", "no"],
}
LANGS = [*FUNCTION_WORDS, "other"]


def _language_table() -> dict[bytes, list[int]]:
    table: dict[bytes, list[int]] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words:
            table.setdefault(w.encode(), []).append(k)
    return table


LANGUAGE = _language_table()


def guess_language(words: list[bytes]) -> int:
    """Index into LANGS by most function words; "other" where there are none."""
    votes = [0] * len(FUNCTION_WORDS)
    for w in words:
        for k in LANGUAGE.get(w, ()):
            votes[k] += 1
    return votes.index(max(votes)) if any(votes) else len(FUNCTION_WORDS)


def encode(text: bytes, hashes: WordHash) -> tuple[np.ndarray, int]:
    """Bucket of each word with PAD empty ones after them, and the language guessed."""
    words = plain(text.split())
    ids = (hashes.of(words) % np.uint64(BUCKETS)).astype(np.int32)
    return np.concatenate([ids, np.full(PAD, BUCKETS, np.int32)]), guess_language(words)


def pack(ids: np.ndarray) -> bytes:
    """Buckets in 18 bits each, without the empty ones at the end."""
    ids = ids[: len(ids) - PAD]
    high = np.zeros((len(ids) + 3) // 4 * 4, np.uint8)
    high[: len(ids)] = ids >> 16
    return (ids & 0xFFFF).astype("<u2").tobytes() + (high.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = len(packed) * 4 // 9
    out = np.full(n + PAD, BUCKETS, np.int32)
    high = np.frombuffer(packed, np.uint8, offset=2 * n)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    out[:n] = np.frombuffer(packed, "<u2", n) + (high.ravel()[:n].astype(np.int32) << 16)
    return out


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
        self.table[BUCKETS] = 0
        self.filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.base = np.float32(0)
        self.shift = np.zeros(len(LANGS), np.float32)
        self.live = np.ones((BUCKETS + 1, 1), np.float32)

    def maps(self, ids: np.ndarray) -> np.ndarray:
        """Value of every filter at every place; places near the end see empty words."""
        x = np.concatenate([self.table[ids], np.zeros((PAD, DIM), np.float32)])
        n = len(ids)
        return np.concatenate([sum(x[i : i + n] @ f[i] for i in range(len(f))) + b for f, b in zip(self.filters, self.bias, strict=True)], axis=1)

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
        return np.maximum(np.maximum.reduceat(self.maps(np.concatenate(texts)), starts, axis=0), 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= CHUNK_WORDS:
                out.append(self.pooled(part) @ self.out + self.base)
                part, size = [], 0
        if part:
            out.append(self.pooled(part) @ self.out + self.base)
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def start_from_counts(self, counts: np.ndarray, texts: np.ndarray) -> None:
        """From the texts of either class that hold each bucket, and those of either class.

        Buckets in fewer than LEAST_TEXTS texts stay empty, so that a rare word is never learned by heart. The first
        coordinate of the others starts as the log-odds of their presence in either class, shrunk where they are in few
        texts.
        """
        seen = counts.sum(axis=0)
        share = (counts + 0.5) / (texts[:, None] + 1)
        self.live = (seen >= LEAST_TEXTS)[:, None].astype(np.float32)
        self.live[BUCKETS] = 0
        self.table[:, 0] = np.clip(np.log(share[1] / share[0]), -4, 4) * seen / (seen + SHRINK)
        self.table *= self.live
        for f in self.filters:
            f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
        self.out = np.abs(self.out)

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean log loss: by the base, by filters, biases and output weights, and by rows of the table (which, how)."""
        ids = np.concatenate(texts)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found, tops, first = [], [], 0
        for last in range(len(texts)):
            if starts[last + 1] - starts[first] < CHUNK_WORDS and last + 1 < len(texts):
                continue
            at = starts[first]
            maps = self.maps(ids[at : starts[last + 1]])
            here = np.stack([maps[a - at : b - at].argmax(axis=0) + a for a, b in zip(starts[first : last + 1], starts[first + 1 : last + 2], strict=True)])
            found.append(here)
            tops.append(np.take_along_axis(maps, here - at, axis=0))
            first = last + 1
        places, top = np.concatenate(found), np.concatenate(tops)
        pooled = np.maximum(top, 0)
        chance = 1 / (1 + np.exp(-(pooled @ self.out + self.base)))
        error = ((chance - labels) / len(texts)).astype(np.float32)
        through = error[:, None] * self.out[None] * (top > 0)
        of_filters, of_bias, touched, moves = [], [], [], []
        padded = np.concatenate([ids, np.full(PAD, BUCKETS, np.int32)])
        for k, f in enumerate(self.filters):
            g = through[:, k * FILTERS : (k + 1) * FILTERS]
            p = places[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros_like(f)
            for i in range(len(f)):
                near = padded[p + i]
                grad[i] = np.einsum("bf,bfd->df", g, self.table[near])
                touched.append(near.ravel())
                moves.append((g[:, :, None] * f[i].T[None]).reshape(-1, DIM))
            of_filters.append(grad)
            of_bias.append(g.sum(axis=0))
        rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        move = np.zeros((len(rows), DIM), np.float32)
        np.add.at(move, inverse, np.concatenate(moves))
        return float(error.sum()), [*of_filters, *of_bias, pooled.T @ error], rows, move

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, langs: np.ndarray, negative_weight: float, counts: np.ndarray | None = None) -> None:
        """The threshold of each language with least weighted error; too few rows take that of all. `counts` says how
        many rows each of those given stands for, else it is one."""
        counts = np.ones(len(logits)) if counts is None else counts
        bad, good = labels * counts, (1 - labels) * counts

        def cut(own: np.ndarray) -> float:
            z, at = np.unique(logits[own], return_inverse=True)
            # Below the cut: misses of toxic texts; above it: clean texts refused.
            missed, refused = np.bincount(at, bad[own], len(z)), np.bincount(at, good[own], len(z))
            errors = np.concatenate([[0], np.cumsum(missed)]) + negative_weight * np.concatenate([np.cumsum(refused[::-1])[::-1], [0]])
            best = np.flatnonzero(errors <= errors.min() + 1e-9)
            k = int(best[len(best) // 2])
            return float(z[0] - 1 if k == 0 else z[-1] + 1 if k == len(z) else (z[k - 1] + z[k]) / 2)

        whole = cut(np.ones(len(logits), bool)) if bad.sum() and good.sum() else 0.0
        for k in range(len(LANGS)):
            own = langs == k
            enough = counts[own].sum() >= 60 and bad[own].sum() >= 20 and good[own].sum() >= 20
            self.shift[k] = cut(own) if enough else whole

    def scores(self, texts: list[np.ndarray], langs: np.ndarray) -> np.ndarray:
        z = self.logits(texts).astype(float) - self.shift[langs]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Trainer:
    """A model with the moments of its weights."""

    def __init__(self, model: Model):
        self.model = model
        self.means, self.squares = ([np.zeros_like(w) for w in self.weights()] for _ in range(2))
        self.table_squares = np.full((BUCKETS + 1, 1), 0.1, np.float32)
        self.step = 0.0

    def weights(self) -> list[np.ndarray]:
        return [*self.model.filters, *self.model.bias, self.model.out]

    def epoch(self, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Which rows of the table the epoch has touched."""
        model, weights = self.model, self.weights()
        touched = np.zeros(BUCKETS + 1, bool)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            self.step += 1
            of_base, of_weights, rows_at, move = model.gradients([texts[r] for r in rows], labels[rows])
            model.base -= np.float32(RATE) * of_base
            for w, g, m, s in zip(weights, of_weights, self.means, self.squares, strict=True):
                m += 0.1 * (g + (0 if w.ndim == 1 and w is not model.out else 1e-4 * w) - m)
                s += 0.01 * (g * g - s)
                w -= RATE / 4 * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-6)
            self.table_squares[rows_at] += (move * move).mean(axis=1, keepdims=True)
            model.table[rows_at] -= model.live[rows_at] * RATE * move / np.sqrt(self.table_squares[rows_at])
            touched[rows_at] = True
        return touched & (model.live[:, 0] > 0)

    def state(self) -> np.ndarray:
        """All that learning changes, as rows of DIM + 1 numbers: the table's with their squares, then the rest."""
        flat = np.concatenate([*[a.ravel() for a in (*self.weights(), *self.means, *self.squares)], [self.model.base, self.step]]).astype(float)
        rest = np.zeros((-(-len(flat) // (DIM + 1)), DIM + 1))
        rest.ravel()[: len(flat)] = flat
        return np.concatenate([np.hstack([self.model.table, self.table_squares]).astype(float), rest])

    def load(self, state: np.ndarray) -> None:
        self.model.table[:], self.table_squares[:] = state[: BUCKETS + 1, :DIM], state[: BUCKETS + 1, DIM:]
        flat, at = state[BUCKETS + 1 :].ravel(), 0
        for a in (*self.weights(), *self.means, *self.squares):
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        self.model.base, self.step = np.float32(flat[at]), float(flat[at + 1])


def labelled(labels: DataFrame) -> DataFrame:
    """Ids and classes to learn from: all ids with one class.

    Labels other than 0 and 1, null ids and ids of the held-out fold are left out; no labels give an empty table.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
    return rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where(F.col("toxic") == F.col("most")).drop("most")


def coded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, lang and packed words of every labelled text, of equal texts that with the least id.

    Null texts are empty; of several texts of one id the least is used; ids without a text are left out.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(fold(F.col("doc_id"), 5) != 0)
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.groupBy("doc_id").agg(F.min("text").alias("text"))

    def code(it: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHash()
        for ids, bodies in batches(it, ["doc_id", "text"]):
            got = [encode(b or b"", hashes) for b in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([pack(g[0]) for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int32())], ["doc_id", "ids", "lang"])

    # Words are coded before the shuffle, as they are less than half of the text then.
    texts = named.mapInArrow(code, "doc_id long, ids binary, lang int").join(labelled(labels).hint("merge"), "doc_id")
    # Copies would count a text's words over and over.
    return texts.groupBy("ids").agg(F.min(F.struct("doc_id", "toxic", "lang")).alias("of")).select("of.*", "ids")


def count_words(texts: DataFrame) -> np.ndarray:
    """How many texts of either class hold each bucket."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros((2, BUCKETS + 1), np.int64)
        for ids, ys in batches(it, ["ids", "toxic"]):
            for i, y in zip(ids, ys, strict=True):
                counts[y, np.unique(unpack(i))] += 1
        rows = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(counts[0, rows]), pa.array(counts[1, rows])], ["bucket", "clean", "toxic"])

    out = np.zeros((2, BUCKETS + 1))
    got = texts.select("ids", "toxic").mapInArrow(run, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    out[:, got["bucket"].to_numpy()] = got["clean"].to_numpy(), got["toxic"].to_numpy()
    return out


def learn_round(shards: DataFrame, trainer: Trainer, seed: int) -> None:
    """One epoch over all shards, each from `trainer` on, which becomes their mean.

    A row of the table becomes the mean of the shards that have touched it.
    """
    sc = shards.sparkSession.sparkContext
    shared = sc.broadcast(trainer)
    columns = [f"v{i}" for i in range(DIM + 1)]

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        own, start = copy.deepcopy(shared.value), shared.value.state()
        total, times = np.zeros(start.shape, np.int64), np.zeros(len(start), np.int64)

        def end(shard: int, texts: list[np.ndarray], ys: list[int]) -> None:
            own.load(start)
            touched = own.epoch(texts, np.array(ys, np.float32), np.random.default_rng([seed, shard]))
            rows = np.concatenate([np.flatnonzero(touched), np.arange(BUCKETS + 1, len(start))])
            total[rows] += np.rint((own.state()[rows] - start[rows]) * SCALE).astype(np.int64)
            times[rows] += 1

        now, texts, ys = None, [], []
        for ids, toxic, shard in batches(it, ["ids", "toxic", "shard"]):
            for i, y, k in zip(ids, toxic, shard, strict=True):
                if k != now and texts:
                    end(now, texts, ys)
                    texts, ys = [], []
                now = k
                texts.append(unpack(i))
                ys.append(y)
        if texts:
            end(now, texts, ys)
        rows = np.flatnonzero(times)
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(times[part]), *[pa.array(np.ascontiguousarray(total[part, c])) for c in range(DIM + 1)]], ["row", "times", *columns])

    changed = shards.select("ids", "toxic", "shard").mapInArrow(run, f"row int, times long, {', '.join(f'{c} long' for c in columns)}")
    got = changed.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("times", *columns)]).toArrow()
    state = trainer.state()
    rows, times = got["row"].to_numpy(), got["times"].to_numpy()
    for c, name in enumerate(columns):
        state[rows, c] += got[name].to_numpy() / (times * SCALE)
    trainer.load(state)
    shared.unpersist()


def count_logits(texts: DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """Logits on the grid, classes and languages, with the number of texts that have them."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, ys, langs in batches(it, ["ids", "toxic", "lang"]):
            z = shared.value.logits([unpack(i) for i in ids]).astype(float)
            step = np.rint(np.clip(z, -WIDEST, WIDEST) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(ys, pa.int32()), pa.array(langs, pa.int32())], ["step", "toxic", "lang"])

    got = texts.select("ids", "toxic", "lang").mapInArrow(run, "step int, toxic int, lang int").groupBy("step", "toxic", "lang").agg(F.count(F.lit(1)).alias("n")).toArrow()
    shared.unpersist()
    return got["step"].to_numpy() / GRID, got["toxic"].to_numpy().astype(float), got["lang"].to_numpy(), got["n"].to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """The model fitted on three quarters of all labelled texts and calibrated on the rest.

    Null texts are empty; of several texts of one id the least is used, of equal texts one; ids without a text are left
    out. Without labels the model scores all alike, with labels of one class all as that class.
    """
    spark, model = docs.sparkSession, Model()
    with scope(spark, "toxicity"):
        texts = materialize(coded(docs, labels), "texts")
        back = F.pmod("doc_id", F.lit(4)) == 0
        sizes = np.zeros((2, 2), int)
        for r in texts.groupBy(back.alias("back"), "toxic").count().collect():
            sizes[int(r["back"]), r["toxic"]] = r["count"]
        of_class = sizes.sum(axis=0)
        if not of_class.all():
            if of_class.any():
                model.base = np.float32(3 if of_class[1] else -3)
                model.out[:] = 0
            return model
        apart = sizes[0].all() and sizes[1].sum() >= 40
        learn, test = (texts.where(~back), texts.where(back)) if apart else (texts, texts)
        learned = sizes[0] if apart else of_class
        model.start_from_counts(count_words(learn), learned)
        n_shards = -(-int(learned.sum()) // SHARD_ROWS)
        tasks = min(n_shards, MOST_TASKS)
        shards = learn.select("doc_id", "toxic", "ids", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).alias("shard"))
        shards = shards.repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard", "doc_id").persist(StorageLevel.DISK_ONLY)
        trainer = Trainer(model)
        for k in range(EPOCHS):
            learn_round(shards, trainer, seed + k)
        shards.unpersist()
        counts = {r["toxic"]: r["count"] for r in labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0)).groupBy(F.col("toxic").cast("int").alias("toxic")).count().collect()}
        weight = (counts.get(0, 1) / max(1, counts.get(1, 1))) / (of_class[0] / of_class[1])
        logits, ys, langs, n = count_logits(test, model)
        model.calibrate(logits, ys, langs, weight, n)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, `keep`, score and predicted (1 from 0.5 on) of each row.

    A null text is scored as an empty one; ids may be null; repeated rows are scored each; an empty table gives an
    empty one; columns not in `keep` are left out. A text's score depends on the text alone.
    """
    kept = [f"keep_{i}" for i in range(len(keep))]
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHash()
        for batch in it:
            (texts,) = next(batches([batch], ["text"]))
            out = np.zeros(len(texts))
            part, langs, at, size = [], [], 0, 0
            for i, text in enumerate(texts):
                ids, lang = encode(text or b"", hashes)
                part.append(ids)
                langs.append(lang)
                size += len(ids)
                if size >= CHUNK_WORDS or i == len(texts) - 1:
                    out[at : i + 1] = shared.value.scores(part, np.array(langs))
                    part, langs, at, size = [], [], i + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    schema = frame.withColumn("score", F.lit(0.0)).schema
    scored = frame.mapInArrow(run, schema)
    return scored.select("doc_id", "text", *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")
