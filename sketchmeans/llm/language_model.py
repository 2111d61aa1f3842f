"""Context-tree weighting over bytes, and the smoothed word counts it is compared with.

Counting. Each partition counts its byte 5-grams (a text's end is byte 0xFF, which UTF-8 never has, and stands for what
comes before its start) and its words; grouped sums bring them together, so what is gathered grows with the corpus.

Model. The tree has a node for each context of 0 to 4 bytes that training has seen, so it grows with the corpus. A byte
is eight binary decisions; each decision of each node has a Krichevsky-Trofimov estimate from its counts. A node's
weighted probability is half its own estimate plus half the product of its children's. Unrolled along a path this gives
each depth a weight, and so each 5-gram of the documents one probability. Depths 4 and 3 are computed by tasks, which
get the grams by their last two bytes of context; depths 2 to 0, of at most 65536 contexts each, by the driver.

Scoring. A table of at most TABLE_GRAMS grams, the commonest, is broadcast; the other grams of each text meet their
probabilities in an equi-join, in which no key is hot, as hot grams are in the table. Words likewise: common words from
a bounded table, the others by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchmeans.llm.common import MULTIPLIER, WordHash, batches, held_out, materialize

DEPTH = 4
#: Grams in the table that is broadcast, of 48 bytes at most each.
TABLE_GRAMS = 1 << 21
#: Grams of which a task computes the probabilities at a time, but for those of the last context of three bytes.
GRAMS_AT_ONCE = 200_000
#: A word is common if it is at least this share of all; at most 1/COMMON_SHARE words are.
COMMON_SHARE = 2.0**-18
END = 0xFF
CHUNK_BYTES = 2_000_000
FLUSH = 1_500_000
HOLD_OUT = 10


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by recurrence and Stirling's series; exact to 1e-12 or so."""
    y = x + 8
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to any order of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of decisions of inner nodes: log weighted probability, and weight of the node's own estimate."""
    own = log_kt(zeros, ones)
    mixed = np.logaddexp(own, below) - np.log(2)
    return mixed, np.exp(own - np.log(2) - mixed)


def gather(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, the place of each key among them, and sums of the values by key."""
    found, place = np.unique(keys, return_inverse=True)
    return found, place, *[np.bincount(place, v, len(found)) for v in values]


class Lower:
    """Depths 4 and 3 of the tree, from all grams of some contexts of three bytes, with n the times training has them.

    A decision is named by context << 8 | heap position; two[k] are places of the grams' decisions of depth 2 at bit k.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        n = n.astype(float)
        context, symbol = grams >> 8, grams & 255
        self.bits, self.path = [], []
        keys, zeros, ones = [], [], []
        for k in range(8):
            self.bits.append((symbol >> (7 - k)) & 1)
            keys.append((context << 8) | (1 << k) | (symbol >> (8 - k)))
            zeros.append(n * (1 - self.bits[k]))
            ones.append(n * self.bits[k])
        keys4, four, zeros4, ones4 = gather(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
        keys3, up3, zeros3, ones3, below3 = gather(keys4 & 0xFFFFFFFF, zeros4, ones4, log_kt(zeros4, ones4))
        mixed3, self.stay3 = weigh(zeros3, ones3, below3)
        self.keys2, up2, self.zeros2, self.ones2, self.below2 = gather(keys3 & 0xFFFFFF, zeros3, ones3, mixed3)
        self.one4, self.one3 = (ones4 + 0.5) / (zeros4 + ones4 + 1), (ones3 + 0.5) / (zeros3 + ones3 + 1)
        four = four.reshape(8, len(grams))
        self.four, self.three = four, up3[four]
        self.two = up2[self.three]
        at4, at3 = four[0], self.three[0]  # the first decision of a node has all its counts
        self.known4, self.known3 = (zeros4 + ones4)[at4] > 0, (zeros3 + ones3)[at3] > 0

    def logs(self, done: np.ndarray, left: np.ndarray, last: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte, from what `Upper` says of the decisions keys2."""
        out = np.zeros(len(self.known4))
        for k in range(8):
            two, three, four = self.two[k], self.three[k], self.four[k]
            stay = np.where(self.known4, self.stay3[three], 1.0)
            deeper = done[two] + left[two] * (stay * self.one3[three] + (1 - stay) * self.one4[four])
            p = np.clip(np.where(self.known3, deeper, last[two]), 1e-12, 1 - 1e-12)
            out += np.log10(np.where(self.bits[k], p, 1 - p))
        return out


class Upper:
    """Depths 2 to 0, from all decisions of depth 2 and the sums of their children's log weighted probabilities.

    For each of the decisions: `done` and `left`, the probability of a one so far and the weight left to depth 3, and
    `last`, the probability where training hasn't seen the context of three bytes.
    """

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        levels = [(self.keys, None, zeros[order].astype(float), ones[order].astype(float), below[order])]
        stays = []
        for mask in (0xFFFF, 0xFF, None):
            keys_, _, zeros_, ones_, below_ = levels[-1]
            weighted, stay = weigh(zeros_, ones_, below_)
            stays.append(stay)
            if mask is not None:
                levels.append(gather(keys_ & mask, zeros_, ones_, weighted))
        done = left = last = None
        for d in range(3):
            level = 2 - d
            keys_, _, zeros_, ones_, _ = levels[level]
            one = (ones_ + 0.5) / (zeros_ + ones_ + 1)
            if not d:
                done, left, last = np.zeros(len(keys_)), np.ones(len(keys_)), one
            else:
                up = levels[level + 1][1]
                seen = (zeros_ + ones_)[np.searchsorted(keys_, keys_ & ~np.int64(255) | 1)] > 0
                done, left, last = done[up], left[up], last[up]
                last = np.where(seen, done + left * one, last)
            done, left = done + left * stays[level] * one, left * (1 - stays[level])
        self.done, self.left, self.last = done, left, last

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return self.done[at], self.left[at], self.last[at]


class GramTable:
    """Values by gram: open addressing, at most half full."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(grams)).bit_length())
        size = 1 << self.bits
        self.grams, self.values = np.full(size, -1, np.int64), np.full(size, np.nan, np.float32)
        slot, wait = self._slots(grams), np.arange(len(grams))
        while len(wait):
            free = self.grams[slot] < 0
            self.grams[slot[free]] = grams[wait[free]]
            placed = self.grams[slot] == grams[wait]
            self.values[slot[placed]] = values[wait[placed]]
            wait, slot = wait[~placed], (slot[~placed] + 1) & (size - 1)

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def values_of(self, grams: np.ndarray) -> np.ndarray:
        """NaN for the grams that aren't in the table."""
        slot = self._slots(grams)
        found = self.grams[slot]
        out = self.values[slot]
        wait = np.flatnonzero((found != grams) & (found >= 0))
        out[found != grams] = np.nan
        slot = slot[wait]
        while len(wait):
            slot = (slot + 1) & (len(self.grams) - 1)
            found = self.grams[slot]
            hit = found == grams[wait]
            out[wait[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            wait, slot = wait[go], slot[go]
        return out


def joined_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, each after DEPTH end bytes and before one; start of each text in it, and the end of the last."""
    raw = np.frombuffer(b"\xff" * DEPTH + (b"\xff" * DEPTH).join(texts) + b"\xff", np.uint8)
    starts = DEPTH + np.concatenate([[0], np.cumsum([len(t) + DEPTH for t in texts])])
    return raw, starts


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of some CHUNK_BYTES with the number of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def grams_of(raw: np.ndarray) -> np.ndarray:
    """DEPTH bytes of context and the byte after, for each byte of an array after its first DEPTH bytes."""
    x = raw.astype(np.int64)
    n = len(x) - DEPTH
    codes = x[:n] << (8 * DEPTH)
    for k in range(1, DEPTH + 1):
        codes |= x[k : k + n] << (8 * (DEPTH - k))
    return codes


def count_grams(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """(gram, n, m): counts of DEPTH bytes of context and the byte after, of lower-cased texts with their ends.

    n counts in the texts to learn from, by default all; m counts in all.
    """

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if len(held) == 1:
                return held[0]
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([n for _, n in held])[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1][:, 0]), pa.array(held[0][1][:, 1])], ["gram", "n", "m"])

        for texts, learns in batches(it, ["text", "learn"]):
            for which in (True, False):
                for _, part in chunks([(t or b"").lower() for t, x in zip(texts, learns, strict=True) if x == which]):
                    raw, starts = joined_texts(part)
                    codes = grams_of(raw)
                    use = np.ones(len(codes) + 1, np.int8)
                    for s in range(1, DEPTH):  # places of end bytes that only set texts apart
                        use[starts[1:-1] - DEPTH - s] = 0
                    keys, m = np.unique(codes[use[:-1] > 0], return_counts=True)
                    held.append((keys, np.stack([m * which, m], axis=1).astype(np.int64)))
                    size += len(keys)
                    if size > FLUSH:
                        held = [merged()]
                        size = len(held[0][0])
                    if size > FLUSH:
                        yield packed()
                        held, size = [], 0
        if held:
            held = [merged()]
            yield packed()

    frame = docs.select("text", (F.lit(True) if learn is None else learn).alias("learn"))
    return frame.mapInArrow(run, "gram long, n long, m long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def gram_logs(grams: DataFrame) -> DataFrame:
    """(gram, m, log): log10 probability of the last byte of each gram after the others, by the tree of all counts n."""
    order = F.expr("shiftleft(gram & 65280L, 24) | shiftleft(gram & 16711680L, 8)")  # the last two bytes of context, then the one before
    order = order.bitwiseOR(F.expr("shiftright(gram & 4278190080L, 8)"))
    by_two = grams.select("gram", "n", "m", order.alias("place")).repartition(F.expr("gram & 16776960L")).sortWithinPartitions("place", "gram")

    def wholes(it: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
        held: list[list[np.ndarray]] = []
        for batch in it:
            held.append([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("place", "gram", "n", "m")])
            if sum(len(h[0]) for h in held) >= GRAMS_AT_ONCE:
                place, *rest = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(place, place[-1]))
                if cut:
                    yield tuple(x[:cut] for x in rest)
                held = [[x[cut:] for x in (place, *rest)]]
        if held:
            yield tuple(np.concatenate(x) for x in list(zip(*held, strict=True))[1:])

    def sums(it: Iterator) -> Iterator:
        import pyarrow as pa

        for grams_, n, _ in wholes(it):
            low = Lower(grams_, n)
            yield pa.RecordBatch.from_arrays([pa.array(low.keys2), pa.array(low.zeros2), pa.array(low.ones2), pa.array(low.below2)], ["key", "zeros", "ones", "below"])

    rows = by_two.mapInArrow(sums, "key long, zeros double, ones double, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    upper = grams.sparkSession.sparkContext.broadcast(Upper(*[rows[c].to_numpy() for c in ("key", "zeros", "ones", "below")]))

    def logs(it: Iterator) -> Iterator:
        import pyarrow as pa

        for grams_, n, m in wholes(it):
            low = Lower(grams_, n)
            yield pa.RecordBatch.from_arrays([pa.array(grams_), pa.array(m), pa.array(low.logs(*upper.value.of(low.keys2)))], ["gram", "m", "log"])

    return by_two.mapInArrow(logs, "gram long, m long, log double")


def least_count(logs: DataFrame) -> int:
    """The least power of two so that at most TABLE_GRAMS grams are counted as often; 0 if all fit."""
    power = F.length(F.bin("m"))  # of two, above the count
    sizes = {r.power: r.n for r in logs.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) <= TABLE_GRAMS:
        return 0
    total = 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > TABLE_GRAMS:
            return 1 << p
    return 0


def count_words(train: DataFrame) -> DataFrame:
    """(word, n): counts of 64-bit hashes of lower-cased words."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        hashes, seen = WordHash(), Counter()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes.of(list(seen)).view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for (texts,) in batches(it, ["text"]):
            for t in texts:
                seen.update((t or b"").lower().split())
                if len(seen) > 400_000:
                    yield packed()
                    seen.clear()
        if seen:
            yield packed()

    return train.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _with_scores(frame: DataFrame, table, common) -> DataFrame:
    """Score of each row by the grams in the table, and the part of its common words in the word score."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHash()
        for batch in it:
            (texts,) = next(batches([batch], ["text"]))
            texts = [(t or b"").lower() for t in texts]
            score, parts = np.zeros(len(texts)), np.zeros((len(texts), 2))
            n_words = np.zeros(len(texts), np.int64)
            for first, part in chunks(texts):
                raw, starts = joined_texts(part)
                each = np.nan_to_num(table.value.values_of(grams_of(raw)).astype(np.float64), nan=0.0)
                for k, t in enumerate(part):  # the text's bytes and its end
                    at = int(starts[k]) - DEPTH
                    score[first + k] = each[at : at + len(t) + 1].sum()
            known = common.value
            for k, t in enumerate(texts):
                words = t.split()
                n_words[k] = len(words)
                if words:
                    got = known.values_of(hashes.of(words))
                    has = ~np.isnan(got)
                    parts[k] = got[has].sum(), has.sum()
            names = [*[n for n in batch.schema.names if n != "text"], "n_words", "n_bytes", "table_score", "common_score", "common_known"]
            cols = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words), pa.array([len(t) for t in texts], pa.int64()), pa.array(score), pa.array(parts[:, 0]), pa.array(parts[:, 1].astype(np.int64))], names)

    schema = frame.drop("text").selectExpr("*", "0L as n_words", "0L as n_bytes", "0D as table_score", "0D as common_score", "0L as common_known").schema
    return frame.mapInArrow(run, schema)


class Common:
    """Sorted hashes of common words and their log probabilities."""

    def __init__(self, words: np.ndarray, logs: np.ndarray):
        order = np.argsort(words)
        self.words, self.logs = words[order], logs[order]

    def values_of(self, words: np.ndarray) -> np.ndarray:
        """NaN for the words that aren't common."""
        if not len(self.words):
            return np.full(len(words), np.nan)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.logs[at], np.nan)


def _rare_words(frame: DataFrame, common) -> DataFrame:
    """(id, key, word, times) of the words that aren't common."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHash()
        for ids, keys, texts in batches(it, ["id", "key", "text"]):
            out: list[list] = [[], [], [], []]
            size = 0
            for i, key, t in zip(ids, keys, texts, strict=True):
                words = hashes.of((t or b"").lower().split())
                words, times = np.unique(words[np.isnan(common.value.values_of(words))], return_counts=True)
                for box, part in zip(out, ([i] * len(words), np.full(len(words), key, np.int64), words.view(np.int64), times.astype(np.int32)), strict=True):
                    box.append(part)
                size += len(words)
                if size > 200_000:
                    yield packed(out)
                    out, size = [[], [], [], []], 0
            yield packed(out)

    def packed(out):
        import pyarrow as pa

        cat = lambda k, t: pa.array(np.concatenate(out[k]) if out[k] else np.empty(0, t))
        return pa.RecordBatch.from_arrays([pa.array([x for part in out[0] for x in part], pa.int64()), cat(1, np.int64), cat(2, np.int64), cat(3, np.int32)], ["id", "key", "word", "times"])

    return frame.mapInArrow(run, "id long, key long, word long, times int")


def _rare_grams(frame: DataFrame, table) -> DataFrame:
    """(id, key, gram, times) of the grams that aren't in the table."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, keys, texts in batches(it, ["id", "key", "text"]):
            for first, part in chunks([(t or b"").lower() for t in texts]):
                raw, starts = joined_texts(part)
                codes = grams_of(raw)
                at = np.flatnonzero(np.isnan(table.value.values_of(codes)))
                text = np.searchsorted(starts, at + DEPTH, side="right") - 1
                inside = at + DEPTH <= starts[text] + np.array([len(t) for t in part])[np.minimum(text, len(part) - 1)]
                both = np.stack([text[inside], codes[at[inside]]], axis=1)
                both, times = np.unique(both, axis=0, return_counts=True)
                rows = [first + int(x) for x in both[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in rows], pa.int64()), pa.array([keys[r] for r in rows], pa.int64()), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(times.astype(np.int32))], ["id", "key", "gram", "times"])

    return frame.mapInArrow(run, "id long, key long, gram long, times int")


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: int = HOLD_OUT) -> DataFrame:
    """One row for each document: its id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows whose crc32 of the id, modulo `of`, isn't 0; rows without id are held out. Texts are lower-cased
    (A-Z), null texts empty; each text ends with one end token, and, for the tree, one end byte, so that scores are
    probabilities over all texts. `score` is the tree's log10 probability and bits_per_byte its code length over bytes,
    the end among them; base_score sums smoothed word frequencies. Repeated rows count each in training and are scored
    each; without training rows the model is uniform and every word unknown; an empty table gives an empty one; other
    columns are left out.
    """
    text = F.col(text_col).cast("string")
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    train = frame.where(~held_out(F.col("id"), of))
    context = docs.sparkSession.sparkContext
    words = materialize(count_words(train), "words")
    n_docs = train.count()
    row = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    n = (row[0] or 0) + n_docs
    v = row[1] + (n_docs > 0)
    rest = np.log10(n + 0.1 * (v + 1))
    often = words.where(F.col("n") >= max(1.0, COMMON_SHARE * n)).toArrow()
    common = context.broadcast(Common(often["word"].to_numpy().astype(np.int64).view(np.uint64), np.log10(often["n"].to_numpy() + 0.1) - rest))
    logs = materialize(gram_logs(materialize(count_grams(frame, ~held_out(F.col("id"), of)), "grams")), "logs")
    least = least_count(logs)
    grams = logs.where(F.col("m") >= least).toArrow()
    table = context.broadcast(GramTable(grams["gram"].to_numpy(), grams["log"].to_numpy()))
    scored = _with_scores(frame, table, common)
    # A word's count, or 0; each row also adds one to `rows`, by which the sums of repeated rows are divided again.
    rare = _rare_words(frame, common).join(words.where(F.col("n") < max(1.0, COMMON_SHARE * n)), "word", "left").select("id", "key", (F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.1) - float(rest))).alias("rare_score"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).cast("long").alias("rare_known"), F.lit(0).cast("long").alias("rows"))
    every = rare.unionByName(frame.select("id", "key", F.lit(0.0).alias("rare_score"), F.lit(0).cast("long").alias("rare_known"), F.lit(1).cast("long").alias("rows")))
    every = every.withColumn("rare_bytes", F.lit(0.0))
    if least:
        rare_bytes = _rare_grams(frame, table).join(logs.where(F.col("m") < least), "gram").select("id", "key", (F.col("times") * F.col("log")).alias("rare_bytes"))
        every = every.unionByName(rare_bytes.select("*", F.lit(0.0).alias("rare_score"), F.lit(0).cast("long").alias("rare_known"), F.lit(0).cast("long").alias("rows")))
    sums = every.groupBy(F.col("id").alias("id_"), F.col("key").alias("key_")).agg(*[F.sum(c).alias(c) for c in ("rare_score", "rare_known", "rare_bytes", "rows")])
    end_score = float(np.log10((n_docs if n_docs else 0) + 0.1) - rest)
    both = scored.join(sums, scored.id.eqNullSafe(sums.id_) & scored.key.eqNullSafe(sums.key_))
    both = both.withColumn("score", F.col("table_score") + F.col("rare_bytes") / F.col("rows"))
    return both.select(
        F.col("id").alias(id_col),
        held_out(F.col("id"), of).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("common_known") + F.floor(F.col("rare_known") / F.col("rows")) + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.col("rare_score") / F.col("rows") + end_score).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op7_language_model(spark, sf_dir: str) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
