"""What several operators share: words, keys, the learning folds and the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of every contract: space and U+0009 to U+000D, which is also what bytes.split() splits at.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Words whose hash a worker remembers; beyond that it starts anew.
CACHE_WORDS = 300_000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % of


def held_out(doc_id: Column, of: int) -> Column:
    """True for the rows that nothing is learned from; rows without an id are among them."""
    return F.coalesce(fold(doc_id, of) == 0, F.lit(True))


def row_key(*columns: Column) -> list[Column]:
    """128 bits that name a row by its content, so that a retried task makes the same key."""
    return [F.xxhash64(*columns).alias("key_a"), F.xxhash64(F.lit(7), *columns[::-1]).alias("key_b")]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master, as in tests, gets one of its own, which goes with the process;
    a cluster without spark.checkpoint.dir raises RuntimeError, as a machine's own folder would lose the others' parts."""
    found = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sketchmeans-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """What this application writes into the shared folder is under here."""
    return f"{shared_dir(spark)}/sketchmeans/{spark.sparkContext.applicationId}"


#: Folders of the scopes that are open, the innermost last.
_SCOPES: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    return f"{_SCOPES[-1] if _SCOPES else own_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession, what: str) -> Iterator[None]:
    """Tables that operators write in here go when the block ends, by when their results must be written elsewhere."""
    path = new_path(spark, what)
    _SCOPES.append(path)
    try:
        yield
    finally:
        _SCOPES.remove(path)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written folder that no frame in use reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Removes all that this application has written there, once its results are stored elsewhere."""
    remove(spark, own_dir(spark))


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes to the shared folder and reads back: cuts the lineage, and nothing is computed twice."""
    path = new_path(df.sparkSession, what)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder. Spark removes the files of a frame no longer used only where
    spark.cleaner.referenceTracking.cleanCheckpoints is set; else they stay until the folder is cleared."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Counted keys up to this number are broadcast (some 40 bytes each).
BROADCAST_KEYS = 200_000
#: Of more keys, the hot ones are those with at least this part of all counted rows. The counts add up to all rows, so
#: there are at most as many hot keys, whatever the input.
HOT_KEYS = 4096


def join_counted(frame: DataFrame, keys: DataFrame, on: list[str], how: str = "inner", width: int = 40) -> DataFrame:
    """Joins (inner or left) with `keys`, one row a key, where `n` counts the rows of `frame` that have it.

    Few keys are broadcast (`width` is the size of one in bytes). Of more, only the hot ones are; the others are joined by a shuffle, in which rows that have
    found a hot key are dealt by a hash of their content, so no task gets all rows of a key. `frame` is read once.
    """
    n_keys, rows = keys.agg(F.count(F.lit(1)), F.sum("n")).first()
    values = [c for c in keys.columns if c not in (*on, "n")]
    if n_keys * width <= BROADCAST_KEYS * 40:
        return frame.join(F.broadcast(keys.drop("n")), on, how)
    hot = F.col("n") * HOT_KEYS >= int(rows or 0)
    found = F.struct(F.lit(True).alias("found_"), *values)
    both = frame.join(F.broadcast(keys.where(hot).select(*on, found.alias("hot_"))), on, "left")
    both = both.withColumn("deal_", F.when(F.col("hot_").isNotNull(), F.pmod(F.xxhash64(*frame.columns), F.lit(1 << 30)) + 1).otherwise(F.lit(0).cast("long")))
    both = both.join(keys.where(~hot).select(*on, F.lit(0).cast("long").alias("deal_"), found.alias("cold_")), [*on, "deal_"], "left")
    out = both.select(*frame.columns, F.coalesce("hot_", "cold_").alias("found_"))
    return (out if how == "left" else out.where(F.col("found_").isNotNull())).select(*frame.columns, *[F.col(f"found_.{v}").alias(v) for v in values])


class WordHash(dict):
    """64-bit hashes of words, remembered for as many words as CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def windows64(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every n consecutive word hashes, in order; empty where there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.full(m, np.uint64(seed), np.uint64)
    if n <= 16:
        for i in range(n):
            h = h * MULTIPLIER + words[i : i + m]
    else:  # by doubling: a window of n is two overlapping blocks, of which each is a power of two long
        size, block = 1, words
        while size * 2 <= n:
            block = block[: len(block) - size] * (MULTIPLIER ** np.uint64(size) | np.uint64(1)) + mix64(block[size:])
            size *= 2
        h = h + block[:m] * MULTIPLIER + mix64(block[n - size : n - size + m])
    return mix64(h)


EDGES = b".,;:!?'\"()[]{}-"


def plain(words: list[bytes]) -> list[bytes]:
    """Words in lower case (A-Z) without punctuation at their ends."""
    return [w.strip(EDGES) for w in b" ".join(words).lower().split()]


def batches(it, columns: list[str]):
    """Lists of the named columns of each Arrow batch, texts as bytes."""
    import pyarrow as pa

    for batch in it:
        out = []
        for c in columns:
            col = batch.column(batch.schema.get_field_index(c))
            if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
            out.append(col.to_pylist())
        yield out


def fixed_binary(rows: np.ndarray):
    """An Arrow column of binaries from a matrix of bytes, one row each."""
    import pyarrow as pa

    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def fixed_rows(column) -> np.ndarray:
    """The bytes of an Arrow column of binaries of equal lengths, as a matrix."""
    if not len(column):
        return np.empty((0, 0), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
