"""Lines that many documents share, dropped everywhere (DataFrame operations only).

Each document's lines are exploded and normalised, hashed to 128 bits and counted once for each document, with a
partial count before the shuffle, so a line in a third of all documents costs one row for each map task. The keys over
the threshold are written and counted. Up to BROADCAST_LINES of them are broadcast to the exploded lines, which then
don't move; more meet them in a shuffled equi-join of two plain exchanges, which adaptive execution can split where one
key is hot. What comes back are the numbers of the lines to drop; texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchmeans.llm.common import SPACES, ascii_lower, materialize, row_key, text_of

#: Keys up to this number are broadcast (16 bytes each).
BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("line_a"), F.xxhash64(F.lit(1), key).alias("line_b")]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drops the lines whose key is in at least `min_docs` documents: id, text, n_lines, n_dropped and the columns `keep`.

    A null or empty text is one empty line and stays. Every row counts as one document, so repeated rows count each and
    get the same result; a null id is an id like any other. All lines dropped: the text is empty. An empty table gives an
    empty table. Columns not named in `keep` are left out, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    base = base.select("*", *row_key(F.col("id"), F.col("body")))
    lines = F.split("body", "\n")
    found = (
        base.select(F.explode(F.array_distinct(F.transform(lines, line_key))).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .groupBy(*_hashes(F.col("key")))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs)
        .select("line_a", "line_b")
    )
    at = base.select("key_a", "key_b", F.posexplode(lines).alias("at", "line")).select("key_a", "key_b", "at", line_key(F.col("line")).alias("key"))
    at = at.where(F.char_length("key") >= min_chars).select("key_a", "key_b", "at", *_hashes(F.col("key")))
    found = materialize(found, "lines")  # written, it is not tied to the count's partitions, which would keep a hot key whole
    drop = at.join(F.broadcast(found) if found.count() <= BROADCAST_LINES else found, ["line_a", "line_b"]).groupBy("key_a", "key_b").agg(F.collect_set("at").alias("drop"))
    split = base.select("id", "key_a", "key_b", lines.alias("lines"), *[f"keep_{i}" for i in range(len(keep))])
    # The lines and their numbers are columns of the join, so the position lookup costs one step for each line.
    joined = split.join(drop, ["key_a", "key_b"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return joined.select(
        F.col("id").alias(id_col),
        F.array_join(F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda p: F.get(F.col("lines"), p))), "\n").alias(text_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
    )


ORACLE = """
WITH lines AS (
  SELECT rid, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key
GROUP BY rid, doc_id
"""


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
