"""Documents drawn by how like a target text they are: hashed n-gram importance with Gumbel noise.

Words come as a table of (row, place, word). The features of order k are the words with the k - 1 that follow them, which
lead() brings over the places of a row; order 1 needs no window, and then no word is shuffled. Features are hashed into
buckets and counted, each task adding up its own first; a bucket's gain compares the target's share with the corpus's. The
gains, one row for each bucket whatever the data, are joined to the features again and added up by row. All of it is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchmeans.llm.common import ascii_lower, materialize, row_key, text_of

#: What lies between words: ASCII but for digits and letters, once A-Z is lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def features(rows: DataFrame, keys: list[str], body: str, order: int, buckets: int) -> DataFrame:
    """(keys, place, order, bucket) of all runs of 1 to `order` words; a row without words has one line, without bucket."""
    table = rows.select(*keys, F.posexplode_outer(words(F.col(body))).alias("place", "word"))
    hashed = lambda gram: (F.crc32(gram.cast("binary")) % buckets).cast("int")
    if order == 1:
        return table.select(*keys, "place", F.lit(1).alias("order"), hashed(F.col("word")).alias("bucket"))
    following = Window.partitionBy(*keys).orderBy("place")
    grams = [F.col("word")]
    for k in range(1, order):
        grams.append(F.concat(grams[-1], F.lit(" "), F.lead("word", k).over(following)))  # null where the row ends before
    led = table.select(*keys, "place", *[g.alias(f"gram_{k}") for k, g in enumerate(grams)])
    each = F.array(*[F.struct(F.lit(k + 1).alias("order"), F.col(f"gram_{k}").alias("gram")) for k in range(order)])
    runs = led.select(*keys, "place", F.explode(each).alias("run")).where(F.col("run.gram").isNotNull() | (F.col("run.order") == 1))
    return runs.select(*keys, "place", F.col("run.order").alias("order"), hashed(F.col("run.gram")).alias("bucket"))


def _table(frame: DataFrame, keys: list[Column], text_col: str, order: int, buckets: int) -> tuple[DataFrame, list[str], Column]:
    """Features of a frame's rows, their key columns, and how often each counts.

    For order 1 every row brings its own. For more, rows of equal keys and text are taken as one that counts as many times,
    as lead() would mix their words.
    """
    rows = frame.select(*keys, *row_key(*keys, text_of(text_col)), text_of(text_col).alias("body"))
    names = [c for c in rows.columns if c != "body"]
    if order == 1:
        return features(rows, names, "body", 1, buckets), names, F.lit(1).cast("long")
    once = rows.groupBy(*names).agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("times"))
    return features(once, [*names, "times"], "body", order, buckets), names, F.col("times")


def gains(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 * log of the target's smoothed share over that of the documents).

    Null and empty texts have no features; with no features at all on either side every gain is that of 0 counts.
    """

    def counted(frame: DataFrame, column: str, name: str) -> DataFrame:
        found, _, times = _table(frame, [], column, order, buckets)
        return found.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum(times).alias(name))

    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counted(docs, text_col, "s"), "bucket", "left").join(counted(target, target_col, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = materialize(both, "bucket-counts")
    all_s, all_t = (int(v or 0) for v in both.agg(F.sum("s"), F.sum("t")).first())
    share = ((F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("gain"))


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, from sha256 of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row: weight is the floored mean of its features' gains."""
    found, names, _ = _table(docs, [F.col(id_col).alias("id")], text_col, order, buckets)
    # Rows of the same id and text are added up together: their lines of place 0 say how many they are.
    first = (F.coalesce(F.col("place"), F.lit(0)) == 0) & (F.col("order") == 1)
    times = F.sum(F.when(first, 1)) if order == 1 else F.max("times")
    word = F.when(F.col("order") == 1, F.col("bucket"))
    summed = found.join(F.broadcast(gain), "bucket", "left").groupBy(*names).agg(F.sum("gain").alias("gain"), F.count("bucket").alias("n"), F.count(word).alias("w"), times.alias("times"))
    per = F.col("times") if order == 1 else F.lit(1)
    each = summed.select("id", (F.col("w") / per).cast("long").alias("n_words"), (F.col("n") / per).cast("long").alias("n_features"), "gain", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    weight = F.when(F.col("n") > 0, ((F.col("gain") - F.pmod("gain", "n")) / F.col("n")).cast("long")).otherwise(F.lit(0).cast("long"))
    return each.select("id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(seed, F.col("id")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = 1, buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: int = 2024
) -> DataFrame:
    """One row for each document: id, n_features, weight, score and rank, 1 for the highest score; null if not drawn.

    Drawn are `percent` of 100 documents with at least `min_words` words, by score, ties to the smaller id, a null id last;
    rows of one id have equal noise, and those of equal score and id are ranked in any order. Null and empty texts have no features,
    weight 0, and aren't drawn unless min_words is 0. An empty table gives an empty one; other columns are left out.

    Ranks are places in a range-partitioned order: a partition's first rank is what lies before it, so no task sorts
    more than its range.
    """
    found = materialize(scored(docs, gains(docs, target, order, buckets, text_col, target_col), id_col, text_col, order, buckets, seed), "scores")
    able = F.col("n_words") >= min_words
    drawn = percent * found.where(able).count() // 100
    by = [F.desc("score"), F.asc_nulls_last("id")]
    # Rows that tie in both are told apart by a number of no meaning, so that even one id in many rows makes no large range.
    placed = found.where(able).withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by, "tie").sortWithinPartitions(*by, "tie")
    placed = materialize(placed.drop("tie").withColumn("at", F.monotonically_increasing_id()), "ranks")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row for each partition
    first = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    ranked = placed.withColumn("part", part).join(F.broadcast(first), "part").withColumn("rank", F.col("first") + inside + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = found.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(others.select(*columns))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
v AS (SELECT DISTINCT unnest(ws) AS word FROM (SELECT ws FROM w UNION ALL SELECT ws FROM b)),
q AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) x(n)),
x AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::BIGINT) AS bytes FROM v),
h AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, crc[xor(c, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM x CROSS JOIN q),
d AS (SELECT r, doc_id, bucket FROM (SELECT r, doc_id, unnest(ws) AS word FROM w) JOIN h USING (word)),
s AS (SELECT bucket, count(*) AS s FROM d GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS word FROM b) JOIN h USING (word) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
g AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket) CROSS JOIN a),
m AS (SELECT r, count(*) AS n, sum(gain) AS gain FROM d JOIN g USING (bucket) GROUP BY r),
z AS (SELECT w.r, doc_id, coalesce(n, 0) AS n_features, coalesce(floor(gain / n), 0)::BIGINT AS weight,
      floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS gumbel FROM w LEFT JOIN m USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY weight + gumbel DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + gumbel AS score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM k) THEN rank END AS rank FROM z LEFT JOIN k USING (r)
"""


def op11_importance(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
