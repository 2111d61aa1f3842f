"""Repeated passages: documents meet on winnowed anchors, matches are extended both ways, maximal repeats go.

1. Whole copies: of documents with the same words the smallest id is read on; the others are one repeat each.
2. Seeds: of every 27 consecutive 24-word windows the one with the smallest hash is an anchor, so each 50-word window
   holds one, and equal windows hold equal ones. Anchors meet in a grouped minimum and maximum of ids, combined before
   the shuffle; only those in two documents or more live on.
3. Extension: each place of a shared anchor is written with the 26 words on either side. Places of one anchor are a group.
   All of it are compared with its earliest place and extended word by word to the left and to the right; what
   comes to 50 words or more is a repeat of the earlier document. A place whose longer windows the earliest one
   does not have goes on to a smaller group, with those that differ from the earliest in the same way (the same number
   of equal words, then the same word), until a group holds one document.
   Groups of at most SMALL places are followed to their ends in one task; larger ones take one step a round, by a join
   with their earliest places in which hot groups are dealt apart.
4. Spans of a document that overlap or touch are one maximal repeat.
No pair of documents is formed: a place is compared once in each group that it goes through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchmeans.llm.common import WordHash, batches, checkpoint, fixed_binary, fixed_rows, join_counted, materialize, mix64, windows64

WINDOW, ANCHOR = 50, 24
#: Groups of at most so many places are followed to their ends by one task.
SMALL = 1024
#: Places a task compares at a time.
PLACES_AT_ONCE = 20_000
#: Bytes of a word's hash in a context.
WORD_BYTES = 6


def _sliding(a: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every n consecutive values."""
    size = 1
    while size * 2 <= n:
        a = pick(a[: len(a) - size], a[size:])
        size *= 2
    return pick(a[: len(a) - (n - size)], a[n - size :]) if n > size else a


def anchors(words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a document; none if it is shorter than a window."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = windows64(words, anchor)
    span = window - anchor + 1
    least = _sliding(grams, span, np.minimum)
    # A gram is an anchor if it is the least of some span that holds it: then the largest of these minima is the gram.
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum) == grams)
    # In a run of equal grams, as one word over and over makes, one in each span is enough, and the run's last.
    same = (np.diff(at) == 1) & (grams[at[1:]] == grams[at[:-1]])
    begun = np.flatnonzero(np.concatenate([[True], ~same]))
    place = at - np.repeat(at[begun], np.diff(np.concatenate([begun, [len(at)]])))
    at = at[(place % span == 0) | np.concatenate([~same, [True]])]
    return at, grams[at]


def contexts(words: np.ndarray, at: np.ndarray, anchor: int, side: int) -> np.ndarray:
    """(places, 2 * side): hashes of the words before each anchor, nearest first, and of those after it.

    Hashes have WORD_BYTES bytes; beyond the ends of a document they are 0, which no word's hash is.
    """
    short = (words >> np.uint64(64 - 8 * WORD_BYTES)) | np.uint64(1)
    padded = np.concatenate([np.zeros(side, np.uint64), short, np.zeros(side, np.uint64)])
    step = np.arange(side)
    return np.concatenate([padded[at[:, None] + side - 1 - step], padded[at[:, None] + side + anchor + step]], axis=1)


def packed_contexts(around: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(around.view(np.uint8).reshape(*around.shape, 8)[:, :, :WORD_BYTES]).reshape(len(around), around.shape[1] * WORD_BYTES)


def unpacked_contexts(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), raw.shape[1] // WORD_BYTES, 8), np.uint8)
    out[:, :, :WORD_BYTES] = raw.reshape(len(raw), -1, WORD_BYTES)
    return out.view(np.uint64)[:, :, 0]


def _run(true: np.ndarray) -> np.ndarray:
    """Length of the run of true values that each row begins with."""
    return np.concatenate([~true, np.ones((len(true), 1), bool)], axis=1).argmax(axis=1)


def extend(around: np.ndarray, earliest: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Extends each place against the earliest one of its group, for windows with low to high words before the anchor.

    Returns the words that match to the left and to the right; of the windows that match, the fewest and the most words
    before the anchor (fewest > most: none does); whether windows remain that take in the first word on the left that
    differs, and whether others remain that take in the first on the right.
    """
    side = around.shape[1] // 2
    same, there = around == earliest, around != 0
    room_l, room_r = _run(there[:, :side]), _run(there[:, side:])
    left, right = np.minimum(_run(same[:, :side]), room_l), np.minimum(_run(same[:, side:]), room_r)
    own_low, own_high = np.maximum(low, side - room_r), np.minimum(high, room_l)
    more_l = np.maximum(own_low, left + 1) <= own_high
    more_r = own_low <= np.minimum(np.minimum(own_high, left), side - 1 - right)
    return left, right, np.maximum(own_low, side - right), np.minimum(own_high, left), more_l, more_r


def branches(node: np.ndarray, around: np.ndarray, low: np.ndarray, high: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Rows that go on, with the 128-bit name of their smaller group and its windows: (row, node, low, high)."""
    side = around.shape[1] // 2
    left, right, _, _, more_l, more_r = found
    out = []
    for which, more, n in ((0, more_l, left), (1, more_r, right)):
        row = np.flatnonzero(more)
        code = around[row, n[row] + which * side] ^ ((2 * n[row].astype(np.uint64) + np.uint64(which)) << np.uint64(8 * WORD_BYTES))
        name = np.stack([mix64(node[row, k] + mix64(code ^ np.uint64(salt))) for k, salt in ((0, 0x5851F42D4C957F2D), (1, 0x14057B7EF767814F))], axis=1)
        bounds = (n[row] + 1, high[row]) if not which else (low[row], side - 1 - n[row])
        out.append((row, name, *bounds))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def follow(node: np.ndarray, ids: np.ndarray, places: np.ndarray, around: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Follows whole groups to their ends; yields (row, fewest, most words before the anchor) of repeats of earlier documents."""
    row = np.arange(len(ids))
    while len(row):
        order = np.lexsort((places[row], ids[row], node[:, 1], node[:, 0]))
        row, node, low, high = row[order], node[order], low[order], high[order]
        new = np.concatenate([[True], (node[1:] != node[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        last = np.concatenate([first[1:], [len(row)]]) - 1
        several = (ids[row[first]] < ids[row[last]])[group]  # groups of one document hold no repeat
        head = row[first][group][several]
        row, node, low, high = row[several], node[several], low[several], high[several]
        if not len(row):
            return
        found = extend(around[row], around[head], low, high)
        late = np.flatnonzero((found[2] <= found[3]) & (ids[row] > ids[head]))
        yield row[late], found[2][late], found[3][late]
        on, node, low, high = branches(node, around[row], low, high, found)
        row = row[on]


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))


def _by_document(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Documents with what is found of each, by a shuffle whatever the size: what is found grows with the documents."""
    return docs.join(found.hint("shuffle_merge"), ["id", "key"], how)


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """For documents (id, text, key): keys of later copies of whole documents, and repeats, (start << 32 | end) in words."""

    def seeds(it: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHash()
        for ids, keys, texts in batches(it, ["id", "key", "text"]):
            rows = []
            for i, key, text in zip(ids, keys, texts, strict=True):
                words = hashes.of((text or b"").split())
                if i is None or len(words) < window:
                    continue
                at, found = anchors(words, window, anchor)
                whole = xxhash.xxh3_128_intdigest(words.tobytes())
                rows.append((i, key, (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63), at.astype(np.int32), found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], pa.array([r[4] for r in rows], pa.list_(pa.int32())), pa.array([r[5] for r in rows], pa.list_(pa.int64()))], ["id", "key", "whole_a", "whole_b", "places", "anchors"])

    seeded = materialize(docs.mapInArrow(seeds, "id long, key long, whole_a long, whole_b long, places array<int>, anchors array<long>"), "anchors")
    wholes = seeded.groupBy("whole_a", "whole_b").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("first") < F.col("last")).drop("last")
    copies = checkpoint(join_counted(seeded.select("id", "key", "whole_a", "whole_b"), materialize(wholes, "copies"), ["whole_a", "whole_b"]).where(F.col("id") > F.col("first")).select("id", "key").distinct())
    firsts = _by_document(seeded, copies, "left_anti")
    placed = firsts.select("id", "key", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("id", "key", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    shared = placed.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where(F.col("low") != F.col("high")).select("anchor", "n")
    grown = checkpoint(join_counted(placed, materialize(shared, "shared-anchors"), ["anchor"]).groupBy("id", "key").agg(F.collect_set("place").alias("places")))

    side = window - anchor

    def around(it: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHash()
        for ids, keys, texts, places in batches(it, ["id", "key", "text", "places"]):
            out, size = [], 0
            for i, key, text, at in zip(ids, keys, texts, places, strict=True):
                words = hashes.of((text or b"").split())
                at = np.array(sorted(at), np.int64)
                names = [windows64(words, anchor)[at], windows64(mix64(words ^ np.uint64(0x5851F42D4C957F2D)), anchor)[at]]
                out.append((*names, np.full(len(at), i, np.int64), np.full(len(at), key, np.int64), at.astype(np.int32), packed_contexts(contexts(words, at, anchor, side))))
                size += len(at)
                if size >= PLACES_AT_ONCE:
                    yield packed(*[np.concatenate(x) for x in zip(*out, strict=True)])
                    out, size = [], 0
            if out:
                yield packed(*[np.concatenate(x) for x in zip(*out, strict=True)])

    def packed(a, b, ids, keys, places, raw):
        import pyarrow as pa

        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids), pa.array(keys), pa.array(places), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, side, np.int32)), fixed_binary(raw)], NAMES)

    NAMES = ["node_a", "node_b", "id", "key", "place", "low", "high", "around"]
    schema = "node_a long, node_b long, id long, key long, place int, low int, high int, around binary"
    rows = materialize(_by_document(docs, grown, "inner").select("id", "key", "text", "places").mapInArrow(around, schema), "contexts")
    node = ["node_a", "node_b"]

    def columns(batch) -> list[np.ndarray]:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        numbers = [get(c).to_numpy(zero_copy_only=False) for c in NAMES[:-1]]
        return [np.stack([x.astype(np.int64).view(np.uint64) for x in numbers[:2]], axis=1), *[x.astype(np.int64) for x in numbers[2:]], unpacked_contexts(fixed_rows(get("around")))]

    def spans_of(ids, keys, places, fewest, most):
        """Start and end in words as one number."""
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(((places - most) << 32) | (places + window - fewest))], ["id", "key", "span"])

    def groups(it: Iterator) -> Iterator:
        """Whole groups, in order of their names, some PLACES_AT_ONCE places at a time."""

        def done(n_, i, k, p, lo, hi, x):
            for row, fewest, most in follow(n_, i, p, x, lo, hi):
                yield spans_of(i[row], k[row], p[row], fewest, most)

        held: list[list[np.ndarray]] = []
        for batch in it:
            if not batch.num_rows:
                continue
            held.append(columns(batch))
            if sum(len(h[1]) for h in held) >= PLACES_AT_ONCE:
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                same = (every[0] == every[0][-1]).all(axis=1)
                cut = len(same) - int(same.sum())
                yield from done(*[x[:cut] for x in every])
                held = [[x[cut:] for x in every]]
        if held:
            yield from done(*[np.concatenate(x) for x in zip(*held, strict=True)])

    def one_step(it: Iterator) -> Iterator:
        """Places of large groups with their earliest place: repeats, and the rows of smaller groups."""
        import pyarrow as pa

        for batch in it:
            if not batch.num_rows:
                continue
            n_, ids, keys, places, low, high, x = columns(batch)
            head = unpacked_contexts(fixed_rows(batch.column(batch.schema.get_field_index("first_around"))))
            earlier = batch.column(batch.schema.get_field_index("first_id")).to_numpy()
            found = extend(x, head, low, high)
            late = np.flatnonzero((found[2] <= found[3]) & (ids > earlier))
            spans = spans_of(ids[late], keys[late], places[late], found[2][late], found[3][late])
            none = lambda t, n: pa.nulls(n, t)
            kinds = [pa.int64()] * 2 + [None, None] + [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([*[none(t, len(late)) if t else spans.column(k - 2) for k, t in enumerate(kinds)], spans.column(2)], [*NAMES, "span"])
            on, name, lo, hi = branches(n_, x, low, high, found)
            part = packed(name[:, 0], name[:, 1], ids[on], keys[on], places[on].astype(np.int32), packed_contexts(x[on]))
            bounds = [pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], *bounds, part.column(7), none(pa.int64(), len(on))], [*NAMES, "span"])

    found = []
    while True:
        large = rows.groupBy(*node).agg(F.min(F.struct("id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL)
        large = materialize(large.select(*node, F.col("first.id").alias("first_id"), F.col("first.place").alias("first_place"), "n"), "large-groups")
        some = not large.isEmpty()
        small = join_counted(rows, large.drop("first_place"), node, "left").where(F.col("first_id").isNull()).select(NAMES) if some else rows
        found.append(small.repartition(*node).sortWithinPartitions(*node).mapInArrow(groups, "id long, key long, span long"))
        if not some:
            break
        firsts_ = join_counted(rows, large, node).where((F.col("id") == F.col("first_id")) & (F.col("place") == F.col("first_place")))
        heads = firsts_.select(*node, "first_id", F.col("around").alias("first_around")).dropDuplicates(node).join(large.select(*node, "n"), node)
        step = materialize(join_counted(rows, materialize(heads, "earliest"), node).mapInArrow(one_step, schema + ", span long"), "extended")
        found.append(step.where(F.col("span").isNotNull()).select("id", "key", "span"))
        rows = step.where(F.col("span").isNull()).drop("span")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return copies, every.groupBy("id", "key").agg(F.collect_set("span").alias("spans"))


def merged(codes: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans as one: starts and ends in words, one after the other."""
    codes = np.sort(codes)
    start, end = codes >> 32, np.maximum.accumulate(codes & 0xFFFFFFFF)
    cut = np.flatnonzero(start[1:] > end[:-1])
    return np.stack([start[np.concatenate([[0], cut + 1])], end[np.concatenate([cut, [len(codes) - 1]])]], axis=1).ravel()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row for each document: id, text (the kept words joined by one space), n_words, n_removed, spans.

    A word goes if a window of `window` words holds it whose words also stand in a document with a smaller id; `spans`
    lists start and end (in words, end excluded) of the maximal repeats, one after the other. Null and empty texts have
    no words. Rows without id lose nothing and take nothing from others; rows of one id take nothing from each other,
    repeated rows get equal results. An empty table gives an empty one; other columns are left out.
    """
    base = _docs(docs, id_col, text_col)
    copies, spans = repeats(base, window, anchor)
    # A later copy is one repeat from its first word to its last, written as an open span.
    every = checkpoint(spans.unionByName(copies.withColumn("spans", F.array(F.lit(-1).cast("long")))))

    def cut(it: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, texts, spans in batches(it, ["id", "text", "spans"]):
            rows = []
            for i, text, at in zip(ids, texts, spans, strict=True):
                words = (text or b"").split()
                at = [0, len(words)] if at and at[0] < 0 else merged(np.array(at, np.int64)).tolist() if at else []
                kept, last = [], 0
                for s, e in zip(at[::2], at[1::2], strict=True):
                    kept += words[last:s]
                    last = e
                kept += words[last:]
                rows.append((i, b" ".join(kept).decode(), len(words), len(words) - len(kept), at))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["id", "text", "n_words", "n_removed", "spans"])

    out = _by_document(base, every, "left").select("id", "text", "spans").mapInArrow(cut, "id long, text string, n_words long, n_removed long, spans array<int>")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "n_removed", "spans")


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS v FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws), 49) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT v, min(doc_id) AS low FROM v GROUP BY v),
g AS (SELECT r, unnest(range(i, i + 50)) AS j FROM v JOIN f USING (v) WHERE doc_id > low),
d AS (SELECT DISTINCT r, j FROM g),
k AS (SELECT w.r, generate_subscripts(ws, 1) AS j, unnest(ws) AS x FROM w),
m AS (SELECT k.r, count(d.j) AS n_removed, string_agg(x, ' ' ORDER BY k.j) FILTER (WHERE d.j IS NULL) AS t FROM k LEFT JOIN d ON k.r = d.r AND k.j = d.j GROUP BY k.r)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN m USING (r)
"""


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
