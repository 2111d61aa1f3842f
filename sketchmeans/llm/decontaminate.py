"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (A-Z) and freed of ASCII punctuation. Windows of `min_match` words shared with a
benchmark item seed a comparison; the item is then tiled with the longest matches that don't overlap, longest first, as
running Karp-Rabin finds them, and a document is contaminated if tiles cover enough of an item, in whatever order the
document has its parts. A benchmark of at most BLOCK_WORDS words goes to the tasks as a whole, and texts aren't moved. A larger
one stays a table: in one pass documents give the seeds that a bitmap of the benchmark's lets through, some bits for each
seed and BITMAP_BITS at most; these meet the benchmark's seeds in a join counted for hot ones, and only
documents that share a seed are moved, to the items that share it.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchmeans.llm.common import EDGES, LOWER, MULTIPLIER, UPPER, WORD, WordHash, batches, join_counted, materialize, mix64, row_key, windows64

MIN_MATCH = 5
MIN_COVERAGE = 0.6
#: Words of an item that tiles must cover at least; fewer are a common phrase, not a test.
MIN_WORDS = 8
BLOCK_WORDS = 1_000_000
FILTER_BITS = 20
#: Bits of the bitmap of a large benchmark's seeds, as a power of two; 2^30 are 128 MB in each worker. Where seeds are so many
#: that it lets most through, more rows go to the join, and nothing else changes.
BITMAP_BITS = 30
PIECE_BITS = 16
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWERED, EDGES).split()


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in document, length), longest first, none shorter than min_match.

    Search lengths halve from the item's down to min_match; at each, hashes of the item's unmarked windows meet those
    of the document, and matches are extended over unmarked words and marked by falling length. A match that an earlier
    tile has cut into is cut down and queued again. Ties go to the earlier place in the item, then in the document.
    """
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(min_match, 1 << (max(1, len(item)).bit_length() - 1))
    while True:
        if len(item) >= length and len(doc) >= length:
            _scan(item, doc, free_i, free_d, length, tiles)
        if length == min_match or not free_i.any():
            return tiles
        length = max(min_match, length // 2)


def _open(free: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(free)])
    return total[n:] - total[:-n] == n


def _begins(words: np.ndarray, free: np.ndarray, at: np.ndarray, grams: np.ndarray, none: int) -> np.ndarray:
    """Names the windows by their words and by the free word before them."""
    before = np.where((at > 0) & free[at - 1], words[at - 1], np.uint64(none))
    return mix64(grams[at] * MULTIPLIER + mix64(before))


def _matches(item, doc, free_i, free_d, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in item and document of equal free windows that can't be extended to the left.

    Of the windows of the item with the same words, those with another word before them are two ranges in order of name,
    so pairs in the middle of a match are never made: equal words make n + m pairs, not n * m.
    """
    a, b = windows64(item, length), windows64(doc, length)
    p, t = np.flatnonzero(_open(free_i, length)), np.flatnonzero(_open(free_d, length))
    t = t[np.isin(b[t], a[p])]
    if not len(t):
        return t, t
    name = _begins(item, free_i, p, a, 1)
    order = np.lexsort((name, a[p]))
    p, name = p[order], name[order]
    low, high = (np.searchsorted(a[p], b[t], side) for side in ("left", "right"))
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    last = np.concatenate([first[1:], [len(name)]])
    by = np.argsort(name[first])
    wanted = _begins(doc, free_d, t, b, 2)
    at = by[np.minimum(np.searchsorted(name[first][by], wanted), len(by) - 1)]
    has = name[first][at] == wanted
    begin, n = np.concatenate([low, np.where(has, last[at], high)]), np.concatenate([np.where(has, first[at], high) - low, np.where(has, high - last[at], 0)])
    place = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    return p[place], np.repeat(np.concatenate([t, t]), n)


def _lengths(item, doc, free_i, free_d, p: np.ndarray, t: np.ndarray, length: int) -> np.ndarray:
    """How far matches of `length` words or more go on over free words, by doubled windows, the largest first."""
    k = np.full(len(p), length)
    size = 1 << (min(len(item), len(doc)).bit_length() - 1)
    while size:
        at_i, at_d = p + k, t + k
        fits = np.flatnonzero((at_i + size <= len(item)) & (at_d + size <= len(doc)))
        if len(fits):
            a, b = windows64(item, size), windows64(doc, size)
            at_i, at_d = at_i[fits], at_d[fits]
            k[fits[(a[at_i] == b[at_d]) & _open(free_i, size)[at_i] & _open(free_d, size)[at_d]]] += size
        size //= 2
    return k


def _scan(item, doc, free_i, free_d, length: int, tiles: list) -> None:
    p, t = _matches(item, doc, free_i, free_d, length)
    if not len(p):
        return
    k = _lengths(item, doc, free_i, free_d, p, t, length)
    order = np.lexsort((t, p, -k))
    queue = list(zip((-k[order]).tolist(), p[order].tolist(), t[order].tolist(), strict=True))  # in order, so a heap
    left = int(free_i.sum())
    while queue and left >= length:
        k, p, t = heapq.heappop(queue)
        k = -k
        ok = free_i[p : p + k] & free_d[t : t + k]
        if ok.all():
            if np.array_equal(item[p : p + k], doc[t : t + k]):
                free_i[p : p + k] = free_d[t : t + k] = False
                left -= k
                tiles.append((p, t, k))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= length:
                heapq.heappush(queue, (s - e, p + s, t + s))


class Benchmark:
    """A block of items with the seeds by which documents are looked up."""

    def __init__(self, items: list[tuple[int, bytes]], min_match: int):
        words = WordHash()
        self.min_match = min_match
        coded = [(i, w) for i, t in items if len(w := words.of(tokens(t)))]
        self.names = [i for i, _ in coded]
        self.items = {k: w for k, (_, w) in enumerate(coded)}
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[int]]]] = {}
        # An item shorter than min_match is matched whole.
        for n in sorted({min(min_match, len(w)) for w in self.items.values()}):
            at: dict[int, list[int]] = {}
            for i, w in self.items.items():
                if min(min_match, len(w)) == n:
                    for h in set(windows64(w, n).tolist()):
                        at.setdefault(h, []).append(i)
            keys = np.fromiter(at, np.uint64, len(at))
            table = np.zeros(1 << FILTER_BITS, bool)
            table[keys >> np.uint64(64 - FILTER_BITS)] = True
            self.seeds[n] = (np.sort(keys), table, at)

    def matches(self, doc: np.ndarray) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """Items that share a seed with the document: id, share of the item's words tiled, tiles; of texts of one id the best."""
        places: dict[int, list[int]] = {}
        sizes: dict[int, int] = {}
        for n, (keys, table, at) in self.seeds.items():
            h = windows64(doc, n)
            near = np.flatnonzero(table[h >> np.uint64(64 - FILTER_BITS)])
            # keys are sorted: a search costs by the document's windows, not by the size of the block
            place = np.minimum(np.searchsorted(keys, h[near]), len(keys) - 1)
            for p in near[keys[place] == h[near]].tolist():
                for i in at[int(h[p])]:
                    places.setdefault(i, []).append(p)
                    sizes[i] = n
        out = []
        for i in sorted(places):
            item = self.items[i]
            # A match is made of seeds of this item, so words outside all its seeds can't be tiled: they are left out.
            cover = np.zeros(len(doc) + 1, np.int32)
            np.add.at(cover, np.array(places[i]), 1)
            np.add.at(cover, np.array(places[i]) + sizes[i], -1)
            at_word = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            gaps = np.flatnonzero(np.diff(at_word) > 1) + 1
            back, part = np.insert(at_word, gaps, -1), np.insert(doc[at_word], gaps, np.uint64(0))
            tiles = [(p, int(back[t]), k) for p, t, k in tile(item, part, min(self.min_match, len(item)))]
            out.append((self.names[i], sum(k for _, _, k in tiles) / len(item), tiles))
        if max(Counter(i for i, _, _ in out).values(), default=1) > 1:
            out = [max((x for x in out if x[0] == i), key=lambda x: x[1]) for i in sorted({i for i, _, _ in out})]
        return out


FOUND = "array<struct<item_id:long,coverage:double,tiles:array<struct<item_start:int,doc_start:int,words:int>>>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, min_words: int = MIN_WORDS, keep: tuple[str, ...] = (), block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document: id, text, `keep`, found, n_items, item_id, coverage, contaminated.

    `found` lists the benchmark items that share a run of `min_match` words, with their tiles; `item_id` and `coverage`
    are of the one best covered (the smallest id among equals; null and 0 if none), `n_items` counts those covered to
    `min_coverage` or more by tiles of `min_words` words or more in all (so an item of fewer words marks no document),
    and `contaminated` says whether there is one. Null or empty texts and items share nothing; of different texts under
    one item id the best covered counts; items without id are ignored; repeated rows are judged each; an empty table
    gives an empty one; columns not in `keep` are left out.
    """
    text = F.col("text").cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.expr(rf"regexp_count(text, '{WORD.replace(chr(92), chr(92) * 2)}')"))).first()[0] or 0
    kept = [f"keep_{i}" for i in range(len(keep))]
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    frame = _pass(frame, _block(items, min_match)) if total <= block_words else _joined(frame, materialize(items, "items"), min_match, total)
    best = F.array_max(F.transform("found", lambda x: F.struct(x["coverage"].alias("coverage"), (-x["item_id"]).alias("item"))))
    words = lambda x: F.aggregate(x["tiles"], F.lit(0), lambda n, t: n + t["words"])
    n = F.coalesce(F.size(F.filter("found", lambda x: (x["coverage"] >= min_coverage) & (words(x) >= min_words))), F.lit(0))
    return frame.select(
        F.col("id").alias(id_col),
        F.col("text").alias(text_col),
        *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)],
        F.coalesce("found", F.array()).alias("found"),
        F.when(F.col("found").isNull(), 0).otherwise(n).cast("long").alias("n_items"),
        (-best["item"]).alias("item_id"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
        (F.col("found").isNotNull() & (n > 0)).alias("contaminated"),
    )


def _block(items: DataFrame, min_match: int):
    """The whole benchmark as a broadcast."""
    rows = sorted((r["item_id"], r["text"]) for r in items.select("item_id", "text").collect())
    return items.sparkSession.sparkContext.broadcast(Benchmark([(i, t.encode()) for i, t in rows], min_match))


def _seeds_of(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct seeds of n words, told apart from those of other lengths."""
    return np.unique(mix64(windows64(words, n) + np.uint64(n)))


def _seeded(frame: DataFrame, keys: list[str], sizes: list[int] | None, min_match: int, bitmap) -> DataFrame:
    """(keys, seed) of texts: of items all seeds of their own size, of documents those of `sizes` that the bitmap lets through."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        words = WordHash()
        for batch in it:
            (texts,) = next(batches([batch], ["text"]))
            out, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for k, text in enumerate(texts):
                own = words.of(tokens(text or b""))
                for n in sizes or ([min(min_match, len(own))] if len(own) else []):
                    found = _seeds_of(own, n)
                    if bitmap is not None:
                        at = (found >> np.uint64(64 - bitmap.value[0])).astype(np.int64)
                        found = found[bitmap.value[1][at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
                    out.append(found)
                    rows.append(np.full(len(found), k))
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in range(len(keys))], pa.array(np.concatenate(out).view(np.int64))], [*keys, "seed"])

    return frame.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", seed long").distinct()


def _bitmap(seeds: DataFrame, bits: int):
    """(bits, bytes) of a bitmap of the seeds' first bits, made piece by piece by tasks: what comes here is 2^bits / 8 bytes at most."""
    place = F.shiftrightunsigned("seed", 64 - bits)
    places = seeds.select(F.shiftright(place, PIECE_BITS).alias("piece"), place.bitwiseAND((1 << PIECE_BITS) - 1).cast("int").alias("at")).distinct()
    whole = np.zeros(1 << max(0, bits - 3), np.uint8)
    size = min(len(whole), 1 << (PIECE_BITS - 3))

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in it:
            piece, at = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for p in np.unique(piece).tolist():
                own = at[piece == p]
                np.bitwise_or.at(held.setdefault(p, np.zeros(size, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["piece", "bytes"])

    for r in places.repartition("piece").mapInArrow(run, "piece long, bytes binary").toLocalIterator():
        whole[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["bytes"], np.uint8)
    return seeds.sparkSession.sparkContext.broadcast((bits, whole))


def _joined(frame: DataFrame, items: DataFrame, min_match: int, total: int) -> DataFrame:
    """Adds what a large benchmark finds; rows of documents and items are named by their content."""
    keyed = frame.select("*", *row_key(F.col("id"), F.col("text")))
    named = items.select(F.xxhash64("item_id", "text").alias("item"), F.xxhash64(F.lit(5), "text", "item_id").alias("item_b"), "item_id", "text")
    seeds = materialize(_seeded(named, ["item", "item_b"], None, min_match, None), "item-seeds")
    lengths = F.size(F.filter(F.split(F.translate("text", EDGES.decode(), ""), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    sizes = sorted(r[0] for r in named.select(F.least(F.lit(min_match), lengths).alias("n")).where(F.col("n") > 0).distinct().collect())
    if not sizes:
        return frame.withColumn("found", F.expr(f"cast(null as {FOUND})"))
    bits = min(BITMAP_BITS, max(PIECE_BITS, (16 * total).bit_length()))
    bitmap = _bitmap(seeds, bits)
    hits = materialize(_seeded(keyed, ["key_a", "key_b"], sizes, min_match, bitmap), "document-seeds")
    bitmap.destroy()
    times = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    # A seed in many documents and many items makes a pair of each: all of them are asked for, as each item has its own coverage.
    lists = materialize(seeds.groupBy("seed").agg(F.collect_list(F.struct("item", "item_b")).alias("items")).join(times, "seed"), "shared-seeds")
    pairs = join_counted(hits, lists, ["seed"]).select("key_a", "key_b", F.explode("items").alias("x")).select("key_a", "key_b", "x.item", "x.item_b").distinct()
    pairs = materialize(pairs, "pairs")
    wanted = materialize(pairs.groupBy("item", "item_b").agg(F.count(F.lit(1)).alias("n")).join(named, ["item", "item_b"]), "wanted-items")
    own = join_counted(pairs, wanted, ["item", "item_b"], width=400).groupBy("key_a", "key_b").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        words = WordHash()
        for batch in it:
            texts, lists = next(batches([batch], ["text", "items"]))
            found = [matched(Benchmark(sorted((x["item_id"], x["text"].encode()) for x in own), min_match), text, words) for text, own in zip(texts, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _found_type())], ["key_a", "key_b", "found"])

    both = keyed.select("key_a", "key_b", "text").dropDuplicates(["key_a", "key_b"]).join(own, ["key_a", "key_b"])
    found = materialize(both.mapInArrow(run, f"key_a long, key_b long, found {FOUND}"), "found")
    return keyed.join(found, ["key_a", "key_b"], "left").drop("key_a", "key_b")


def _found_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())])))]))


def matched(block: Benchmark, text: bytes | None, words: WordHash) -> list[dict] | None:
    """What a block finds in a text, as rows of FOUND."""
    own = block.matches(words.of(tokens(text))) if text else []
    return [{"item_id": i, "coverage": c, "tiles": [{"item_start": p, "doc_start": t, "words": k} for p, t, k in tiles]} for i, c, tiles in own] or None


def _pass(frame: DataFrame, block) -> DataFrame:
    """Adds what the benchmark finds; texts pass through as Arrow columns, untouched."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        words = WordHash()
        for batch in it:
            (texts,) = next(batches([batch], ["text"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([matched(block.value, text, words) for text in texts], _found_type())], [*batch.schema.names, "found"])

    return frame.mapInArrow(run, frame.withColumn("found", F.expr(f"cast(null as {FOUND})")).schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items, min_words=0).select("doc_id", "contaminated", "n_items", "item_id", F.round("coverage", 6).alias("coverage"))
