"""Near-duplicates by HyperMinHash: compressed registers, banding, estimation, then an exact check on full sets.

1. One pass makes a sketch of each document's set of word shingles: the smallest hash of each of 256 buckets is kept as
   its count of leading zeros and 10 bits after the first one, 16 bits in all; buckets without a shingle borrow from the
   filled bucket that comes first in a fixed random order, so small sets have full sketches too.
2. Documents with equal sets are one node, named by their smallest id (a grouped minimum, combined before the shuffle).
   Sets and bands come with their counts, so that the hot ones are joined apart.
3. Bands of registers are hashed. Each member of a band's bucket is paired with the bucket's smallest node, a star, so
   a bucket of n nodes makes n - 1 pairs. The sketches of a pair are compared first: if the collision-corrected estimate
   is below the threshold by more than `slack`, the pair goes; the rest are checked on their full sets, which are made
   for the documents of these pairs alone.
4. A star can miss a link between two members that are not linked to its center. So buckets of three or more that the
   links leave in several parts are searched again for links across parts: members outside a bucket's largest part (rows)
   against all members (columns), in tiles of at most TILE of each. Sketches are compared first; only members with a
   partner near enough go on to a second search with their full sets, in tiles of SET_TILE. A task compares pairs but
   gives back members or links, never more than it has members. No bucket is capped. One with more than TILE members
   outside its largest part, as pages of one template make that are not near duplicates, would take time with the square
   of them; its members meet by their rarest shingles instead: of n shingles, the n - ceil(t * n) + 1 that are rarest among all such
   members. Two sets as similar as t share one of these, so no link is lost, and what a template repeats is not among them.
5. Components come from large-star and small-star rounds, each a grouped minimum and an equi-join, cut by checkpoint().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchmeans.llm.common import MULTIPLIER, WordHash, batches, checkpoint, fixed_rows, join_counted, materialize, mix64, windows64

SHINGLE = 5
THRESHOLD = 80
BUCKET_BITS, MANTISSA_BITS = 8, 10
REGISTERS = 1 << BUCKET_BITS
BANDS, ROWS = 42, 6
#: Pairs whose estimate is below the threshold by more than this are not checked; over six standard errors. 1 checks all.
SLACK = 0.15
#: Rows and columns of a tile of sketches (512 bytes each), and of one of full sets (8 bytes a shingle).
TILE, SET_TILE = 512, 128
#: Ids up to this number are broadcast (some 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def shingles(text: bytes, words: WordHash, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle; no words, none."""
    own = words.of(text.lower().split())
    if not len(own):
        return np.empty(0, np.uint64)
    return np.unique(windows64(own, n) if len(own) >= n else windows64(own, len(own), seed=len(own)))


def _borrowing(seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)]).astype(np.int16)


ORDER = _borrowing()
_BAND_SEEDS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The 256 registers (uint16) of a sorted set that is not empty."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    filled = bucket[first]
    low = (hashes[first] << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
    # The position of the first one, from the exponent of the top bits, which a double holds exactly.
    exponent = np.frexp((low >> np.uint64(12)).astype(np.float64))[1]
    zeros = np.where(low >> np.uint64(12) == 0, 52, 52 - exponent).astype(np.uint64)
    mantissa = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    if len(filled) < REGISTERS:
        empty = np.ones(REGISTERS, bool)
        empty[filled] = False
        at = np.flatnonzero(empty)
        out[at] = out[filled[ORDER[at][:, filled].argmin(axis=1)]]
    return out


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """64-bit hash of each band of each sketch: (documents, BANDS), as signed integers."""
    parts = registers[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(_BAND_SEEDS, parts.shape[:2]).copy()
    for i in range(ROWS):
        h = mix64(h * MULTIPLIER + parts[:, :, i] + np.uint64(1))
    return h.view(np.int64)


def estimate(equal: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | float:
    """Jaccard similarity from the number of equal registers, less the collisions expected of sets of these sizes."""
    big, small = np.maximum(n, m), np.minimum(n, m)
    ratio = big / np.maximum(small, 1)
    collisions = REGISTERS * 0.169919487159739 * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return (equal - collisions) / (REGISTERS - collisions)


FEATURES = "id long, n_shingles long, set_a long, set_b long, registers binary"


def _features(frame: DataFrame, with_sets: bool) -> DataFrame:
    """The sketch of each row, and its set (sorted 64-bit hashes) if asked for; empty sets have a null sketch."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        words = WordHash()
        for ids, texts in batches(it, ["id", "text"]):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                s = shingles(text or b"", words)
                raw = s.tobytes()
                whole = xxhash.xxh3_128_intdigest(raw)
                row = (i, len(s), (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63), sketch(s).tobytes() if len(s) else None)
                rows.append((*row, raw) if with_sets else row)
                if with_sets and len(rows) >= 500:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    def packed(rows: list[tuple]):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    schema = FEATURES + (", shingle_set binary" if with_sets else "")
    return frame.mapInArrow(run, schema)


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, node) of each sketch."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            for at in range(0, len(ids), 2000):
                h = band_hashes(regs[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), pa.array(np.repeat(ids[at : at + 2000], BANDS))], ["band", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "band long, node long")


def _among(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose column is among the ids; these are broadcast only if they are few."""
    return frame.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


def _near(equal: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int, slack: float) -> np.ndarray:
    """Pairs that may be similar enough, by the numbers of equal registers and of shingles."""
    return (estimate(equal, n, m) >= threshold / 100 - slack) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: int, slack: float) -> DataFrame:
    """Of the pairs (a, b), where a may be in many, those whose sketches are near enough."""
    own = _among(sketches, "node", checkpoint(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    own = materialize(own.dropDuplicates(["node", "set_a", "set_b"]).select("node", "n_shingles", "registers"), "compared")
    side = lambda k: own.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("registers").alias(f"registers_{k}"))
    centers = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(side("a"), "a"), "centers")
    once = centers.groupBy("a").agg(F.collect_list(F.struct("n_a", "registers_a")).alias("sketches"), F.first("n").alias("n"))  # an id may have several texts
    joined = join_counted(pairs, once, ["a"], width=600).select("a", "b", F.explode("sketches").alias("x")).select("a", "b", "x.n_a", "x.registers_a").join(side("b"), "b")

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            if not batch.num_rows:
                continue
            a, b, n, m, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n_a", "n_b", "registers_a", "registers_b"))
            equal = (fixed_rows(x).view(np.uint16) == fixed_rows(y).view(np.uint16)).sum(axis=1)
            mask = pa.array(_near(equal, n.to_numpy(), m.to_numpy(), threshold, slack))
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The full sets of the documents (id, text) with these ids (id), by node."""
    made = _features(_among(docs, "id", ids), True).where(F.col("n_shingles") > 0)
    return made.dropDuplicates(["id", "set_a", "set_b"]).select(F.col("id").alias("node"), "n_shingles", "registers", "shingle_set")


def _verify(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (a, b), those similar enough on their full sets."""
    sets = materialize(_sets(docs, checkpoint(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())).select("node", "shingle_set"), "sets")
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingle_set").alias(f"set_{k}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "set_a", "set_b"))
            mask = pa.array([similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), threshold) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def _split_buckets(members: DataFrame) -> DataFrame:
    """Members (band, node, label) of buckets in several parts, with the largest part's label and the numbers of members
    and of those outside it."""
    by = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    bands = by.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where(F.col("n") > F.col("most"))
    keys = bands.select("band", "main", (F.col("n") - F.col("most")).alias("others"), F.col("n").alias("size"), "n")
    return join_counted(members, materialize(keys, "split-buckets"), ["band"])


def _rare_buckets(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(band, node, label) of members (node, label) by the rare shingles in which a link must show; `band` is the shingle."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for nodes, found in batches(it, ["node", "shingle_set"]):
            for node, raw in zip(nodes, found, strict=True):
                own = np.frombuffer(raw, np.int64)
                whole = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), node)), pa.array(np.full(len(own), whole)), pa.array(np.full(len(own), len(own)))], ["band", "node", "whole", "size"])

    each = sets.select("node", "shingle_set").mapInArrow(run, "band long, node long, whole long, size long")
    counts = materialize(each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("band", F.col("n").alias("times"), "n"), "shingle-counts")
    shared = join_counted(each, counts, ["band"]).groupBy("node", "whole", "size").agg(F.array_sort(F.collect_list(F.struct("times", "band"))).alias("shared"))
    # Shingles of one set alone come first in the order; they take places of the prefix and meet nobody.
    places = F.col("size") - F.ceil(F.col("size") * threshold / 100) + 1 - (F.col("size") - F.size("shared"))
    rare = shared.where(places > 0).select("node", F.explode(F.slice("shared", F.lit(1), places.cast("int"))).alias("x")).select(F.col("x.band").alias("band"), "node")
    return rare.distinct().join(members.distinct(), "node").select("band", "node", "label")


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """Members dealt to the tiles of their bucket, as rows if outside its largest part, and as columns."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / tile)).cast("int")
    at = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("node")), blocks(n)).cast("int")
    cell = lambda r, c, row: F.struct(r.alias("tile_r"), c.alias("tile_c"), F.lit(row).alias("is_row"))
    columns = F.transform(F.sequence(F.lit(0), blocks("others") - 1), lambda r: cell(r, at("size", 1), False))
    rows = F.transform(F.sequence(F.lit(0), blocks("size") - 1), lambda c: cell(at("others", 2), c, True))
    every = F.when(F.col("label") != F.col("main"), F.concat(columns, rows)).otherwise(columns)
    dealt = members.withColumn("cell", F.explode(every)).select("band", "cell.*", "node", "label", "main", *[c for c in members.columns if c in ("n_shingles", "registers", "shingle_set")])
    return dealt.repartition("band", "tile_r", "tile_c").sortWithinPartitions("band", "tile_r", "tile_c")


def _by_tile(it: Iterator, n_columns: int) -> Iterator[list[tuple]]:
    """Rows of each tile in turn."""
    key, rows = None, []
    for batch in it:
        for r in zip(*[batch.column(i).to_pylist() for i in range(n_columns)], strict=True):
            if r[:3] != key:
                if rows:
                    yield rows
                key, rows = r[:3], []
            rows.append(r)
    if rows:
        yield rows


def _pairs_of_tile(rows: list[tuple], threshold: int, slack: float) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each row of a tile with the columns that have another label and a sketch near enough, nearest first.

    A pair that shares several bands is given in the first of them only, and one of two rows from the smaller node.
    """
    columns = list({(r[4], r[8]): r for r in rows if not r[3]}.values())
    left = list({(r[4], r[8]): r for r in rows if r[3]}.values())
    if not columns or not left:
        return
    regs = np.stack([np.frombuffer(r[8], np.uint16) for r in columns])
    nodes, labels, sizes = (np.array([r[k] for r in columns]) for k in (4, 5, 7))
    # A rare shingle is no band; its pairs may come from several of them.
    band = next(iter(np.flatnonzero(band_hashes(regs[:1])[0] == rows[0][0]).tolist()), 0)
    before = regs[:, : band * ROWS].reshape(len(columns), band, ROWS)
    for r in left:
        own = np.frombuffer(r[8], np.uint16)
        js = np.flatnonzero((labels != r[5]) & ((labels == r[6]) | (nodes > r[4])))
        equal = (regs[js] == own).sum(axis=1)
        near = _near(equal, sizes[js], np.int64(r[7]), threshold, slack)
        js, equal = js[near], equal[near]
        if band and len(js):
            first = ~(before[js] == own[: band * ROWS].reshape(band, ROWS)).all(axis=2).any(axis=1)
            js, equal = js[first], equal[first]
        if len(js):
            yield r, [columns[j] for j in js[np.argsort(-equal, kind="stable")]]


def _near_members(members: DataFrame, threshold: int, slack: float) -> DataFrame:
    """(band, node, label) of members that have a near sketch in another part of the bucket."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in _by_tile(it, 9):
            out = {(x[0], x[4], x[5]) for r, near in _pairs_of_tile(rows, threshold, slack) for x in (r, *near)}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sorted(out)], pa.int64()) for k in range(3)], ["band", "node", "label"])

    return _tiles(members, TILE).mapInArrow(run, "band long, node long, label long").distinct()


def _cross_links(members: DataFrame, threshold: int, slack: float) -> DataFrame:
    """Links of one bucket between nodes with different labels, on full sets.

    A pair that links found in the task already connect is skipped: a tile of n nodes gives fewer than n links.
    """

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        above: dict[int, int] = {}

        def part(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for r, near in _pairs_of_tile(rows, threshold, slack):
            for x in near:
                a, b = part(r[5]), part(x[5])
                if a != b and similar(np.frombuffer(r[9], np.uint64), np.frombuffer(x[9], np.uint64), threshold):
                    above[max(a, b)] = min(a, b)
                    yield min(r[4], x[4]), max(r[4], x[4])

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in _by_tile(it, 10):
            out = list(compare(rows))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _tiles(members, SET_TILE).mapInArrow(run, "a long, b long").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the smallest node reachable. Stars until nothing changes.

    Links may repeat and go either way; one from a node to itself, or with a null end, is none, and a node that has no other is
    not in the result. No links give an empty table.
    """
    edges = checkpoint(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        stat = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if stat == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = stat
        both = edges.union(edges.select("v", "u"))
        least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = join_counted(both.where(F.col("v") > F.col("u")), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = checkpoint(large)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_counted(large, least, ["u"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """One row for each document: its id, n_shingles, component_id, kept.

    Documents whose shingle sets have a Jaccard similarity of `threshold` percent or more are linked, and component_id
    is the smallest id reachable over links; kept says whether that is the row's own. Null or empty texts have no
    shingles and no links. Rows of one id are one document, so they are in one component, and each of them is returned.
    A row without id is linked to nothing, has a null component and is kept. An empty table gives an empty one; other
    columns are left out, whatever their names. Pairs meet in a band with a chance of 1 - (1 - s**6)**42 at least for a
    similarity of s: all but 1e-9 at 0.85, all but 3e-6 at 0.8; `slack` 1 checks every pair that has met on its full sets.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    features = materialize(_features(docs, False), "sketches")
    able = features.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    equal = materialize(able.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "equal-sets")
    nodes = join_counted(able, equal, ["set_a", "set_b"], "left").where(F.coalesce("rep", "id") == F.col("id")).select(F.col("id").alias("node"), "n_shingles", "set_a", "set_b", "registers")
    bands = _bands(nodes)
    shared = bands.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("center") != F.col("last"))
    members = materialize(join_counted(bands, materialize(shared.select("band", "center", F.col("n").alias("size"), "n"), "shared-bands"), ["band"]), "buckets")
    stars = checkpoint(members.where(F.col("node") != F.col("center")).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())
    named = docs.where(F.col("id").isNotNull())
    links = checkpoint(_verify(checkpoint(_estimated(stars, nodes, threshold, slack)), named, threshold))
    # Two steps along the links name most parts alike; equal labels always mean connected nodes.
    one = links.groupBy("b").agg(F.min("a").alias("a"))
    label = one.join(one.select(F.col("b").alias("a"), F.col("a").alias("top")), "a", "left").select(F.col("b").alias("node"), F.coalesce("top", "a").alias("label"))
    labelled = members.where(F.col("size") > 2).join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    again = checkpoint(_split_buckets(materialize(labelled, "labelled")))
    wide = again.where(F.col("others") > TILE).select("node", "label")
    rare = _rare_buckets(wide, _sets(named, checkpoint(wide.select(F.col("node").alias("id")).distinct())), threshold)
    again = checkpoint(again.where(F.col("others") <= TILE).unionByName(_split_buckets(materialize(rare, "rare-shingles"))))
    sketches = _among(nodes, "node", checkpoint(again.select("node").distinct())).select("node", "n_shingles", "registers")
    near = checkpoint(_near_members(again.join(sketches, "node"), threshold, slack))
    again = _split_buckets(near)
    sets = _sets(named, checkpoint(near.select(F.col("node").alias("id")).distinct()))
    # Rows of one id are one document, also where an equal set has given one of them another node.
    own = join_counted(features.where(F.col("id").isNotNull()).select("id", "set_a", "set_b"), equal, ["set_a", "set_b"], "left").select("id", F.coalesce("rep", "id").alias("node"))
    several = own.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(F.col("low") != F.col("high"))
    alike = own.join(several, "id").select(F.col("low").alias("a"), F.col("node").alias("b"))
    every = links.union(_cross_links(again.join(sets, "node"), threshold, slack)).union(alike)
    roots = connected_components(every)
    return (
        join_counted(features.drop("registers"), equal, ["set_a", "set_b"], "left")
        .withColumn("node", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id")))
        .join(roots, "node", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("root", "node").alias("component_id"), F.coalesce("root", "node").eqNullSafe(F.col("id")).alias("kept"))
    )


#: On whole tables only practical at test size: all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS ss FROM w),
e AS (SELECT doc_id, hash(unnest(ss)) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 85 * (len(a.ss) + len(b.ss) - n)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.doc_id WHERE r.c < b.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=85)
