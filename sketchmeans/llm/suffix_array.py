"""Repeated byte strings: sparse suffixes meet on winnowed anchors, and each group of them has a suffix array of its own.

1. Suffixes: of the grams of ANCHOR bytes in a window of LENGTH bytes the one with the smallest hash (the first of equals) is
   the window's anchor. Windows that follow each other and share an anchor make a context: the bytes from the first one's
   start to the last one's end. Equal windows have equal anchors at the same place, so they lie in contexts of one anchor,
   and each window lies in one context.
2. Contexts that are equal as a whole are counted with their anchors, as hashes, combined before the shuffle: all their
   bytes repeat, and one of them stands for all from here on. Only anchors with unlike contexts bring their bytes.
3. Suffix array: the windows of a group's contexts, each with what follows it in its context, are sorted; neighbours give
   common prefixes, and one scan with a stack makes the tree of common-prefix intervals of at least LENGTH bytes. An interval
   whose members are preceded by different bytes, or begin their contexts, is a maximal repeat: it is reported with all its
   members, and their bytes repeat.
4. A group of more than SMALL contexts is no task of its own: its windows are dealt into blocks by their distance to the
   anchor, and into smaller groups by all the bytes that the windows of a block share; steps 2 to 4 go on there, with blocks
   a quarter as wide, down to single windows, which step 2 settles.
No pair is formed, and no group is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchmeans.llm import common
from sketchmeans.llm.common import batches, join_counted, materialize, mix64, text_of, windows64
from sketchmeans.llm.substring_dedup import _sliding as sliding

LENGTH, ANCHOR = 200, 48
#: Groups of at most so many contexts have their suffix array in one task (a context has under 2 * LENGTH bytes).
SMALL = 1024
#: Bytes of text in which anchors are looked for at a time, at most 2^24; longer texts go piece by piece.
PIECE = 1 << 21
#: Bytes of contexts of whole groups that are sorted at a time.
SORTED_AT_ONCE = 1 << 21

BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACE = np.uint64((1 << 24) - 1)


def window_contexts(data: np.ndarray, start: np.ndarray, count: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Contexts of the windows that begin at start, start + 1, ... (`count` of them in each piece of `data`).

    Returns the number of the piece, the first window's start, the number of windows, the bytes from there to the anchor,
    and the anchor's hash.
    """
    none = np.empty(0, np.int64)
    if len(data) < length or not count.sum():
        return none, none, none, none, none.astype(np.uint64)
    grams = windows64(BYTE_HASH[data], anchor)
    # The place in the low bits picks the first of equal hashes and says where it is.
    least = sliding((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), length - anchor + 1, np.minimum)
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    place = (least[at] & PLACE).astype(np.int64)
    piece = np.repeat(np.arange(len(start)), count)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])]))
    return piece[new], at[new], np.diff(np.concatenate([new, [len(at)]])), place[new] - at[new], grams[place[new]]


def pieces(offsets: np.ndarray, length: int, most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, start, end) with some `most` bytes; pieces of one row overlap, so that every window is whole in one."""
    held, size = [], 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a < length:
            continue
        for s in range(a, b - length + 1, most):
            e = min(b, s + most + length - 1)
            if held and size + e - s > most:
                yield held
                held, size = [], 0
            held.append((row, s, e))
            size += e - s
    if held:
        yield held


def sorted_repeats(node: np.ndarray, data: np.ndarray, starts: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The enhanced suffix array of each group of contexts, and its maximal repeats.

    `node` names each context's group; context c has count[c] windows and the bytes from starts[c] on. Returns the members
    of the array (context, window) in order, and the repeats as (first member, last member, bytes).
    """
    c = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[c] + j
    key = mix64(windows64(BYTE_HASH[data], length)[at] ^ mix64(node)[c])
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(key)]]))
    # The byte before a window; that of a context's first window is not known, so it differs from all.
    left = np.where(j > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1 - c)[order]
    differs = np.concatenate([[False], left[1:] != left[:-1]]) & ~new
    diverse = np.add.reduceat(differs, first) > 0 if len(first) else np.empty(0, bool)
    use = np.repeat((size > 1) & diverse, size)
    order, left, size = order[use], left[use], size[(size > 1) & diverse]
    if not len(order):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    c, j, at = c[order], j[order], at[order]
    rest = count[c] - 1 - j
    width = -(-max(int(rest.max()), 1) // 8) * 8
    padded = np.concatenate([data, np.zeros(length + width, np.uint8)])
    follow = np.lib.stride_tricks.sliding_window_view(padded, width)[at + length]
    follow[np.arange(width)[None] >= rest[:, None]] = 0
    group = np.repeat(np.arange(len(size)), size)
    # Pairs need no order; of larger groups, members are ordered by what follows, a shorter one before its extensions.
    by = np.arange(len(order))
    many = np.flatnonzero(np.repeat(size > 2, size))
    if len(many):
        words = follow[many].view(">u8").astype(np.uint64)
        by[many] = many[np.lexsort((rest[many], *words.T[::-1], group[many]))]
    c, j, left, rest, follow = c[by], j[by], left[by], rest[by], follow[by]
    same = follow[1:] == follow[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    common = np.concatenate([[0], np.minimum(common, np.minimum(rest[1:], rest[:-1]))])
    low, high, shared = intervals(common, size)
    changes = np.cumsum(np.concatenate([[0], (left[1:] != left[:-1]).astype(np.int64)]))
    real = changes[high] > changes[low]
    return c, j, low[real], high[real], shared[real] + length


def intervals(common: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common-prefix intervals of several arrays that lie one after the other, `size` members each.

    common[i] is the common prefix of members i - 1 and i. All arrays are scanned in step, each with its own stack of open
    intervals (common prefix, first member). Returns (first member, last member, common prefix), each interval after those
    within it.
    """
    turn = np.argsort(-size, kind="stable")
    begin, n = (np.cumsum(size) - size)[turn], size[turn]
    depth_most = int(common.max()) + 2
    stack = np.full((len(n), depth_most), -1, np.int64)
    opened = np.zeros((len(n), depth_most), np.int64)
    depth = np.zeros(len(n), np.int64)
    out = []
    for step in range(1, int(n[0]) + 1 if len(n) else 0):
        live = int(np.searchsorted(-n, -step, "right"))  # arrays with `step` members or more; those with just as many end here
        row = np.arange(live)
        ends = n[:live] == step
        now = np.where(ends, -1, common[np.minimum(begin[:live] + step, len(common) - 1)])
        low = np.full(live, step - 1)
        while True:
            top = stack[row, np.maximum(depth[row] - 1, 0)]
            pop = row[(depth[row] > 0) & (top > now[row])]
            if not len(pop):
                break
            depth[pop] -= 1
            low[pop] = opened[pop, depth[pop]]
            out.append((begin[pop] + low[pop], begin[pop] + step - 1, stack[pop, depth[pop]]))
            row = pop
        row = np.arange(live)
        top = stack[row, np.maximum(depth[:live] - 1, 0)]
        push = row[~ends & ((depth[:live] == 0) | (top < now))]
        stack[push, depth[push]] = now[push]
        opened[push, depth[push]] = low[push]
        depth[push] += 1
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def longest(members: int, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each member the longest of the repeats that hold it, 0 without one: blocks of powers of two, halved downwards."""
    level = np.frexp(high - low + 1)[1] - 1
    best, top = np.zeros(members, np.int64), int(level.max(initial=0))
    for k in range(top, -1, -1):
        if k < top and members > 1 << k:  # a block of 2^(k+1) is two of 2^k
            best[1 << k :] = np.maximum(best[1 << k :], best[: members - (1 << k)])
        own = level == k
        np.maximum.at(best, low[own], size[own])
        np.maximum.at(best, high[own] - (1 << k) + 1, size[own])
    return best


def union(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each context, merged where they overlap or touch."""
    if not len(c):
        return c, start, end
    order = np.lexsort((start, c))
    c, start, end = c[order], start[order], end[order]
    most = int(end.max()) + 1
    reach = np.maximum.accumulate(c * most + end)
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (c[1:] * most + start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(c)]]) - 1
    return c[at], start[at], reach[last] - c[at] * most


ROW = "node_a long, node_b long, ctx long, id long, key long, at int, back int, windows int"
COLUMNS = ["node_a", "node_b", "ctx", "id", "key", "at", "back", "windows"]
#: With the bytes of a context, and how many equal ones it stands for.
FULL = ROW + ", times long, bytes binary"
NODE = ["node_a", "node_b"]
SPAN = "id long, key long, span long"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The buffer of a column of binaries, and offsets from 0."""
    wide = str(column.type).startswith("large")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _contexts(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """One row for each context of documents (id, key, text), as hashes."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            if not batch.num_rows:
                continue
            data, offsets = _bytes_of(batch.column(2))
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for held in pieces(offsets, length, PIECE):
                row, start, end = (np.array(x, np.int64) for x in zip(*held, strict=True))
                base = int(start[0])
                part = data[base : int(end[-1])]
                piece, at, windows, back, hashes = window_contexts(part, start - base, end - start - length + 1, length, anchor)
                whole = part.tobytes()
                ctx = [_signed(xxhash.xxh3_64_intdigest(whole[a : a + n + length - 1], b)) for a, n, b in zip(at.tolist(), windows.tolist(), back.tolist(), strict=True)]
                row = row[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(np.zeros(len(row), np.int64)), pa.array(ctx, pa.int64()), pa.array(ids[row]), pa.array(keys[row]), *[pa.array(x.astype(np.int32)) for x in (at + base - offsets[row], back, windows)]], COLUMNS
                )

    return docs.select("id", "key", F.col("text").cast("binary").alias("text")).mapInArrow(run, ROW)


def _with_bytes(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Contexts with their bytes, which their documents bring."""
    wanted = rows.groupBy("id", "key").agg(F.collect_list(F.struct(*NODE, "ctx", "at", "back", "windows", "times")).alias("contexts"))
    both = docs.join(wanted.hint("shuffle_merge"), ["id", "key"])

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        kinds, names = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.int64(), pa.binary()], [*COLUMNS, "times", "bytes"]
        for ids, keys, texts, contexts in batches(it, ["id", "key", "text", "contexts"]):
            out, size = [], 0
            for i, key, text, own in zip(ids, keys, texts, contexts, strict=True):
                for x in own:
                    out.append((x["node_a"], x["node_b"], x["ctx"], i, key, x["at"], x["back"], x["windows"], x["times"], text[x["at"] : x["at"] + x["windows"] + length - 1]))
                size += len(own)
                if size >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return both.select("id", "key", "text", "contexts").mapInArrow(run, FULL)


def _whole_groups(it: Iterator, columns: list[str]) -> Iterator[tuple]:
    """Batches of whole groups of rows sorted by node, some SORTED_AT_ONCE bytes each: node, the columns, data, offsets."""
    import pyarrow as pa

    held, size = [], 0
    names = [*NODE, *columns]

    def made(table):
        table = table.combine_chunks()
        column = table.column("bytes")
        data, offsets = _bytes_of(column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks))
        a, b, *others = (table.column(c).to_numpy().astype(np.int64) for c in names)
        return a, b, *others, data, offsets

    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= SORTED_AT_ONCE:
            every = pa.Table.from_batches(held)
            a, b = (every.column(c).to_numpy() for c in NODE)
            cut = int(((a != a[-1]) | (b != b[-1])).sum())  # rows are sorted, so those of the last group are at the end
            if cut:
                yield made(every.slice(0, cut))
            held, size = every.slice(cut).to_batches(), every.slice(cut).nbytes
    if held:
        yield made(pa.Table.from_batches(held))


def _small(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the maximal repeats of whole groups."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for a, b, ids, keys, at, windows, data, offsets in _whole_groups(it, ["id", "key", "at", "windows"]):
            node = mix64(a.view(np.uint64)) ^ b.view(np.uint64)
            c, j, low, high, size = sorted_repeats(node, data, offsets[:-1], windows, length)
            best = longest(len(c), low, high, size)
            some = best > 0
            c, start, end = union(c[some], j[some], j[some] + best[some])
            yield pa.RecordBatch.from_arrays([pa.array(ids[c]), pa.array(keys[c]), pa.array(((at[c] + start) << 32) | (at[c] + end))], ["id", "key", "span"])

    return rows.repartition(*NODE).sortWithinPartitions(*NODE).select(*COLUMNS, "bytes").mapInArrow(run, SPAN)


def _members(rows: DataFrame, length: int) -> DataFrame:
    """The maximal repeats of whole groups, a row for each member: its context, the place in it, and the repeat's name."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for a, b, ctx, back, windows, data, offsets in _whole_groups(it, ["ctx", "back", "windows"]):
            node = mix64(a.view(np.uint64)) ^ b.view(np.uint64)
            c, j, low, high, size = sorted_repeats(node, data, offsets[:-1], windows, length)
            for k in range(0, len(low), 1000):
                l, s = low[k : k + 1000], size[k : k + 1000]
                n = high[k : k + 1000] - l + 1
                which = np.repeat(np.arange(len(l)), n)
                m = np.repeat(l - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                begin = offsets[c[l]] + j[l]
                names = [_signed(xxhash.xxh3_64_intdigest(data[x : x + w].tobytes(), y)) for x, w, y in zip(begin.tolist(), s.tolist(), (back[c[l]] - j[l]).tolist(), strict=True)]
                of = c[m]
                yield pa.RecordBatch.from_arrays([pa.array(a[of]), pa.array(b[of]), pa.array(ctx[of]), pa.array(j[m].astype(np.int32)), pa.array(np.array(names, np.int64)[which]), pa.array(s[which].astype(np.int32))], [*NODE, "ctx", "shift", "repeat", "length"])

    return rows.repartition(*NODE).sortWithinPartitions(*NODE).select(*COLUMNS, "bytes").mapInArrow(run, "node_a long, node_b long, ctx long, shift int, repeat long, length int")


UP = ", up_a long, up_b long, up_ctx long, off int"


def _split(rows: DataFrame, width: int, length: int, anchor: int) -> DataFrame:
    """Contexts cut into blocks of `width` distances to the anchor, named by what a block's windows share; and whence they come."""
    far = length - anchor

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.int64(), pa.binary()] + [pa.int64()] * 3 + [pa.int32()]
        names = [*COLUMNS, "times", "bytes", "up_a", "up_b", "up_ctx", "off"]
        for values in batches(it, [*COLUMNS, "times", "bytes"]):
            out = []
            for a, b, ctx, i, key, at, back, windows, times, raw in zip(*values, strict=True):
                for block in range((back - windows + 1) // width, back // width + 1):
                    last = min(block * width + width - 1, far)
                    near, wide = max(block * width, back - windows + 1), min(last, back)
                    own = raw[back - wide : back - near + length]
                    core = raw[back - block * width : back - last + length]  # in every window of the block
                    name = xxhash.xxh3_128_digest(b"%d %d %d " % (a, b, block) + core)
                    node = (int.from_bytes(name[k : k + 8], "big", signed=True) for k in (0, 8))
                    out.append((*node, _signed(xxhash.xxh3_64_intdigest(own, wide)), i, key, at + back - wide, wide, wide - near + 1, times, own, a, b, ctx, back - wide))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return rows.select(*COLUMNS, "times", "bytes").mapInArrow(run, FULL + UP)


class Levels:
    """Contexts of documents (id, key, text) by level: all that share their group with another, and one of each kind.

    Level 0 has the groups of anchors; each further one has the groups that were too large, in blocks.
    """

    def __init__(self, docs: DataFrame, length: int, anchor: int):
        if not 0 < anchor <= length:
            raise ValueError("an anchor is 1 byte long or more, and no longer than a repeat")
        self.length = length
        one = F.min(F.struct("id", "key", "at", "back", "windows")).alias("one")
        every = materialize(_contexts(docs, length, anchor), "contexts")
        shared = materialize(every.groupBy("node_a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "shared-anchors")
        hot = shared.where(F.col("n") * common.HOT_KEYS >= every.count()).select("node_a")  # at most HOT_KEYS keys, as n adds up to all rows
        # Contexts of other anchors are dealt by anchor once, at every size; kinds are counted where they lie.
        kind = Window.partitionBy("node_a", "ctx")
        cold = every.join(F.broadcast(hot), "node_a", "left_anti").join(shared.select("node_a").hint("shuffle_merge"), "node_a", "left_semi")
        cold = cold.select(*COLUMNS, F.row_number().over(kind.orderBy("id", "key", "at")).alias("place"), F.count(F.lit(1)).over(kind).alias("times"))
        cold = materialize(cold.withColumn("kinds", F.sum((F.col("place") == 1).cast("long")).over(Window.partitionBy("node_a"))), "shared-contexts")
        # Those of hot anchors are counted first and joined apart.
        warm = materialize(every.join(F.broadcast(hot), "node_a").select(*COLUMNS), "hot-contexts")
        warm_kinds = materialize(warm.groupBy(*NODE, "ctx").agg(F.count(F.lit(1)).alias("n"), one), "hot-kinds")
        several = warm_kinds.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        ones = cold.where((F.col("place") == 1) & (F.col("kinds") > 1)).select(*COLUMNS, "times")
        ones = ones.unionByName(join_counted(warm_kinds.select(*NODE, "ctx", "one.*", F.col("n").alias("times")), several, NODE))
        rows = materialize(_with_bytes(docs, ones, length), "context-bytes")
        kinds = cold.where(F.col("place") == 1).select(*NODE, "ctx", F.col("times").alias("n"), F.struct("id", "key", "at", "back", "windows").alias("one"))
        #: For each level: all contexts, one of each kind with their number, the kinds that one task can sort, and the large groups.
        self.all, self.kinds, self.small, self.large = [cold.select(*COLUMNS).unionByName(warm)], [kinds.unionByName(warm_kinds)], [], []
        #: Contexts that occur again as a whole, of which nothing is looked for any more.
        self.again = [cold.where(F.col("times") > 1).select(*COLUMNS), _with_kind(warm, warm_kinds)]
        width = 1 << max(0, (length - anchor).bit_length() - 2)
        while True:
            large = materialize(rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select(*NODE, F.lit(True).alias("large"), "n"), "large-groups")
            some = not large.isEmpty()
            self.small.append(_apart(rows, large) if some else rows)
            if not some:
                break
            self.large.append(large)
            parts = materialize(_split(join_counted(rows, large, NODE), width, length, anchor), "blocks")
            kinds = materialize(parts.groupBy(*NODE, "ctx").agg(F.sum("times").alias("n"), one, F.first("bytes").alias("bytes")), "kinds-of-blocks")
            self.again.append(_with_kind(parts.drop("bytes"), kinds))
            self.all.append(parts.drop("bytes"))
            self.kinds.append(kinds)
            if width == 1:
                break  # single windows: those that occur again have just been found
            rows = kinds.select(*NODE, "ctx", "one.*", F.col("n").alias("times"), "bytes")
            width = max(1, width // 4)

    def spans(self) -> DataFrame:
        """(id, key, spans): repeated bytes as (start << 32 | end), some of them overlapping."""
        span = (F.shiftleft(F.col("at").cast("long"), 32) + F.col("at") + F.col("windows") + (self.length - 1)).alias("span")
        found = [rows.select("id", "key", span) for rows in self.again]
        found += [_small(rows, self.length) for rows in self.small]
        return _union(found).groupBy("id", "key").agg(F.collect_set("span").alias("spans"))

    def repeats(self) -> DataFrame:
        """(repeat, length, id, key, at): every occurrence of every maximal repeat."""
        found: list[DataFrame] = []
        for k in range(len(self.all) - 1, -1, -1):
            # A whole context that occurs again is a repeat itself; where its group is large, its blocks are on the next level.
            whole = _apart(_again(self.kinds[k]), self.large[k]) if k < len(self.large) else _again(self.kinds[k])
            windows = F.col("one.windows") + self.length - 1
            found.append(whole.select(*NODE, "ctx", F.lit(0).alias("shift"), F.col("ctx").alias("repeat"), windows.cast("int").alias("length")))
            if k < len(self.small):
                found.append(_members(self.small[k], self.length))
            # What is found holds for all contexts of a kind; each of them is one of a kind on the level before.
            placed = _union(found).join(self.all[k], [*NODE, "ctx"])
            if k:
                found = [placed.select(F.col("up_a").alias("node_a"), F.col("up_b").alias("node_b"), F.col("up_ctx").alias("ctx"), (F.col("shift") + F.col("off")).alias("shift"), "repeat", "length")]
        return placed.select("repeat", "length", "id", "key", (F.col("at") + F.col("shift")).alias("at")).distinct()


def _again(kinds: DataFrame) -> DataFrame:
    return kinds.where(F.col("n") > 1).select(*NODE, "ctx", "one", "n")


def _with_kind(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Contexts that occur again as a whole."""
    return join_counted(rows, _again(kinds).drop("one"), [*NODE, "ctx"])


def _apart(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows whose group is not a large one."""
    return join_counted(rows, large, NODE, "left").where(F.col("large").isNull()).drop("large")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text, doc): a null id is no key of a join, so such rows have one of their own, and a hash of the text beside it."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    key = F.when(F.col("doc").isNull(), F.xxhash64(F.lit(3), "text")).otherwise(F.xxhash64("text"))
    return base.select(F.coalesce("doc", F.lit(-(1 << 62))).alias("id"), key.alias("key"), "text", "doc")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Groups of equal byte strings of at least `length` bytes: a row (repeat, length, id, at) for each occurrence.

    `repeat` names the string (a hash of 64 bits). A repeat is maximal within the contexts it lies in, which have under twice
    `length` bytes: a longer common passage is a chain of overlapping repeats, each with all its occurrences, in the same
    document or in others; only in texts of more than PIECE bytes an occurrence over the edge of two pieces may be shorter.
    Rows of one id and text are one here. Null and empty texts have none, an empty table gives an empty one.
    """
    keyed = _docs(docs, id_col, text_col)
    found = Levels(keyed.select("id", "key", "text"), length, anchor).repeats()
    return found.select("repeat", "length", F.when(F.col("id") != -(1 << 62), F.col("id")).alias(id_col), "at")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row for each document: id, kept (the bytes that are left, as binary), n_bytes, n_removed, n_spans, spans.

    A byte goes if a string of `length` bytes holds it that also starts anywhere else, in the same document or another.
    `spans` lists start and end of what goes, one after the other, no two touching. Texts are UTF-8 bytes, so a cut may fall
    within a character. Null texts are empty. Rows with null ids or equal ids are documents like any other, and a repeated
    row repeats all its bytes. An empty table gives an empty one; other columns are left out.
    """
    keyed = _docs(docs, id_col, text_col)
    spans = Levels(keyed.select("id", "key", "text"), length, anchor).spans()

    def cut(it: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        for ids, texts, spans in batches(it, ["doc", "text", "spans"]):
            rows = []
            for i, text, own in zip(ids, texts, spans, strict=True):
                codes = np.array(own or [], np.int64)
                _, start, end = union(np.zeros(len(codes), np.int64), codes >> 32, codes & 0xFFFFFFFF)
                kept, last = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(text[last:s])
                    last = e
                kept.append(text[last:])
                rows.append((i, b"".join(kept), len(text), int((end - start).sum()), len(start), np.stack([start, end], axis=1).ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    both = keyed.join(spans.hint("shuffle_merge"), ["id", "key"], "left")
    out = both.select("doc", "text", "spans").mapInArrow(cut, "id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<int>")
    return out.withColumnRenamed("id", id_col)


ORACLE = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, n, s, x[2 * s + 1:2 * s + 4398] AS y FROM (SELECT r, x, length(x) // 2 AS n, unnest(range(0, greatest(length(x) // 2, 199) - 199, 2000)) AS s FROM w)),
g AS (SELECT r, s + i AS i, md5(y[2 * i + 1:2 * i + 400]) AS h FROM (SELECT r, s, y, unnest(range(least(2000, n - 199 - s))) AS i FROM p)),
s AS (SELECT r, i FROM g JOIN (SELECT h FROM g GROUP BY h HAVING count(*) > 1) USING (h)),
b AS (SELECT b.r, j, y, max(i) OVER (PARTITION BY b.r ORDER BY j) >= j - 199 AS gone
      FROM (SELECT r, unnest(range(length(x) // 2)) AS j, unnest(regexp_extract_all(x, '..')) AS y FROM w) b LEFT JOIN s ON s.r = b.r AND s.i = b.j),
f AS (SELECT r, j, y, coalesce(gone, false) AS gone, coalesce(lag(gone) OVER (PARTITION BY r ORDER BY j), false) AS before FROM b),
m AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_spans, string_agg(y, '' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM f GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM w LEFT JOIN m USING (r)
"""


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
