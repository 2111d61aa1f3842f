"""Fill-in-middle: each text is cut into prefix, middle and suffix, which are put in another order between marks.

One numpy kernel works on the UTF-8 buffer of many rows at once. A table of 256 entries says which bytes are white space;
a unit ends where a byte that isn't is followed by one that is, and at the end of a text. The running count of such ends,
less the count at the start of a row, numbers the units of every row, and one searchsorted on it finds both cuts of all
rows. The hashes that choose the cuts and the form are column functions. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchmeans.llm.common import SPACES, text_of

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that the kernel holds at a time; a longer text is held alone.
BYTES_AT_ONCE = 4 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True


def check_marks(marks: tuple[str, ...]) -> None:
    """Marks must be found again where they were put: none in another, and no end of one that begins another."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(b.startswith(a[i:]) for i in range(1, len(a))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")
    if len(set(marks)) != 3:
        raise ValueError("three different marks are needed")


def gather(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces of `source`, one after the other."""
    to = np.cumsum(length) - length
    return source[np.repeat(start - to, length) + np.arange(int(length.sum()))]


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True at the last byte of every unit: blanks with the word after them, or the blanks a text ends with."""
    space = _SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    # A word at the end of one row and a blank at the start of the next are not a boundary of their own: the last byte of a
    # row ends a unit anyway, so nothing is marked that should not be.
    return ends


def cut(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each row, and the places in `data` where prefix and middle end."""
    count = np.cumsum(unit_ends(data, offsets), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    before = np.concatenate([[0], count])[offsets]
    n = np.diff(before).astype(np.int64)
    units = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    places = np.searchsorted(count, (before[:-1] + units).astype(count.dtype)) + 1
    return n, *np.where(units > 0, places, offsets[:-1])


def laid(source: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows made of several pieces each, (start, length) in `source`: the bytes of all rows, and their offsets."""
    start, length = (np.stack([p[i] for p in pieces], axis=1) for i in (0, 1))
    return gather(source, start.ravel(), length.ravel()), np.concatenate([[0], np.cumsum(length.sum(axis=1))])


def _strings(column) -> tuple[np.ndarray, np.ndarray]:
    """The buffer of a column of strings without nulls, and offsets from 0."""
    wide = str(column.type).startswith("large")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _column(data: np.ndarray, offsets: np.ndarray):
    import pyarrow as pa

    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def _slices(batch, column: int, most: int) -> Iterator:
    """Parts of a batch with some `most` bytes of text each."""
    _, offsets = _strings(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def infill(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """One row for each document: id, output, n (units), form (plain, psm or spm), prefix_chars, middle_chars.

    Of 100 texts `percent` are transformed, of these `spm_percent` with the suffix before the prefix. Cuts and form come
    from sha256 of seed and id, so they don't change with partitions or retries; rows of one id draw the same numbers, and
    a null id draws those of an empty one. An empty text, a null one, which counts as empty, and a text that holds a mark
    stay plain, with no prefix_chars and middle_chars. An empty table gives an empty one; other columns are left out.
    """
    check_marks(marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"), *[group(i) for i in range(4)])
    raw = [np.frombuffer(m.encode(), np.uint8) for m in marks]

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in it:
            for part in _slices(batch, 1, BYTES_AT_ONCE) if batch.num_rows else ():
                text = part.column(1)
                data, offsets = _strings(text)
                h = [part.column(2 + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
                n, first, second = cut(data, offsets, h[0], h[1])
                held = np.zeros(len(n), bool)
                for m in marks:
                    held |= pc.match_substring(text, m).to_numpy(zero_copy_only=False)
                size = np.diff(offsets)
                form = np.where((size == 0) | held | (h[2] % 100 >= percent), PLAIN, np.where(h[3] % 100 < spm_percent, SPM, PSM))
                start, end, moved = offsets[:-1], offsets[1:], form != PLAIN
                source = np.concatenate([data, *raw])
                p, q, m = (np.full(len(n), len(data) + at) for at in (0, len(raw[0]), len(raw[0]) + len(raw[1])))
                mark = [(at, np.where(moved, len(r), 0)) for at, r in zip((p, q, m), raw, strict=True)]
                head = (start, np.where(moved, first - start, size))  # a plain text is all prefix, without marks
                middle, tail = (first, np.where(moved, second - first, 0)), (second, np.where(moved, end - second, 0))
                # psm: P prefix S suffix M middle; spm: S suffix P prefix M middle.
                pick = lambda of_spm, other: tuple(np.where(form == SPM, a, b) for a, b in zip(of_spm, other, strict=True))
                out, to = laid(source, [pick(mark[1], mark[0]), pick(tail, head), pick(mark[0], mark[1]), pick(head, tail), mark[2], middle])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                count = lambda a, b: pa.array(chars[b] - chars[a], pa.int64(), mask=~moved)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _column(out, to), pa.array(n), pa.array(np.array(FORMS)[form].tolist(), pa.string()), count(start, first), count(first, second)],
                    ["id", "output", "n", "form", "prefix_chars", "middle_chars"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {id_type}, output string, n long, form string, prefix_chars long, middle_chars long")
    return out.withColumnRenamed("id", id_col)


def restore(out: DataFrame, marks: tuple[str, str, str] = MARKS, text_col: str = "restored") -> DataFrame:
    """The rows of infill() with the text rebuilt from output and form alone; a null output or form gives a null text."""
    check_marks(marks)

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in it:
            for part in _slices(batch.set_column(0, "output", pc.fill_null(batch.column(0), "")), 0, BYTES_AT_ONCE) if batch.num_rows else ():
                text = part.column(0)
                data, offsets = _strings(text)
                code = pc.fill_null(pc.index_in(part.column(1), pa.array(FORMS)), -1).to_numpy(zero_copy_only=False)
                moved = code > PLAIN
                at = []
                for m in marks:
                    found = pc.find_substring(text, m).to_numpy(zero_copy_only=False).astype(np.int64)
                    if (found[moved] < 0).any():
                        raise ValueError(f"an output without {m!r}")
                    at.append(offsets[:-1] + found)
                p, s, m = at
                lp, ls, lm = (len(x.encode()) for x in marks)
                spm = code == SPM
                head = (p + lp, np.where(spm, m, s) - p - lp)
                tail = (s + ls, np.where(spm, p, m) - s - ls)
                middle = (m + lm, offsets[1:] - m - lm)
                whole = (offsets[:-1], np.where(moved, 0, np.diff(offsets)))
                rebuilt = _column(*laid(data, [whole, *[(np.where(moved, a, 0), np.where(moved, b, 0)) for a, b in (head, middle, tail)]]))
                yield pa.RecordBatch.from_arrays([pc.if_else(pa.array(code < 0), pa.scalar(None, pa.string()), rebuilt), *part.columns[2:]], [text_col, *part.schema.names[2:]])

    carried = out.select("output", "form", *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(out.columns)])
    kept = ", ".join(f"keep_{i} {out.schema[c].dataType.simpleString()}" for i, c in enumerate(out.columns))
    rebuilt = carried.mapInArrow(run, f"{text_col} string, {kept}")
    return rebuilt.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(out.columns)], text_col)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS d FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op13_infill(spark, sf_dir: str) -> DataFrame:
    out = restore(infill(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
