"""Quality rules: how far a document's characters and common words lie from its language.

Two passes. The first counts, over all documents, character classes and words for each language; the reference of a
language is its class histogram and the words that make up at least COMMON_SHARE of it, of which there can be no more
than 1/COMMON_SHARE, so what reaches the driver is bounded whatever the input. The second pass compares each document
with its reference by Jensen-Shannon distance and computes the plain counts. Nothing but counts is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchmeans.llm.common import batches, plain

CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "quote", "symbol", "other", "wide")
SYMBOLS = b"#*$%&|<>"
#: A word is common in a language if it is at least this share of its words. A parameter: it bounds what the driver holds.
COMMON_SHARE = 0.002
#: A language has a reference of its own if it is at least this share of all words; others use that of all languages. A
#: parameter, too: with 0 every language has its own, and as many references as there are languages go to the tasks.
LANG_SHARE = 0.0001
#: Distances above these fail, at the least numbers of words given; below that the test is not made.
MAX_CLASS_DISTANCE, CLASS_MIN_WORDS = 0.31, 50
MAX_WORD_DISTANCE, WORD_MIN_WORDS = 0.47, 50
FLUSH_WORDS = 200_000


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for name, chars in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("space", b" \t\x0b\x0c\r"), ("line", b"\n"), ("stop", b".,;:!?"), ("quote", b"'\"()[]{}-"), ("symbol", SYMBOLS)):
        table[list(chars)] = CLASSES.index(name)
    table[0xC0:] = CLASSES.index("wide")
    table[0x80:0xC0] = len(CLASSES)  # later bytes of a character, not counted
    return table


TABLE = _class_table()


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence to base 2; 0 for equal, 1 for disjoint distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words inside windows of n words that are found twice or more."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    rank = a
    for i in range(1, n):  # names of ever longer windows, exact at any length of text
        _, rank = np.unique(rank[: len(a) - i] * np.int64(len(ids)) + a[i:], return_inverse=True)
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    marks = np.zeros(len(a) + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + n, -1)
    return int((np.cumsum(marks) > 0).sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)
    points = int(chars[: len(CLASSES)].sum()) - int(chars[CLASSES.index("space")] + chars[CLASSES.index("line")])
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), points, int(chars[CLASSES.index("symbol")]), len(lines) - len(set(lines)), repeat_words(words)


def references(docs: DataFrame, common_share: float = COMMON_SHARE, lang_share: float = LANG_SHARE) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """For each language, "" for all: class distribution, number of each common word, distribution of these and the rest.

    `docs` is (lang, text). A null language is "" and a null text has no words; without any word there are no references. Every
    row counts, repeated ones too.
    """
    if not 0 < common_share <= 1 or not 0 <= lang_share <= 1:
        raise ValueError("common_share must be in (0, 1], lang_share in [0, 1]")

    def count(it: Iterator) -> Iterator:
        import pyarrow as pa

        words: Counter = Counter()

        def out(c: Counter) -> pa.RecordBatch:
            keys = list(c)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "class", "n"])

        for langs, texts in batches(it, ["lang", "text"]):
            for lang, text in zip(langs, texts, strict=True):
                lang = (lang or b"").decode()
                text = text or b""
                own = text.split()
                for w, n in Counter(plain(own)).items():
                    words[lang, w, -1] += n
                words[lang, None, -2] += len(own)
                for k, n in enumerate(class_counts(text).tolist()):
                    if n:
                        words[lang, None, k] += n
                if len(words) > FLUSH_WORDS:
                    yield out(words)
                    words.clear()
        if words:
            yield out(words)

    counts = docs.mapInArrow(count, "lang string, word binary, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n")).persist()
    try:
        totals = counts.where(F.col("class") == -2).groupBy("lang").agg(F.sum("n").alias("n"))
        whole = totals.agg(F.sum("n")).first()[0] or 0
        known = {r["lang"]: r["n"] for r in totals.where(F.col("n") >= max(1, lang_share * whole)).collect()}
        if not known:
            return {}
        kept = counts.where(F.col("lang").isin(list(known)))
        least = F.create_map(*[F.lit(v) for k, n in known.items() for v in (k, common_share * n)])
        common = kept.where((F.col("class") == -1) & (F.col("n") >= least[F.col("lang")])).collect()
        classes = kept.where(F.col("class") >= 0).collect()
        every = counts.where(F.col("class") == -1).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= common_share * whole).collect()
        all_classes = counts.where(F.col("class") >= 0).groupBy("class").agg(F.sum("n").alias("n")).collect()
    finally:
        counts.unpersist()

    def reference(rows, by_class, n: int):
        histogram = np.zeros(len(CLASSES))
        for r in by_class:
            histogram[r["class"]] += r["n"]
        rows = sorted(((r["n"], bytes(r["word"])) for r in rows), key=lambda x: (-x[0], x[1]))
        shares = np.array([x[0] for x in rows] + [max(0, n - sum(x[0] for x in rows))], float)
        return histogram / max(1.0, histogram.sum()), {w: i for i, (_, w) in enumerate(rows)}, shares / max(1.0, shares.sum())

    out = {lang: reference([r for r in common if r["lang"] == lang], [r for r in classes if r["lang"] == lang], n) for lang, n in known.items()}
    return out | {"": reference(every, all_classes, whole)}


RESULT = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def distances(text: bytes, words: list[bytes], reference) -> tuple[float | None, float | None]:
    histogram, common, shares = reference
    counts = class_counts(text).astype(float)
    a = js_distance(counts / counts.sum(), histogram) if len(words) >= CLASS_MIN_WORDS else None
    b = None
    if len(words) >= WORD_MIN_WORDS:
        seen = np.bincount([common.get(w, len(common)) for w in plain(words)], minlength=len(common) + 1).astype(float)
        b = js_distance(seen / seen.sum(), shares)
    return a, b


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, common_share: float = COMMON_SHARE, lang_share: float = LANG_SHARE) -> DataFrame:
    """One row for each document: its id, base counts, the two distances (null where too short to test), base_failed, kept.

    Null texts have no words, and fail the base. A language is compared with its own reference if it has lang_share of all words or
    more (0: always), else with that of all languages together, as a null one is. Words of common_share or more of a
    language make its histogram, with the rest as one. Rows that repeat are judged each; ids may be null; an empty table gives an empty one; other columns are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = references(docs, common_share, lang_share)

    def judge(it: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, texts, langs in batches(it, ["id", "text", "lang"]):
            rows = []
            for i, text, lang in zip(ids, texts, langs, strict=True):
                text = text or b""
                words = text.split()
                counts = base_counts(text, words)
                a, b = distances(text, words, known.get((lang or b"").decode()) or known[""]) if words else (None, None)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                rows.append((i, *counts, a, b, failed, not failed and (a is None or a <= max_class_distance) and (b is None or b <= max_word_distance)))
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 6 + [pa.float64()] * 2 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return docs.mapInArrow(judge, RESULT).withColumnRenamed("id", id_col)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
