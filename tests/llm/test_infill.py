"""Fill-in-middle against a regular expression over code points, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchmeans.llm import infill
from tests.llm.test_operators import odd_rows, table

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
HELD = ["a <P> b", "<S>", "x<M>", "<P", "S> a <", "<<S <M", "P><S"]


def brute(i, text, seed=42, percent=50, spm=80, marks=infill.MARKS):
    text = text or ""
    units = UNIT.findall(text)
    d = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if not text or any(k in text for k in marks) or h[2] % 100 >= percent:
        return i, text, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return i, s + z + p + x + m + y, n, "spm", len(x), len(y), text
    return i, p + x + s + z + m + y, n, "psm", len(x), len(y), text


@pytest.mark.parametrize("size", [1, 64, infill.BYTES_AT_ONCE])
@pytest.mark.parametrize("options", [{}, {"percent": 100, "spm_percent": 50, "seed": 1}, {"percent": 100, "spm_percent": 30, "marks": ("<|pre|>", "<|suf|>", "<|mid|>")}, {"percent": 0}])
def test_infill_brute(spark, monkeypatch, size, options):
    monkeypatch.setattr(infill, "BYTES_AT_ONCE", size)
    texts = [*HELD, *[t for _, t in odd_rows()], *["".join(np.random.default_rng(k).choice(list("ab \n\té中😀<>PSM"), k)) for k in range(60)]]
    rows = [*odd_rows(), *list(enumerate(texts))]
    names = {"marks", "seed", "percent"} & set(options)
    want = [brute(i, t, spm=options.get("spm_percent", 80), **{k: options[k] for k in names}) for i, t in rows]
    marks = {"marks": options["marks"]} if "marks" in options else {}
    out = infill.restore(infill.infill(table(spark, rows), **options), **marks)
    got = out.select("doc_id", "output", "n", "form", "prefix_chars", "middle_chars", "restored").collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\x0bé中😀"), max_size=12), min_size=1, max_size=8), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts(texts, h1, h2):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8) if offsets[-1] else np.empty(0, np.uint8)
    n, first, second = infill.cut(data, offsets, np.full(len(texts), h1), np.full(len(texts), h2))
    for k, t in enumerate(texts):
        units = UNIT.findall(t)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        assert (n[k], first[k] - offsets[k], second[k] - offsets[k]) == (len(units), len("".join(units[:a]).encode()), len("".join(units[:b]).encode()))


def test_marks_that_cannot_be_told_apart():
    for marks in (("aXa", "b", "c"), ("<P>", "<P>", "<M>"), ("<P>x", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            infill.check_marks(marks)


def test_no_rows(spark):
    out = infill.restore(infill.infill(table(spark, [])))
    assert out.columns == ["doc_id", "output", "n", "form", "prefix_chars", "middle_chars", "restored"] and not out.collect()


def test_forms_come_in_the_asked_shares(spark):
    rows = [(i, f"some words of text {i}") for i in range(4000)]
    forms = infill.infill(table(spark, rows), percent=50, spm_percent=80).groupBy("form").count().collect()
    counts = {r["form"]: r["count"] for r in forms}
    assert abs(counts["plain"] - 2000) < 150 and abs(counts["spm"] - 1600) < 150 and abs(counts["psm"] - 400) < 80
