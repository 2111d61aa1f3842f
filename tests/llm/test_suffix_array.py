"""Repeated byte strings against brute force: coverage, groups with all occurrences, large groups, long and periodic texts."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchmeans.llm import suffix_array
from tests.llm.test_operators import many_keys, odd_rows, table


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r) + 2, bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        kept = bytes(b for b, g in zip(r, gone[1:-1], strict=True) if not g)
        out.append((i, kept, len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum())))
    return out


def passages(seed, n=60, alphabet="ab cdé"):
    """Documents of pieces that recur, cut anywhere, with changed bytes here and there."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = "".join(p[rng.randint(0, 9) : rng.randint(30, 90)] for p in rng.choices(pool, k=rng.randint(0, 6)))
        text = "".join(rng.choice(alphabet) if rng.random() < 0.02 else ch for ch in text)
        rows.append((i, text))
    return rows


def check(spark, rows, length, anchor):
    got = suffix_array.suffix_dedup(table(spark, rows), length=length, anchor=anchor).select("doc_id", "kept", "n_bytes", "n_removed", "n_spans").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = brute(rows, length)
    assert sorted(((r[0], bytes(r[1]), *r[2:]) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("length,anchor", [(20, 6), (7, 7), (33, 1)])
def test_coverage(spark, length, anchor):
    check(spark, passages(length) + [(100, "ab" * 60), (101, "a" * 90), (102, "x" + "a" * 40)], length, anchor)


def test_production_length(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ij") for _ in range(3000))
    rows = [(i, base[i * 7 : i * 7 + 600 + i] + f" tail {i}") for i in range(25)] + [(50, base[100:299]), (51, base[100:300]), (52, "no repeat " + str(rng.random()))]
    rows += [(60 + k, "".join(rng.choice("xyz") if rng.random() < 0.006 else ch for ch in base[:1500])) for k in range(8)]
    check(spark, rows, suffix_array.LENGTH, suffix_array.ANCHOR)


def test_odd_rows(spark):
    check(spark, odd_rows(), suffix_array.LENGTH, suffix_array.ANCHOR)
    check(spark, [(i, (t or "")[:60]) for i, t in odd_rows()] + [(9, "same row\nsame row")], 5, 2)
    assert suffix_array.suffix_dedup(table(spark, [])).collect() == []
    assert suffix_array.maximal_repeats(table(spark, [])).collect() == []


@pytest.mark.parametrize("small,hot", [(1, None), (10, 3)])
def test_large_groups(spark, monkeypatch, small, hot):
    """One passage in all documents, with changes: its groups go through blocks of windows, down to single ones."""
    if hot:
        many_keys(monkeypatch, hot)
    monkeypatch.setattr(suffix_array, "SMALL", small)
    rng = random.Random(small)
    base = "".join(rng.choice("abcdefgh ij") for _ in range(140))
    rows = [(i, "".join(rng.choice("xyz") if rng.random() < 0.02 else ch for ch in base)) for i in range(40)]
    check(spark, rows + [(70 + i, base) for i in range(5)], 30, 8)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "PIECE", 64)
    check(spark, passages(5, 30), 20, 6)


@pytest.mark.parametrize("small", [4096, 2])
def test_repeats_have_all_occurrences(spark, monkeypatch, small):
    monkeypatch.setattr(suffix_array, "SMALL", small)
    length = 15
    rows = passages(9, 40) + [(100, "ab" * 40), (101, passages(9, 40)[3][1])]
    raw = {i: t.encode() for i, t in rows}
    groups = collections.defaultdict(set)
    for r in suffix_array.maximal_repeats(table(spark, rows), length=length, anchor=5).collect():
        groups[r.repeat, r.length].add((r.doc_id, r["at"]))
    covered = {i: np.zeros(len(b), bool) for i, b in raw.items()}
    for (_, n), places in groups.items():
        strings = {raw[i][a : a + n] for i, a in places}
        assert len(strings) == 1 and n >= length
        text = strings.pop()
        assert places == {(i, a) for i, b in raw.items() for a in range(len(b) - n + 1) if b[a : a + n] == text} and len(places) > 1
        for i, a in places:
            covered[i][a : a + n] = True
    assert {i: int(c.sum()) for i, c in covered.items()} == {i: n for i, _, _, n, _ in brute(rows, length)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=0, max_size=8), min_size=1, max_size=7), min_size=1, max_size=4))
def test_intervals(arrays):
    """Against all pairs: an interval is a set of members that share a prefix no other member has, taken as long as it is."""
    arrays = [sorted(a) for a in arrays if len(a) > 1]
    if not arrays:
        return
    common = []
    for a in arrays:
        common += [0, *[next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for x, y in zip(a, a[1:], strict=False)]]
    low, high, size = suffix_array.intervals(np.array(common), np.array([len(a) for a in arrays]))
    want, at = set(), 0
    for a in arrays:
        for n in range(9):
            for p in {x[:n] for x in a if len(x) >= n}:
                own = [k for k, x in enumerate(a) if x.startswith(p)]
                if len(own) > 1 and (len({x[: n + 1] for k, x in enumerate(a) if k in own}) > 1 or any(len(a[k]) == n for k in own)):
                    want.add((at + own[0], at + own[-1], n))
        at += len(a)
    assert set(zip(low.tolist(), high.tolist(), size.tolist(), strict=True)) == want


def test_longest():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 17, 64):
        low = rng.integers(0, n, 20)
        high = np.minimum(n - 1, low + rng.integers(0, n, 20))
        size = rng.integers(1, 50, 20)
        want = [max([int(s) for a, b, s in zip(low, high, size, strict=True) if a <= k <= b], default=0) for k in range(n)]
        assert suffix_array.longest(n, low, high, size).tolist() == want


def test_digest_of_the_query(spark):
    from tests.conftest import DATA
    import duckdb

    rows = [(i, t) for i, t in duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' where doc_id % 9 = 0").fetchall()]
    got = suffix_array.suffix_dedup(table(spark, rows)).collect()
    want = {i: (hashlib.sha256(k).hexdigest(), n, r, s) for i, k, n, r, s in brute(rows, 200)}
    assert {r.doc_id: (hashlib.sha256(r.kept).hexdigest(), r.n_bytes, r.n_removed, r.n_spans) for r in got} == want
