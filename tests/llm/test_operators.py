"""The ten operators: against SQL, against brute force on small tables, and on odd rows."""

import collections
import gzip
import hashlib
import math
import random
import time
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchmeans.llm import chat_format, common, decontaminate, language_model, line_dedup, minhash, mixing, quality, substring_dedup, toxicity, warc
from sketchmeans.llm.common import WordHash, new_path
from sketchmeans.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, node int, band int, n_lines int, score string, tokens string, weight string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))


def table(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "en", "a", 0, "x", 1, 2, 3, 4, "s", "t", "w") for i, t in rows], SCHEMA)


def odd_rows():
    """Null ids and texts, empty and blank texts, a very long one, repeated rows, and rows that share an id."""
    return [(None, None), (None, "a b c d e f"), (1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (6, "same row\nsame row"), (6, "same row\nsame row"), (7, "one"), (7, "two words"), (8, "é É ñ 中文 \x00 x"), (9, "l\r\nl\r\n\r\n")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, duck, name):
    out = QUERIES[name](spark, DATA).toPandas()
    expected = duck.sql(ORACLE_SQL[name]).df()
    assert rows_of(out[list(expected.columns)]) == rows_of(expected)


def many_keys(monkeypatch, hot):
    """Makes every table of counted keys one too large to broadcast; `hot` is the number of parts of which one is hot."""
    monkeypatch.setattr(common, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(common, "HOT_KEYS", hot)


@pytest.mark.parametrize("hot", [None, 0, 3, 1 << 20])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_counted(spark, monkeypatch, hot, how):
    if hot is not None:
        many_keys(monkeypatch, hot)
    rows = [(k, i % 5) for i, k in enumerate([1] * 60 + [2] * 20 + [3, 3, 4, None])]
    frame = spark.createDataFrame(rows, "k long, v int")
    keys = spark.createDataFrame([(1, "a", 60), (2, None, 20), (3, "c", 2)], "k long, name string, n long")
    names = {1: "a", 2: None, 3: "c"}
    expected = [(k, v, names.get(k)) for k, v in rows if how == "left" or k in names]
    got = common.join_counted(frame, keys, ["k"], how)
    assert got.columns == ["k", "v", "name"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("hot", [None, 8], ids=["broadcast", "shuffled"])
@pytest.mark.parametrize("rows", [[], odd_rows()], ids=["empty", "odd"])
def test_every_operator_takes_odd_tables(spark, monkeypatch, rows, hot):
    if hot is not None:
        many_keys(monkeypatch, hot)
    docs = table(spark, rows)
    items = spark.createDataFrame([(1, "one two three four five six"), (None, "x"), (2, None), (2, "b"), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (4, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for out in (
        line_dedup.line_dedup(docs, keep=("n_lines",) if not rows else ("lang",)),
        toxicity.score(docs, toxicity.train(docs, labels)),
        mixing.mix(docs),
        quality.quality(docs),
        decontaminate.decontaminate(docs, items),
        decontaminate.decontaminate(docs, items.limit(0)),
        language_model.language_model(docs),
        minhash.near_duplicates(docs),
        substring_dedup.substring_dedup(docs),
    ):
        assert len(out.collect()) == len(rows)


# --- op1 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [0, line_dedup.BROADCAST_LINES])
def test_line_dedup_brute(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    rng = random.Random(1)
    pool = ["Common Line", " common line\t", "COMMON LINE", "rare é", "É x", "", "  ", *[f"own {i}" for i in range(40)]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(40)] + odd_rows()
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    seen = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < 10]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = line_dedup.line_dedup(table(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


# --- op2 -------------------------------------------------------------------------------------------------------------


def toxic_table(spark, n=1200):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vileword", "Badword,", "uglyword"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns(spark):
    docs, labels = toxic_table(spark)
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_toxicity_uses_no_held_out_label(spark):
    docs, labels = toxic_table(spark, 300)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.train(docs, x)).orderBy("doc_id").toPandas().score for x in (labels, flipped))
    assert (a == b).all()


def test_gradients():
    """Against finite differences, in doubles."""
    model = toxicity.Model()
    for name in ("table", "out", "base"):
        setattr(model, name, getattr(model, name).astype(float) * 3)
    model.filters, model.bias = [f.astype(float) for f in model.filters], [b.astype(float) + 0.05 for b in model.bias]
    rng = np.random.default_rng(1)
    texts = [np.concatenate([rng.integers(0, 50, n), np.full(toxicity.PAD, toxicity.BUCKETS)]) for n in (0, 1, 5, 30, 30)]
    labels = np.array([0.0, 1, 1, 0, 1])

    def loss():
        p = 1 / (1 + np.exp(-(model.pooled(texts) @ model.out + model.base)))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    of_base, of_weights, rows, move = model.gradients(texts, labels)
    whole = np.zeros_like(model.table)
    whole[rows] = move
    checks = [(model.table, whole, (int(r), int(d))) for r in rows[:15] for d in (0, 5)]
    for w, g in zip([*model.filters, *model.bias, model.out], of_weights, strict=True):
        checks += [(w, g, np.unravel_index(i, w.shape)) for i in rng.integers(0, w.size, 8)]
    for w, g, at in checks:
        was = w[at]
        w[at] = was + 1e-5
        up = loss()
        w[at] = was - 1e-5
        slope, w[at] = (up - loss()) / 2e-5, was
        assert abs(slope - g[at]) < 1e-5, (slope, g[at])
    model.base += 1e-5
    up = loss()
    model.base -= 2e-5
    assert abs((up - loss()) / 2e-5 - of_base) < 1e-5


def test_toxicity_takes_one_text_of_an_id(spark):
    """A third of the rows under one learning id: what is collected holds one text of it."""
    docs, labels = toxic_table(spark, 200)
    many = docs.unionByName(table(spark, [(1, f"text {i} of one id") for i in range(400)]))
    model = toxicity.train(many, labels)
    same = toxicity.train(docs.where("doc_id != 1").unionByName(table(spark, [(1, min([r.text for r in docs.where("doc_id = 1").collect()] + [f"text {i} of one id" for i in range(400)]))])), labels)
    assert np.array_equal(model.table, same.table)


# --- op3 -------------------------------------------------------------------------------------------------------------


def test_mixing_meets_marginals(spark):
    cells = spark.createDataFrame([(s, lang, t, int(1000 * (1 + i))) for i, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in ("en", "de") for t in ("prose", "short"))], "source string, lang string, topic string, tokens long")
    out = mixing.rake(cells, {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 0.9, "short": 0.1}}, 0.1, 30).toPandas()
    for dim, shares in (("source", {"a": 0.7, "b": 0.3}), ("lang", {"en": 0.5, "de": 0.5}), ("topic", {"prose": 0.9, "short": 0.1})):
        got = out.groupby(dim).asked.sum() / out.asked.sum()
        assert all(abs(got[k] - v) < 1e-6 for k, v in shares.items())
    p = mixing.probabilities(spark.createDataFrame(out), 0.5).toPandas()
    assert abs((p.prob * p.tokens).sum() - 0.5 * p.tokens.sum()) < 1 and (p.prob <= 1).all()


# --- op4 -------------------------------------------------------------------------------------------------------------


def test_bounded_mixing_keeps_feasible_marginals(spark):
    """'short' can't reach its target; the other marginals, which can be met, are met by expected kept tokens."""
    cells = spark.createDataFrame([("a", "en", "prose", 500), ("a", "de", "prose", 300), ("b", "en", "prose", 400), ("b", "de", "prose", 300), ("a", "en", "short", 4), ("b", "de", "short", 2), ("b", "en", "short", 0)], "source string, lang string, topic string, tokens long")
    budget = 0.5
    raked = mixing.rake(cells, {"source": {"a": 0.3, "b": 0.7}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"prose": 0.8, "short": 0.2}}, budget)
    p = mixing.probabilities(raked, budget).toPandas()
    p["kept"] = p.tokens * p.prob
    assert ((p.prob >= 0) & (p.prob <= 1)).all() and abs(p.kept.sum() - budget * 1506) < 1e-6
    assert (p[p.topic == "short"].prob > 0.999).all()
    for dim, want in (("source", {"a": 0.3, "b": 0.7}), ("lang", {"en": 0.7, "de": 0.3})):
        got = p.groupby(dim).kept.sum() / p.kept.sum()
        assert all(abs(got[v] - w) < 0.01 for v, w in want.items()), got
    whole = mixing.probabilities(raked, 1.0).toPandas()
    assert (whole.prob == 1).all() and abs(whole.weight.sum() - 1) < 1e-9
    assert not mixing.probabilities(raked.limit(0), budget).collect()


def brute_base(text):
    words = words_of(text)
    spans = collections.defaultdict(list)
    for i in range(len(words) - 2):
        spans[tuple(words[i : i + 3])].append(i)
    covered = {i + d for at in spans.values() if len(at) > 1 for i in at for d in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAé #|\n\t中.", max_size=120))
def test_quality_base_counts(text):
    raw = text.encode()
    assert quality.base_counts(raw, raw.split()) == brute_base(text)


def test_quality_table(spark, duck):
    out = {r.doc_id: r for r in QUERIES["op4_quality"](spark, DATA).collect()}
    rows = duck.sql("select doc_id, text, quality from documents left join labels using (doc_id)").fetchall()
    for i, text, _ in rows:
        r = out[i]
        base = brute_base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.kept and r.base_failed)
    judged = [(q, out[i].kept) for i, _, q in rows if q is not None and not out[i].base_failed]
    assert np.mean([bool(q) == k for q, k in judged]) > 0.9


def brute_quality(rows, common_share=0.002, lang_share=0.0001):
    """(id, class distance, word distance, kept) of rows (id, text, lang), with nothing but counters and logarithms."""
    groups = [("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\x0b\x0c\r"), ("line", "\n"), ("stop", ".,;:!?"), ("quote", "'\"()[]{}-"), ("symbol", "#*$%&|<>")]
    kind = lambda ch: next((g for g, chars in groups if ch in chars), "other" if ord(ch) < 128 else "wide")
    bare = lambda t: [w for w in (low(w).strip(".,;:!?'\"()[]{}-") for w in words_of(t)) if w]
    share = lambda c: {k: n / sum(c.values()) for k, n in c.items()}

    def distance(p, q):
        part = lambda a, b: sum(v * math.log2(2 * v / (v + b.get(k, 0))) for k, v in a.items() if v)
        return math.sqrt(max(0, (part(p, q) + part(q, p)) / 2))

    chars, plain, n = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        for key in {lang or "", None}:
            chars[key].update(map(kind, text or ""))
            plain[key].update(bare(text))
            n[key] += len(words_of(text))
    own = {k for k in n if k is not None and n[k] >= max(1, lang_share * n[None])}
    out = []
    for i, text, lang in rows:
        key = (lang or "") if lang and lang in own else None
        words, base = words_of(text), brute_base(text or "")
        failed = len(words) < 50 or 100 * base[4] > 50 * len(words)
        a = b = None
        if len(words) >= 50:
            a = distance(share(collections.Counter(map(kind, text))), share(chars[key]))
            common = {w for w, k in plain[key].items() if k >= common_share * n[key]}
            fold = lambda c, total: {**{w: k / total for w, k in c.items() if w in common}, None: (total - sum(k for w, k in c.items() if w in common)) / total}  # noqa: B023, E731
            seen = collections.Counter(bare(text))
            b = distance(fold(seen, sum(seen.values())), fold(plain[key], n[key])) if seen else None
        out.append((i, a, b, not failed and (a is None or a <= 0.31) and (b is None or b <= 0.47)))
    return out


def same_quality(got, want):
    key = lambda r: repr((r[0], r[3], *(None if v is None else round(v, 6) for v in r[1:3])))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[3] == w[3] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(g[1:3], w[1:3], strict=True)), (g, w)


def test_quality_verdict_of_the_whole_table(spark, duck):
    """References, both distances and the verdict of every document, recomputed."""
    rows = duck.sql("select doc_id, text, lang from documents").fetchall()
    got = QUERIES["op4_quality"](spark, DATA).select("doc_id", "class_distance", "word_distance", "kept").collect()
    same_quality(map(tuple, got), brute_quality(rows))


@pytest.mark.parametrize("lang_share", [0, 0.2])
def test_quality_of_odd_rows_and_rare_languages(spark, lang_share):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "cat", "Dog,", "x#y", f"w{i}", "mañana"]) for _ in range(rng.randint(40, 90))), rng.choice(["en", "en", "en", "de", None])) for i in range(60)]
    rows += [(i, t, "xx" if k % 2 else None) for k, (i, t) in enumerate(odd_rows())] + [(500, "rare " * 30 + " ".join(f"r{k}" for k in range(40)), "rare")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, n_words int, kept string")
    got = quality.quality(docs, lang_share=lang_share).select("doc_id", "class_distance", "word_distance", "kept").collect()
    same_quality(map(tuple, got), brute_quality(rows, lang_share=lang_share))


def test_js_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert quality.js_distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


# --- op5 -------------------------------------------------------------------------------------------------------------

hostile = st.lists(st.sampled_from(["\\", "<|", "|>", "im_end", "<|im_end|>", "<|im_start|>", "\n", "a", "é", "assistant"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(hostile, hostile), max_size=5))
def test_chat_round_trip(turns):
    render = chat_format.compile_template(chat_format.CHATML)
    text, spans = render({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat_format.read_turns(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    run = lambda s, **env: chat_format.compile_template(s)(env)[0]
    assert run("{% for m in x %}{{ m.a }}{% if loop.last %}.{% else %},{% endif %}{% endfor %}", x=[{"a": 1}, {"a": 2}]) == "1,2."
    assert run("{% set y = 'a' + 'b' %}{{ y | upper }}{{ missing }}") == "AB"
    assert run("{% if 1 == 2 %}x{% elif not false %}y{% endif %}{{ x[1] }}", x=["p", "q"]) == "yq"
    folded = chat_format.fold_block(chat_format.parse("a{{ 'b' + 'c' }}{% if 1 < 2 %}d{% else %}{{ e }}{% endif %}"))
    assert folded == [chat_format.Text("abcd")]
    for bad in ("{% for x %}", "{{ a.__class__ }}", "{{ f(1) }}", "{% if x %}", "{{ x | nope }}", "{% import os %}", "{{ 'a }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (None, 0, None, "x"), (None, 3, "assistant", "y"), (2, None, "user\nx", ""), (3, 0, "assistant", LONG)]
    rows = spark.createDataFrame([(*r, "p", 1, "f") for r in rows], "conv_id long, turn long, role string, text string, spans string, start int, formatted string")
    every = chat_format.digests(chat_format.format_conversations(rows)).collect()
    out = {r.conv_id: r for r in every}
    assert out[1].n_turns == 3 and out[1].loss_chars == 2 and out[3].loss_chars == len(LONG)
    assert sorted((r.n_turns, r.loss_chars) for r in every if r.conv_id is None) == [(1, 0), (1, 0), (1, 1)]  # each alone
    assert out[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert out[2].turns_sha256 == hashlib.sha256(b"user\nx\n\n").hexdigest()
    assert not chat_format.digests(chat_format.format_conversations(rows.limit(0))).collect()


# --- op6 -------------------------------------------------------------------------------------------------------------


def brute_tiles(a, b, least):
    """Greedy string tiling by looking at every pair of places."""
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if not best:
            return total
        k, i, j = best
        for d in range(k):
            free_a[i + d] = free_b[j + d] = False
        total += k


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=18))
def test_tiling_is_greedy(a, b):
    words = WordHash()
    coded = [words.of([str(x).encode() for x in w]) for w in (a, b)]
    tiles = decontaminate.tile(*coded, 2)
    assert sum(k for _, _, k in tiles) == brute_tiles(a, b, 2)
    assert all(a[p : p + k] == b[t : t + k] for p, t, k in tiles)


@pytest.mark.parametrize(("n", "m"), [(800, 16000), (3, 4000)])
def test_tiling_of_equal_words_takes_no_time(n, m):
    """A text of one word over and over makes n + m matches, not n * m."""
    began = time.process_time()
    tiles = decontaminate.tile(np.full(n, 7, np.uint64), np.full(m, 7, np.uint64), min(n, 5))
    assert sum(k for _, _, k in tiles) == n and time.process_time() - began < 0.5


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 2000])
def test_decontamination_brute(spark, block_words):
    """Whole tables of the smallest size, with odd rows, in one block and in several: all documents against all items."""
    small = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs += [(-1, items[0][1]), (-1, items[0][1]), (None, items[1][1].upper()), (-2, None), (-3, ""), (-4, "yes, of course it is")]
    items += [(items[0][0], "another text under the same number of an item in this table"), (None, "no number"), (9000, None), (9001, ""), (9002, "of course it is"), (9003, "yes")]
    split = lambda t: [w for w in ("".join(c for c in low(x) if c not in ".,;:!?'\"()[]{}-") for x in words_of(t)) if w]
    code = {}
    number = lambda t: [code.setdefault(w, len(code)) for w in split(t)]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    tests = [(i, w, grams(w, min(5, len(w)))) for i, t in items if i is not None and (w := number(t))]
    want = []
    for d, t in docs:
        own = number(t)
        seeds = {n: grams(own, n) for n in range(1, 6)}
        best = {}
        for i, w, g in tests:
            if g & seeds[min(5, len(w))]:
                tiled = brute_tiles(w, own, min(5, len(w)))
                best[i] = max(best.get(i, (0, 0)), (tiled / len(w), tiled))
        top = min(((-c, i) for i, (c, _) in best.items()), default=(0, None))
        want.append((repr(d), sum(c >= 0.6 and n >= 8 for c, n in best.values()), repr(top[1]), round(-top[0], 9)))
    found = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    got = [(repr(r.doc_id), r.n_items, repr(r.item_id), round(r.coverage, 9)) for r in found.select("doc_id", "n_items", "item_id", "coverage").collect()]
    assert sorted(got) == sorted(want) and any(w[1] for w in want)


def test_decontamination_catches_reordered(spark):
    item = [f"t{i}" for i in range(30)]
    text = lambda w: "lead in " + " ".join(w) + " and the rest"
    docs = table(spark, [(1, text(item)), (2, text(item[20:] + ["x"] + item[:20])), (3, text(item[:10])), (4, "nothing here"), (5, text([w.upper() + "," for w in item]))])
    items = spark.createDataFrame([(10, " ".join(item)), (11, "tiny item")], "item_id long, text string")
    for block in (1_000_000, 20):
        got = {r.doc_id: (r.contaminated, r.item_id) for r in decontaminate.decontaminate(docs, items, block_words=block).collect()}
        assert {i for i, (c, _) in got.items() if c} == {1, 2, 5} and got[1][1] == 10


# --- op7 -------------------------------------------------------------------------------------------------------------


def test_language_model_base_scores(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["The", "the", "a", f"r{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + odd_rows()
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter(w for t in train for w in [*words_of(low(t)), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*words_of(low(t)), None]
        want.append((repr(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), 6)))
    got = [(repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in language_model.language_model(table(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def brute_tree(texts, depth=4):
    """Log probabilities by the textbook recursion, one decision at a time, over dictionaries."""
    nodes = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        raw = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                for k in range(8):
                    nodes[raw[i - d : i], (1 << k) | (raw[i] >> (8 - k))][(raw[i] >> (7 - k)) & 1] += 1
    children = collections.defaultdict(set)
    for c, q in nodes:
        if c:
            children[c[1:], q].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    known = {c for c, _ in nodes}
    inner = {c[1:] for c in known if c}

    def weighted(c, q):
        own = kt(*nodes[c, q]) if (c, q) in nodes else 0.0
        if c not in inner:
            return own, 1.0
        below = sum(weighted(x, q)[0] for x in children[c, q])
        mixed = np.logaddexp(own, below) - math.log(2)
        return mixed, math.exp(own - math.log(2) - mixed)

    def chance(context, q, bit):
        path = [context[len(context) - d :] for d in range(depth + 1)]
        path = [c for c in path if c in known]
        done, left = 0.0, 1.0
        for d, c in enumerate(path):
            a, b = nodes[c, q] if (c, q) in nodes else (0, 0)
            one = (b + 0.5) / (a + b + 1)
            stay = 1.0 if d == len(path) - 1 else weighted(c, q)[1]
            done, left = done + left * stay * one, left * (1 - stay)
        return done if bit else 1 - done

    def score(t):
        raw = b"\xff" * depth + t + b"\xff"
        return sum(math.log10(chance(raw[i - depth : i], (1 << k) | (raw[i] >> (8 - k)), (raw[i] >> (7 - k)) & 1)) for i in range(depth, len(raw)) for k in range(8))

    return score


@pytest.mark.parametrize("most", [1 << 21, 40])
def test_language_model_scores_every_context(spark, monkeypatch, most):
    """Scores of the query by brute force, of a corpus with many rare contexts; with all grams in the table, and with few."""
    monkeypatch.setattr(language_model, "TABLE_GRAMS", most)
    monkeypatch.setattr(language_model, "GRAMS_AT_ONCE", 500)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rare = [word() for _ in range(15)]  # each about as often as one byte in 10,000
    short = [(100, None), (101, ""), (102, "zz\u00e9 a"), (103, rare[0]), (103, rare[0]), (None, rare[1] + " q"), (None, rare[2])]
    rows = [(i, " ".join(rng.choice(["the", "a"]) for _ in range(900)) + " " + rng.choice(rare)) for i in range(45)] + short
    brute = brute_tree([(t or "").encode() for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10])
    want = sorted((repr(i), brute((t or "").encode())) for i, t in short)
    got = sorted((repr(r.doc_id), r.score) for r in language_model.language_model(table(spark, rows)).collect() if r.doc_id is None or r.doc_id >= 100)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], atol=1e-3), (got, want)


# --- op8 -------------------------------------------------------------------------------------------------------------


def brute_components(rows, threshold):
    sets = []
    for _, t in rows:
        w = words_of(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if rows[i][0] is not None and rows[j][0] is not None and (same or both and 100 * both >= threshold * len(sets[i] | sets[j])):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((repr(d), len(s), repr(least.get(root(i)) if d is not None else None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("threshold", "hot", "tile"), [(80, None, 512), (85, None, 7), (85, 8, 512), (85, 1 << 20, 3)])
def test_near_duplicates_brute(spark, monkeypatch, threshold, hot, tile):
    if hot is not None:
        many_keys(monkeypatch, hot)
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "SET_TILE", min(tile, 128))
    """A hub with variants that are linked to it but hardly to each other, chains of edits, copies and short texts."""
    rng = random.Random(4)
    rows, n = [], 0
    for base in range(6):
        words = [f"b{base}w{i}" for i in range(150)]
        for _ in range(40):
            w = list(words)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((n, " ".join(w)))
            n += 1
    chain = [f"c{i}" for i in range(120)]
    for _ in range(15):
        chain[rng.randrange(120)] = f"y{rng.random()}"
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n + i, t) for i, t in enumerate(["a b c", "A b C", "a b", "", None, "a b c d e f", "a b c d e"])]
    rng.shuffle(rows)
    rows = [(1000 - i, t) for i, (_, t) in enumerate(rows)] + [(None, "a b c"), (5, "a b c"), (5, "a b c")]
    # Ids with several texts: one that is a copy of another document's, one of its own, an empty one.
    rows += [(2000, rows[0][1]), (2000, "of its own " * 9), (1, rows[1][1]), (2001, rows[1][1]), (2001, rows[9][1]), (2002, "only here " * 8), (2002, "")]
    got = minhash.near_duplicates(table(spark, rows), threshold=threshold).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_components(rows, threshold)


def test_pairs_at_the_threshold_meet():
    """Of pairs just above the threshold, for sets of all sizes: each shares a band, and no estimate is `SLACK` too low."""
    rng = np.random.default_rng(8)
    missed, pairs = 0, 0
    for union in (7, 20, 54, 100, 300, 1000, 5000):
        for _ in range(300):
            pool = np.unique(rng.integers(0, 2**63, union, dtype=np.uint64) * np.uint64(2))
            both = -(-85 * len(pool) // 100)
            cut = both + int(rng.integers(0, len(pool) - both + 1))
            rng.shuffle(pool)
            a, b = np.sort(pool[:cut]), np.sort(np.concatenate([pool[:both], pool[cut:]]))
            if not minhash.similar(a, b, 85):
                continue
            pairs += 1
            x, y = minhash.sketch(a), minhash.sketch(b)
            meet = (minhash.band_hashes(x[None]) == minhash.band_hashes(y[None])).any()
            near = minhash._near(np.array([(x == y).sum()]), np.array([len(a)]), np.array([len(b)]), 85, minhash.SLACK)[0]
            missed += not (meet and near)
    assert pairs > 2000 and not missed


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.85):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
            both = int(2000 * share)
            a, b = np.sort(pool[:2000]), np.sort(pool[2000 - both : 4000 - both][:2000])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(minhash.estimate(int((minhash.sketch(a) == minhash.sketch(b)).sum()), len(a), len(b)) - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    links = [(i, i + 1) for i in range(60, 90)] + [(1, 5), (5, 3), (3, 2), (9, 2), (40, 41), (7, 7)]
    got = {r.node: r.root for r in minhash.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 60 for i in range(61, 91)) and {got[i] for i in (2, 3, 5, 9)} == {1} and got[41] == 40


# --- op9 -------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    first = {}
    windows = lambda w: [(i, tuple(w[i : i + window])) for i in range(len(w) - window + 1)]
    for d, t in rows:
        if d is not None:
            for _, x in windows(words_of(t)):
                first[x] = min(first.get(x, d), d)
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = {i + k for i, x in windows(w) if d is not None and first[x] < d for k in range(window)}
        out.append((repr(d), " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out)


@pytest.mark.parametrize("small", [0, 3, 1024])
def test_substring_dedup_of_few_words(spark, monkeypatch, small):
    """Words of a small alphabet, so that anchors are common and matches branch on both sides; groups of all sizes."""
    monkeypatch.setattr(substring_dedup, "SMALL", small)
    monkeypatch.setattr(substring_dedup, "PLACES_AT_ONCE", 50)
    rng = random.Random(small)
    rows = [(rng.randint(0, 150), " ".join(rng.choice("abc" if i % 2 else "ab") for _ in range(rng.randint(0, 40)))) for i in range(160)]
    got = [(repr(r.doc_id), r.text, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(table(spark, rows), window=9, anchor=4).collect()]
    assert sorted(got) == brute_repeats(rows, 9)


@pytest.mark.parametrize("small", [2, 1024])
@pytest.mark.parametrize("hot", [None, 8, 1 << 20])
def test_substring_dedup_brute(spark, monkeypatch, hot, small):
    monkeypatch.setattr(substring_dedup, "SMALL", small)
    if hot is not None:
        many_keys(monkeypatch, hot)
    rng = random.Random(6)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(49, 130))] for k in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [f"u{rng.random()}" for _ in range(rng.randint(0, 40))]
            p = rng.choice(passages)
            words += p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)]
        rows.append((100 - i, " ".join(words)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (50, "Case " * 60), (49, "case " * 60), (48, "rep " * 300), (47, "rep " * 51)]
    rows += odd_rows()
    got = [(repr(r.doc_id), r.text, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(table(spark, rows)).collect()]
    assert sorted(got) == brute_repeats(rows, 50)


# --- op10 ------------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    odd = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, ""), (4, "u\r\nv", None), (5, "http://c/", odd), (6, "é", "中é\x00\n"), (None, "n", "same"), (2, "http://b/", "same"), (7, "z", "x" * 3_000_000)]
    path = warc.write_warc(pages(spark, rows), new_path(spark, "t"))
    got = warc.read_warc(spark, path, verify=True).collect()
    assert len(got) == len(rows)
    by = {(r.record_id, r.record_type): r for r in got}
    assert by["<urn:page:2>", "response"].payload == b"same" and by["<urn:page:1>", "revisit"].refers_to == "<urn:page:2>"
    assert by["<urn:page:4>", "response"].payload == b"" and by["<urn:page:4>", "response"].target_uri == "u v"
    assert by["<urn:page:3>", "revisit"].refers_to == "<urn:page:4>" and by["<urn:page:none>", "revisit"].content_length == 0
    assert by["<urn:page:5>", "response"].payload.decode() == odd and by["<urn:page:6>", "response"].payload.decode() == rows[5][2]
    assert len(by["<urn:page:7>", "response"].payload) == 3_000_000
    assert all(r.block_digest_ok for r in got if r.record_type == "response")
    assert not warc.read_warc(spark, warc.write_warc(pages(spark, []), new_path(spark, "t"))).collect()


def test_warc_gzip_and_clashing_names(spark, tmp_path):
    """Gzip files, of many members too; extra columns are left out; repeated and null rows come back; a bad payload has no length."""
    rows = [(i, f"http://{i}/", f"body {i // 2}" * 300) for i in range(40)] + [(None, None, None), (7, "http://7/", "body 3" * 300)]
    frame = pages(spark, rows).selectExpr("*", "'a' as first", "1 as bytes", "'h' as hex", "'x' as id_", "'r' as revisit", "'d' as digest")
    path = warc.write_warc(frame, f"{tmp_path}/zip", compression="gzip")
    plain = warc.write_warc(frame, f"{tmp_path}/plain")
    read = lambda p: sorted(map(repr, warc.read_warc(spark, p, verify=True).collect()))
    assert len(read(path)) == 42 and read(path) == read(plain)
    parts = sorted(f for f in (tmp_path / "plain").iterdir() if f.name.startswith("part") and f.stat().st_size)
    many = tmp_path / "many.warc.gz"
    many.write_bytes(b"".join(gzip.compress(x + b"\r\n\r\n") for f in parts for x in f.read_bytes().split(b"\r\n\r\n") if x))
    assert len(read(str(many))) == 42
    for f in parts:
        f.write_bytes(f.read_bytes().replace(b"body 5body 5", b"body 6body 5"))
    out = warc.resolve(*[warc.read_warc(spark, plain, payload=False, verify=True).where(F.col("record_type") == kind) for kind in ("response", "revisit")]).collect()
    assert sorted(r.record_id for r in out if r.full_length is None) == ["<urn:page:10>", "<urn:page:11>"]
    assert all(r.full_length == len(rows[int(r.record_id[10:-1])][2]) for r in out if r.full_length)


def test_warc_pushes_filters(spark, tmp_path):
    path = warc.write_warc(pages(spark, [(i, f"http://{i}/", f"body {i // 2}") for i in range(10)]), new_path(spark, "t"))
    out = warc.read_warc(spark, path).where((F.col("record_type") == "revisit") & F.col("record_id").isin("<urn:page:0>", "<urn:page:1>"))
    assert [r.record_id for r in out.collect()] == ["<urn:page:0>"]
    reader = warc.WarcReader({"path": path})

    class Same:
        attribute, value = ("record_type",), "response"

    assert list(reader.pushFilters([Same()])) and not reader.allowed  # an unknown kind of filter is left to Spark
    reader.pushFilters([])
    cut = tmp_path / "cut.warc"
    cut.write_bytes(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(ValueError, match="cut off"):
        list(warc.WarcReader({"path": str(cut)}).records(open(cut, "rb")))


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """Pages that share a template and link to nothing: members and comparisons grow with the pages, not with their square."""
    compared = []
    near, tile = minhash._near_members, 20
    monkeypatch.setattr(minhash, "TILE", tile)

    def counted(members, *a):
        bands = members.groupBy("band").agg(F.first("others").alias("others"), F.count(F.lit(1)).alias("n")).collect()
        compared[-1] += sum(b.others * b.n for b in bands)
        return near(members, *a)

    monkeypatch.setattr(minhash, "_near_members", counted)
    boiler = [f"t{i}" for i in range(90)]
    for n in (150, 600):
        compared.append(0)
        rng = random.Random(n)
        rows = [(i, " ".join(boiler + [f"u{rng.random()}" for _ in range(25)])) for i in range(n)]
        rows += [(n + i, rows[i][1].rsplit(" ", 2)[0] + " one two") for i in range(5)]  # five of them with a near copy
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
        assert got == {i: i if i < n else i - n for i in range(n + 5)}
    assert compared[1] <= 3 * 4 * max(compared[0], 1) and compared[1] < 600 * 600
