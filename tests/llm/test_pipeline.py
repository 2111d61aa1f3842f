"""Every stage of the pipeline against brute force, on the smallest table with odd rows, and run() on it."""

import collections
import hashlib
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sketchmeans.llm import common, mixing, toxicity
from sketchmeans.llm.common import EDGES
from tests.llm.test_operators import LONG, brute_components, brute_tiles, low, words_of

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, score double, found string, n int, row string, cell int, prob double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with odd rows and extra columns whose names clash."""
    path = tmp_path_factory.mktemp("corpus")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{name}.parquet", path / f"{name}.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*P.COLUMNS).collect()]
    a = rows[0][1]
    rows += [(None, None, None, None, None), (None, a, "en", "s", 1), (None, a, "en", "s", 1), (90001, None, None, "s", 0), (90002, "", "en", None, 0), (90003, "", "en", "s", 0), (90004, LONG, "en", "s", len(LONG)), (90005, LONG, "en", "s", len(LONG))]
    rows += [(90006, "repeated row " * 30, "de", "s", 9)] * 3 + [(90007, a, "en", "s", 5), (90007, "a text of its own " * 20, "fr", "t", 6), (90008, "a text of its own " * 20, "fr", "t", 6)]
    spark.createDataFrame([(*r, 1, True, 0.5, "f", 2, "r", 3, 0.1) for r in rows], SCHEMA).repartition(5).write.parquet(str(path / "documents.parquet"))
    return str(path)


def five(rows):
    return sorted(map(repr, (tuple(r[c] for c in P.COLUMNS) for r in rows)))


def brute_toxicity(spark, rows, folder):
    """The trained network, one text and one filter at a time."""
    schema = spark.read.parquet(f"{folder}/documents.parquet").select(*P.COLUMNS).schema
    model = toxicity.train(spark.createDataFrame([tuple(r[c] for c in P.COLUMNS) for r in rows], schema), spark.read.parquet(f"{folder}/labels.parquet"))
    out = []
    for r in rows:
        ids, lang = toxicity.encode((r["text"] or "").encode(), toxicity.WordHash())
        x = [model.table[i] for i in ids] + [np.zeros(toxicity.DIM)] * toxicity.PAD
        pooled = []
        for f, b in zip(model.filters, model.bias, strict=True):
            pooled += list(np.max([[max(0.0, sum(float(x[i + w] @ f[w][:, c]) for w in range(len(f))) + float(b[c])) for c in range(toxicity.FILTERS)] for i in range(len(ids))], axis=0)) if len(ids) < 400 else list(np.maximum(np.max(np.stack([sum(np.stack(x[w : w + len(ids)]) @ f[w] for w in range(len(f))) + b]), axis=1)[0], 0))
        z = float(np.dot(pooled, model.out)) + float(model.base) - float(model.shift[lang])
        if z < 0:
            out.append(r)
    return out


def brute_lines(spark, rows, folder):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    seen = collections.Counter(k for r in rows for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    kept = ["\n".join(x for x in (r["text"] or "").split("\n") if seen[key(x)] < 10) for r in rows]
    return [{**r, "text": t, "n_chars": len(t)} for r, t in zip(rows, kept, strict=True)]


def brute_near(spark, rows, folder):
    """Ids kept; of the rows of an id any one."""
    parts = brute_components([(r["doc_id"], r["text"]) for r in rows], 80)
    return {d for d, _, c in parts if d == c}


def brute_decontamination(spark, rows, folder):
    split = lambda t: [w for w in ("".join(c for c in low(x) if c not in EDGES.decode()) for x in words_of(t)) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [w for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if (w := split(r.text))]
    assert min(map(len, items)) >= 8
    out = []
    for r in rows:
        own = split(r["text"])
        seeds = grams(own)
        if not any(brute_tiles(w, own, 5) >= 0.6 * len(w) for w in items if grams(w) & seeds):
            out.append(r)
    return out


def topic(text, n):
    symbols = sum(text.count(c) for c in "#$%&*")
    tests = [("short", n < 50), ("table", text.count("|") * 5 > n), ("symbols", symbols * 4 > n), ("capitals", not re.search("[a-z]", text)), ("lines", text.count("\n") * 8 > n)]
    return next((name for name, yes in tests if yes), "prose")


def brute_mixing(spark, rows, folder):
    """Raking in plain loops. (row, topic, words, probability) of the drawn."""
    dims = mixing.DIMS
    made = []
    for r in rows:
        n = len(words_of(r["text"]))
        made.append({**r, "lang": r["lang"] or "", "source": r["source"] or "", "topic": topic(r["text"] or "", n), "n": n})
    cells = collections.Counter()
    for r in made:
        cells[tuple(r[d] for d in dims)] += r["n"]
    total = sum(cells.values())
    targets = {}
    for k, d in enumerate(dims):
        own = collections.Counter()
        for c, n in cells.items():
            own[c[k]] += n
        rule = mixing.MARGINALS[d]
        if isinstance(rule, float):
            whole = sum(n**rule for n in own.values())
            targets[d] = {v: n**rule / whole for v, n in own.items()}
        else:
            listed = sum(s for v, s in rule.items() if own.get(v))
            rest = sum(n for v, n in own.items() if v not in rule) / total
            targets[d] = {v: rule[v] / listed * (1 - rest) if v in rule else n / total for v, n in own.items()}
    need = mixing.BUDGET * total
    own = {c: n * mixing.BUDGET for c, n in cells.items()}

    def step(group, target):
        """One step of Newton's method from factor 1."""
        free = sum(own[c] for c in group if own[c] < cells[c])
        taken = sum(cells[c] for c in group if own[c] >= cells[c])
        whole = sum(own[c] for c in group)
        return max((target - taken) / free if free else 0.0, target / whole if whole else 0.0, 0.0)

    for _ in range(mixing.ROUNDS):
        for k, d in enumerate(dims):
            for v, share in targets[d].items():
                group = [c for c in cells if c[k] == v]
                if share * need >= sum(cells[c] for c in group):
                    f = 2 * max((cells[c] / own[c] for c in group if own[c]), default=0.0)
                else:
                    f = step(group, share * need)
                own.update({c: own[c] * f for c in group})
    for _ in range(mixing.SCALINGS):
        f = step(list(cells), need)
        own = {c: x * f for c, x in own.items()}
    out = []
    for r in made:
        c = tuple(r[d] for d in dims)
        prob = min(1.0, own[c] / cells[c]) if cells[c] else 1.0
        draw = int(hashlib.md5(f"mix|{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16) / 4294967296
        assert abs(draw - prob) > 1e-6
        if draw < prob:
            out.append((repr(tuple(r[x] for x in P.COLUMNS)), r["topic"], r["n"], prob))
    return out


def test_stages(spark, folder, tmp_path):
    """Each stage on its own input, which is what the one before has written."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES:
        rows = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = [r.asDict() for r in docs.collect()]
        if name == "near_dedup":
            kept = brute_near(spark, rows, folder)
            assert {repr(r["doc_id"]) for r in got} == {d for d in kept if d != "None"} | {repr(r["doc_id"]) for r in rows if r["doc_id"] is None}
            assert max(collections.Counter(r["doc_id"] for r in got if r["doc_id"] is not None).values()) == 1
            assert sum(r["doc_id"] is None for r in got) == sum(r["doc_id"] is None for r in rows)
            assert set(five(got)) <= set(five(rows))
        elif name == "mixing":
            want = brute_mixing(spark, rows, folder)
            mine = [(repr(tuple(r[c] for c in P.COLUMNS)), r["topic"], r["n_tokens"], r["prob"]) for r in got]
            assert len(mine) == len(want) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 for a, b in zip(sorted(mine), sorted(want), strict=True))
        else:
            want = {"toxicity": brute_toxicity, "line_dedup": brute_lines, "decontamination": brute_decontamination}[name](spark, rows, folder)
            assert five(got) == five(want)
            assert (len(got) == len(rows)) == (name == "line_dedup")
        if name != "mixing":
            assert docs.columns == list(P.COLUMNS)
    common.clean(spark)
    out = P.run(spark, folder)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    # Of all that the stages have written, the last one's table is left.
    where = spark._jvm.org.apache.hadoop.fs.Path(common.own_dir(spark))
    left = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    assert len(left) == 1 and left[0].startswith("pipeline-mixing")


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert not docs.collect()


def test_own_folder_goes(spark):
    """Nothing of a run is left once it is cleaned."""
    common.materialize(spark.range(3).withColumn("x", F.lit(1)), "t")
    where = spark._jvm.org.apache.hadoop.fs.Path(common.own_dir(spark))
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    assert system.exists(where)
    common.clean(spark)
    assert not system.exists(where)
