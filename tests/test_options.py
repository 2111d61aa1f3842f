"""The public call and its options, on small made-up vectors."""

import logging
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchmeans.api import cluster
from sketchmeans.functions import transforms as T
from sketchmeans.functions.hashing import uniform, uniform_of
from sketchmeans.operators import centers as C
from sketchmeans.operators import init as I
from sketchmeans.operators import sketch as S
from sketchmeans.operators import twopass
from sketchmeans.operators.lloyd import EmptyCluster, lloyd
from sketchmeans.plans.params import Params, SketchShape
from sketchmeans.session import prepare
from sketchmeans.sources import vectors as V
from sketchmeans.streaming.ingest import sketch_stream


def blobs(spark, n=300, p=16, k=3, seed=1, parts=4):
    """k groups far from each other; the group is the id modulo k."""
    rng = np.random.default_rng(seed)
    mid = rng.standard_normal((k, p)) * 10
    rows = [(i, (mid[i % k] + 0.1 * rng.standard_normal(p)).tolist()) for i in range(n)]
    return prepare(spark).createDataFrame(rows, "id long, x array<double>").repartition(parts), mid


def same_groups(frame, k=3) -> bool:
    got = {}
    for r in frame.collect():
        got.setdefault(r.id % k, set()).add(r.k)
    return len(got) == k and all(len(v) == 1 for v in got.values()) and len(set.union(*got.values())) == k


@pytest.mark.parametrize("options", [
    {}, {"init": "sample"}, {"sparsify": True, "sparsity": 0.5}, {"sparsify": True, "sparsity": 0.5, "sketch": "dct"}, {"sparsify": True, "sparsity": 0.5, "sketch": "nothing"},
    {"sparsify": True, "sparsity": 0.5, "signs": "ones", "dense_centers": True}, {"sparsify": True, "sparsity": 0.5, "unbiased_distance": False, "unbiased_init": False},
    {"sparsify": True, "sparsity": 0.5, "ml_correction": False}, {"sparsify": True, "sparsity": 0.5, "min_overlap": 2}, {"sparsify": True, "sparsity": 0.5, "hashing": "md5"},
    {"sparsify": True, "sparsity": 0.5, "sketch": (lambda x: x[:, ::-1], lambda y: y[:, ::-1])}, {"missing": "zeros"},
])
def test_finds_groups(spark, options):
    data, mid = blobs(spark)
    result = cluster(data, 3, replicates=4, seed=3, **options)
    assert same_groups(result.two_pass_assignments)
    means = {}
    for r in result.two_pass_centers.collect():
        means.setdefault(r.k, {})[r.j] = r.c
    found = np.array([[m[j] for j in range(16)] for m in means.values()])
    assert all(np.abs(found - m).max(axis=1).min() < 0.2 for m in mid)
    assert np.abs(result.centers).max() < 100 and len(result.info.iterations) == 4 and result.info.time_overall > 0
    assert sum(r.n for r in result.sumd.collect()) == 300
    result.unpersist()


def test_sketch_of_uneven_length(spark):
    data, _ = blobs(spark, p=13)
    sizes = {}
    for given in (False, True):
        result = cluster(data, 3, sparsify=True, sparsity=0.3, sketch="hadamard", ignore_upsampling=given, seed=2)
        sizes[given] = {len(r.idx) for r in result.sketched.collect()}
        assert result.centers.shape == (3, 13)
    assert sizes == {False: {5}, True: {4}}  # 0.3 of 16 and of 13


@pytest.mark.parametrize("m", [32, 400, 512])
def test_wide_vectors_are_sampled_alike(spark, m):
    """512 entries go through numpy: m distinct sorted places of the mixed vector, each place equally often, seed by seed."""
    data, _ = blobs(spark, n=400, p=512)
    t, shape = T.Transform("hadamard", 512, 5), SketchShape(512, 512, m)
    rows = S.sketch(data, t, shape, 5).collect()
    again = {r.id: r.idx for r in S.sketch(data.repartition(9), t, shape, 5).collect()}
    raw = {r.id: np.array(r.x) for r in data.collect()}
    counts = np.zeros(512)
    for r in rows:
        assert r.idx == sorted(set(r.idx)) and len(r.idx) == m and r.idx == again[r.id]
        assert np.allclose(r.val, t.forward(raw[r.id][None])[0][r.idx])
        counts[r.idx] += 1
    assert counts.mean() == 400 * m / 512 and counts.std() < 2 * np.sqrt(400 * m / 512)
    if m < 512:
        assert len({tuple(r.idx) for r in rows}) == 400 and {r.id: r.idx for r in S.sketch(data, t, shape, 6).collect()} != again
    assert m > 32 or same_groups(cluster(data, 3, sparsify=True, sparsity=0.1, replicates=3).two_pass_assignments)


def test_sources(spark, tmp_path):
    data, _ = blobs(spark)
    data.write.parquet(str(tmp_path / "x"))
    with pytest.warns(UserWarning, match="ignored"):
        by_file = cluster("nowhere", 3, spark=spark, data_file=str(tmp_path / "x"), partition_mb=1)
    assert same_groups(by_file.assignments) and same_groups(cluster(str(tmp_path / "x"), 3, spark=spark).assignments)
    cells = data.selectExpr("id", "posexplode(x) as (j, v)")
    assert same_groups(cluster(cells, 3, samples="columns").assignments)
    with pytest.raises(ValueError, match="null"):
        cluster(cells.where("not (id = 3 and j = 0)"), 3, samples="columns")
    with pytest.raises(ValueError, match="vector column"):
        V.vector_column(data.selectExpr("x", "x as y"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        cluster("nowhere", 3, spark=spark)


@pytest.mark.parametrize("options", [{"sparsity": 0}, {"sparsity": 1.1}, {"replicates": 0}, {"max_iter": 0}, {"tol": -1}, {"init": "other"}, {"sketch": "other"}, {"sketch": (len,)}, {"empty_action": "x"}, {"samples": "x"}, {"verbose": "x"}, {"signs": "x"}, {"missing": "x"}, {"partition_mb": 0}, {"init": np.zeros((2, 16))}, {"init": np.zeros((3, 5))}])
def test_refused_options(spark, options):
    with pytest.raises(ValueError):
        cluster(blobs(spark)[0], 3, **options)


def test_refused_data(spark):
    data, _ = blobs(spark, 5)
    for bad, k in ((data, 6), (data, 0), (data.limit(0), 1), (data.selectExpr("id", "if(id = 1, null, x) x"), 2), (data.selectExpr("id", "if(id = 1, slice(x, 1, 3), x) x"), 2), (data.selectExpr("id", "transform(x, v -> double('NaN')) x"), 2)):
        with pytest.raises(ValueError):
            cluster(bad, k)


def test_given_centers_and_progress(spark, caplog):
    data, mid = blobs(spark)
    with pytest.warns(UserWarning, match="alike"), caplog.at_level(logging.INFO, "sketchmeans"):
        result = cluster(data, 3, init=mid, replicates=2, verbose="iter", print_every=1)
    assert result.info.objectives[0] == result.info.objectives[1] and same_groups(result.assignments)
    assert "partitions" in caplog.text and "iteration 1" in caplog.text and "best of 2" in caplog.text
    frame = spark.createDataFrame([(k + 1, c.tolist()) for k, c in enumerate(mid)], "k int, c array<double>")
    assert np.allclose(cluster(data, 3, init=frame).centers, result.centers)


def far(spark):
    data = prepare(spark).createDataFrame([(i, [float(i % 10), 0.0]) for i in range(20)] + [(20, [9.5, 0.0])], "id long, x array<double>")
    return data, C.Centers.full(np.array([[1000.0, 0.0], [1.0, 0.0], [9.0, 0.0]]))


def test_empty_clusters(spark):
    data, seeds = far(spark)
    with pytest.raises(EmptyCluster):
        lloyd(data, [seeds], C.Metric(2), Params(max_iter=1, empty_action="error"))
    with pytest.warns(UserWarning, match="lost all"):
        new, used, info = lloyd(data, [seeds], C.Metric(2), Params(max_iter=1, empty_action="drop"))
    rows = C.assign(data, used, C.Metric(2)).collect()
    assert len(new) == 2 and {r.k for r in rows} == {1, 2}  # labels of the centers that are left
    assert info.objectives[0] == pytest.approx(np.sqrt(sum(r.dist**2 for r in rows)))
    with pytest.warns(UserWarning, match="lost all"):
        new, _, _ = lloyd(data, [seeds], C.Metric(2), Params(max_iter=1))
    assert new.c[0].tolist() == [5.0, 0.0]  # farthest of its center, the smaller id of two


def test_repeated_ids_count_each(spark):
    rows = [(0, [0.0]), (0, [1.0]), (0, [2.0]), *[(i, [float(i % 2) * 10]) for i in range(1, 20)]]
    data = prepare(spark).createDataFrame(rows, "id long, x array<double>").repartition(3)
    used = C.Centers.full(np.array([[0.0], [10.0]]))
    got = {r.k: r.c for r in twopass.two_pass_centers(data, used, C.Metric(1)).collect()}
    low = [x[0] for _, x in rows if x[0] < 5]
    assert got == {1: pytest.approx(np.mean(low)), 2: 10.0}


def test_second_pass_joins_nothing(spark):
    data, _ = blobs(spark)
    result = cluster(data, 3, sparsify=True, sparsity=0.5)
    for frame in (result.two_pass_centers, result.two_pass_assignments):
        assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 5, 70])
@pytest.mark.parametrize("direct", [0, C.DIRECT_BYTES])
def test_sums_don_t_depend_on_partitions(spark, monkeypatch, parts, direct):
    monkeypatch.setattr(C, "DIRECT_BYTES", direct)
    data, mid = blobs(spark, 140, parts=parts)
    states = {0: C.Centers.full(mid), 3: C.Centers.full(mid + 1)}
    got = C.iterate(data, states, C.Metric(16))
    assert sorted(got) == [(r, k) for r in (0, 3) for k in range(3)]
    x = {r.id: np.array(r.x) for r in data.collect()}
    for (_, k), (n, _, sums, counts) in got.items():
        own = [v for i, v in x.items() if i % 3 == k]
        assert n == len(own) and np.allclose(sums, np.sum(own, axis=0)) and (counts == n).all()


@pytest.mark.parametrize("sketched", [False, True])
def test_seeding_keeps_the_least_distance(spark, sketched):
    """Round by round the same winners as with distances to all seeds at once."""
    data, _ = blobs(spark, 60)
    metric = C.Metric(16)
    if sketched:
        data, metric = S.sketch(data, T.Transform("none", 16), SketchShape(16, 16, 6), 1), C.Metric(16, 6 / 16)
    ids, seeds = I.init_kmeanspp(data, 6, metric, 4)
    assert len(set(ids)) == 6 and len(seeds) == 6
    rows = {r.id: r for r in data.collect()}
    draws = {(r.id, t): r[f"u{t}"] for r in data.select("id", *[I.uniform("xxhash64", 4, "pp", 0, t, S.F.col("id")).alias(f"u{t}") for t in range(6)]).collect() for t in range(6)}
    for t in range(1, 6):
        so_far = I.rows_as_centers([rows[i].asDict() for i in ids[:t]], 16)
        near = {r.id: r.dist**2 for r in C.assign(data, so_far, metric).collect() if r.id not in ids[:t]}
        race = {i: -np.log(draws[i, t]) / d for i, d in near.items() if d > 0}
        best = min(race.values())
        assert race[ids[t]] == pytest.approx(best) if race else True


def test_few_distinct_points(spark):
    data = prepare(spark).createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "id long, x array<double>")
    ids, _ = I.init_kmeanspp(data, 4, C.Metric(2), 0)
    assert len(set(ids)) == 4
    with pytest.raises(ValueError, match="only"):
        I.init_kmeanspp(data.limit(3), 4, C.Metric(2), 0)


def test_stream(spark, tmp_path):
    data, _ = blobs(spark)
    data.write.parquet(str(tmp_path / "in"))
    t, shape = T.Transform("hadamard", 16, 1), SketchShape(16, 16, 4)
    for extra in (0, 40):  # a second start goes on where the first has ended
        if extra:
            blobs(spark, extra, seed=9)[0].write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
        sketch_stream(stream, t, shape, str(tmp_path / "out"), str(tmp_path / "state"), 1).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out"))
        want = S.sketch(spark.read.parquet(str(tmp_path / "in")), t, shape, 1)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 300 + extra


def kmeanspp_by_hand(x, k, seed, rep):
    ids, out, near = np.arange(len(x)), [], None
    for t in range(k):
        u = uniform_of("xxhash64", ids, seed, "pp", rep, t)
        race = np.zeros(len(x)) if near is None else I._key(u, near)
        race[out] = np.nan
        out.append(int(np.lexsort((ids, u, race))[0]))
        d2 = ((x - x[out[-1]]) ** 2).sum(axis=1)
        near = d2 if near is None else np.minimum(near, d2)
    return out


@pytest.mark.parametrize("hashing", ["md5", "xxhash64"])
def test_hashes_in_numpy_are_those_of_the_columns(spark, hashing):
    ids = spark.range(50).select((F.col("id") * 7919 - 77).alias("id"))
    column = uniform(hashing, F.lit(5), F.lit("pp"), F.lit(2), F.lit(17), F.col("id"))
    rows = ids.select("id", column.alias("u")).collect()
    assert [r.u for r in rows] == uniform_of(hashing, np.array([r.id for r in rows]), 5, "pp", 2, 17).tolist()


@pytest.fixture
def five_hundred(spark):
    x = np.random.default_rng(0).standard_normal((500, 64))
    x[490:] = x[0]  # some rows are alike
    frame = prepare(spark).createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4).persist()
    frame.count()
    yield frame, x
    frame.unpersist()


@pytest.mark.parametrize("k,jobs", [(1, 1), (20, 5), (100, 8), (300, 10)])
def test_kmeanspp_in_few_jobs_is_that_of_one_round_a_job(five_hundred, monkeypatch, k, jobs):
    """All replicates in the same jobs, whose number hardly grows with k; every job has the same plan."""
    frame, x = five_hundred
    plans, races = [], I._races

    def counted(*a):
        out = races(*a)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return out

    monkeypatch.setattr(I, "_races", counted)
    began = time.time()
    found = I.seed_kmeanspp(frame, k, C.Metric(64), 7, [0, 1])
    assert [ids for ids, _ in found] == [kmeanspp_by_hand(x, k, 7, rep) for rep in (0, 1)]
    assert len(plans) <= jobs and len(set(plans)) == 1 and time.time() - began < 60
    assert all(np.array_equal(c.c, x[ids]) for ids, c in found)


def test_kmeanspp_where_leaders_do_not_decide(five_hundred, monkeypatch):
    """One leader a partition and far groups: rounds that could be won by others are played again."""
    monkeypatch.setattr(I, "LEADERS", 1)
    frame, x = five_hundred
    assert I.seed_kmeanspp(frame, 12, C.Metric(64), 3, [0])[0][0] == kmeanspp_by_hand(x, 12, 3, 0)


def test_more_seeds_than_unlike_rows(five_hundred):
    """Rows on a seed are drawn last, by their hashes; no row twice; more seeds than rows are an error."""
    frame, x = five_hundred
    few = frame.where("id >= 485")  # six unlike rows, ten more like each other
    ids, _ = I.init_kmeanspp(few, 15, C.Metric(64), 1)
    assert sorted(ids) == list(range(485, 500)) and len({tuple(x[i]) for i in ids[:6]}) == 6
    for seeds in (I.seed_kmeanspp, I.seed_parallel):
        with pytest.raises(ValueError):
            seeds(few, 16, C.Metric(64), 1, [0])
        with pytest.raises(ValueError):
            seeds(frame.where("id < 0"), 1, C.Metric(64), 1, [0])


def test_kmeans_parallel_jobs_and_quality(spark, five_hundred, monkeypatch):
    frame, x = five_hundred
    jobs = []
    for name in ("_races", "_costs", "_drawn", "_weights"):
        f = getattr(I, name)
        monkeypatch.setattr(I, name, lambda *a, f=f: (jobs.append(f.__name__), f(*a))[1])
    cost = lambda ids: ((x[:, None] - x[ids][None]) ** 2).sum(axis=2).min(axis=1).sum()
    for k in (8, 60):
        jobs.clear()
        found = I.seed_parallel(frame, k, C.Metric(64), 5, [0, 1])
        assert len(jobs) == 8 and all(len(set(ids)) == k for ids, _ in found) and found[0][0] != found[1][0]
        uniform_cost = np.mean([cost(np.random.default_rng(r).choice(500, k, replace=False)) for r in range(5)])
        assert all(cost(ids) < 1.05 * uniform_cost for ids, _ in found)
    apart, _ = blobs(spark, n=600, p=16, k=30)
    result = cluster(apart, 30, init="kmeans||", max_iter=20)
    assert same_groups(result.assignments, 30)
    with pytest.raises(ValueError):
        I.seed_parallel(frame, 1 << 22, C.Metric(1024), 1, [0])


def old_squared(idx, x, real, centers, metric):
    """Center by center and row by row."""
    out = np.empty((len(x), len(centers)))
    for k, (c, s, f) in enumerate(zip(centers.c, centers.support, metric.scales(centers), strict=True)):
        for i in range(len(x)):
            use = s[idx[i]] if real is None else s[idx[i]] & real[i]
            out[i, k] = (np.square(x[i] * metric.scale_v - c[idx[i]]) * use).sum() * f if use.sum() >= metric.min_overlap else np.inf
    return out


@pytest.mark.parametrize("thin", [0, 1000])
@pytest.mark.parametrize("padded", [False, True])
@pytest.mark.parametrize("metric", [C.Metric(40), C.Metric(40, 0.25), C.Metric(40, 0.25, False), C.Metric(40, 0.25, True, 3)])
@pytest.mark.parametrize("dense", [False, True])
def test_masked_distances(monkeypatch, thin, padded, metric, dense):
    """By products and place by place, over dense and masked centers, rows of unequal lengths, and rows on a center."""
    monkeypatch.setattr(C, "THIN", thin)
    monkeypatch.setattr(C, "BLOCK_BYTES", 8 * 200 * 7)
    rng = np.random.default_rng(4)
    idx = np.sort(np.argsort(rng.random((30, 40)), axis=1)[:, :10], axis=1)
    x = rng.standard_normal((30, 10)) * 1000
    real = rng.random((30, 10)) < 0.8 if padded else None
    if padded:
        idx, x = np.where(real, idx, 0), np.where(real, x, 0)
    support = np.ones((9, 40), bool) if dense else rng.random((9, 40)) < 0.5
    centers = C.Centers(np.where(support, rng.standard_normal((9, 40)) * 1000, 0), support)
    centers.c[3, idx[5]] = x[5] * metric.scale_v
    got, want = C.squared(idx, x, real, centers, metric), old_squared(idx, x, real, centers, metric)
    assert np.array_equal(np.isinf(got), np.isinf(want))
    fine = np.isfinite(want)
    assert np.allclose(got[fine], want[fine], rtol=1e-9, atol=1e-9)
    best, least = C.nearest(idx, x, real, centers, metric)
    assert np.allclose(least[np.isfinite(least)], want.min(axis=1)[np.isfinite(least)], rtol=1e-9, atol=1e-9)


def test_masked_distances_are_fast():
    """1000 centers of 1024 places, a sketch of 64: against the loop over centers it replaced."""
    rng = np.random.default_rng(2)
    idx = np.sort(np.argsort(rng.random((500, 1024)), axis=1)[:, :64], axis=1)
    x, support = rng.standard_normal((500, 64)), rng.random((1000, 1024)) < 0.9
    centers = C.Centers(np.where(support, rng.standard_normal((1000, 1024)), 0), support)
    metric = C.Metric(1024, 1 / 16)
    C.squared(idx, x, None, centers, metric)
    began = time.time()
    got = C.squared(idx, x, None, centers, metric)
    new, began = time.time() - began, time.time()
    want = np.empty_like(got)
    for k, (c, s, f) in enumerate(zip(centers.c, support, metric.scales(centers), strict=True)):
        want[:, k] = np.where(s[idx], np.square(x - c[idx]), 0).sum(axis=1) * f
    assert np.allclose(got, want) and new * 3 < time.time() - began


def test_one_scan_for_shape_and_sketch_and_one_for_the_second_pass(spark):
    """The first vector apart, raw vectors are read once before the second pass and once in it, whatever is asked of it."""
    data, _ = blobs(spark, n=400, p=16)
    data = data.persist()
    data.count()
    seen = spark.sparkContext.accumulator(0)

    def counted(it):
        for batch in it:
            seen.add(batch.num_rows)
            yield batch

    result = cluster(data.mapInArrow(counted, data.schema), 3, sparsify=True, sparsity=0.5, replicates=2, seed=3, max_iter=5)
    before = seen.value
    assert 400 <= before <= 500  # the probe for the length may read a partition
    assert result.two_pass_assignments.count() == 400 and len(result.two_pass_centers.collect()) == 48
    assert sum(r.n for r in result.two_pass_sumd.collect()) == 400
    assert seen.value - before == 400
    times = result.info.task_times
    assert times["second_read"] > 0 and times["second_centers"] > 0 and times["second_assignments"] > 0
    assert result.info.time_read_and_sketch > 0 and result.info.time_init > 0 and result.info.time_iterations > 0
    result.unpersist()
    data.unpersist()


def test_times_of_wide_vectors(spark):
    data, _ = blobs(spark, n=200, p=512)
    times = cluster(data, 3, sparsify=True, sparsity=0.1, max_iter=3).info.task_times
    assert times["read"] > 0 and times["mix"] > 0 and times["sample"] > 0 and times["second_read"] == 0


def test_second_pass_of_dense_runs_is_the_first(spark):
    data, _ = blobs(spark)
    result = cluster(data, 3, seed=3)
    with pytest.warns(UserWarning, match="second pass is the first"):
        assert result.two_pass_assignments is result.assignments
    with pytest.warns(UserWarning, match="second pass is the first"):
        assert result.two_pass_sumd is result.sumd
    with pytest.warns(UserWarning, match="second pass is the first"):
        rows = result.two_pass_centers.collect()
    assert np.array_equal(np.array([r.c for r in sorted(rows, key=lambda r: (r.k, r.j))]).reshape(3, 16), result.centers)


@pytest.mark.parametrize("p", [16, 300])
@pytest.mark.parametrize("sparsify", [False, True])
def test_bad_vectors_are_refused_by_the_pass_that_meets_them(spark, p, sparsify):
    good = [(i, [float(i + j) for j in range(p)]) for i in range(20)]
    for bad, message in (((99, [1.0]), "1 to"), ((99, None), "null"), ((99, [float("nan")] * p), "NaN"), ((99, [None] * p), "null")):
        data = prepare(spark).createDataFrame([*good, bad], "id long, x array<double>").repartition(3)
        with pytest.raises(ValueError, match=message):
            cluster(data, 2, sparsify=sparsify, sparsity=0.5)
    data = spark.createDataFrame(good, "id long, x array<double>")
    with pytest.raises(ValueError, match="20 vectors"):
        cluster(data, 21, sparsify=sparsify)
    with pytest.raises(ValueError, match="no vectors"):
        cluster(data.where("id < 0"), 2, sparsify=sparsify)


def test_replicates_beyond_the_bytes_of_centers_go_in_several_passes(spark, monkeypatch):
    data, _ = blobs(spark)
    states = {r: C.Centers.full(np.random.default_rng(r).standard_normal((3, 16))) for r in range(5)}
    whole = C.iterate(data, states, C.Metric(16))
    monkeypatch.setattr(C, "CENTERS_BYTES", 9 * 3 * 16 * 2)
    assert [list(g) for g in C.together(states, C.Metric(16))] == [[0, 1], [2, 3], [4]]
    again = C.iterate(data, states, C.Metric(16))
    assert whole.keys() == again.keys() and all(np.allclose(whole[k][2], again[k][2]) for k in whole)
    monkeypatch.setattr(C, "CENTERS_BYTES", 100)
    with pytest.raises(ValueError):
        C.iterate(data, states, C.Metric(16))
