"""Matrix files, the block transpose and the fast cosine transform against numpy."""

import time

import numpy as np
import pytest

from sketchmeans.api import cluster
from sketchmeans.functions import transforms as T
from sketchmeans.session import prepare
from sketchmeans.sources import matrix as M
from sketchmeans.sources import vectors as V

X = np.random.default_rng(1).standard_normal((137, 12))


def rows_of(frame):
    return [(r.id, r.x) for r in frame.orderBy("id").collect()]


def all_of(x):
    return [(i, v) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_written_and_read_back(spark, tmp_path, parts):
    """Any number of partitions gives the same matrix, and the files are cut by their size."""
    data = prepare(spark).createDataFrame([(i * 3 + 5, v.tolist()) for i, v in enumerate(X)], "id long, x array<double>").repartition(parts)
    path = f"file://{tmp_path}/m"
    M.write_matrix(data, path, 12 * 8 * 10 / 2**20)
    files = sorted((tmp_path / "m").glob("*.npy"))
    assert len(files) >= 14 and not list((tmp_path / "m").glob("_*"))
    assert np.array_equal(np.concatenate([np.load(f) for f in files]), X)
    assert M.matrix_file_shape(path) == (137, 12)
    for mb in (12 * 8 * 7 / 2**20, 1e-9, 1):
        frame = M.read_matrix(spark, path, partition_mb=mb)
        assert rows_of(frame) == all_of(X)
        assert frame.rdd.getNumPartitions() == -(-137 // M.chunk_rows(137, 12, mb))
    M.write_matrix(data.limit(3), path)
    assert M.matrix_file_shape(path) == (3, 12)


@pytest.mark.parametrize("samples", ["rows", "columns"])
@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["<f8", ">f4", "<i2", "u1"])
def test_orientations(spark, tmp_path, samples, order, dtype):
    x = (X * 20).astype(dtype) if dtype != "u1" else np.abs(X * 20).astype(dtype)
    given = x if samples == "rows" else x.T
    np.save(tmp_path / "a.npy", np.asarray(given[:50] if samples == "rows" else given[:, :50], order=order))
    np.save(tmp_path / "b.npy", np.asarray(given[50:] if samples == "rows" else given[:, 50:], order=order))
    frame = M.read_matrix(prepare(spark), str(tmp_path), samples, 12 * 8 * 20 / 2**20)
    assert rows_of(frame) == all_of(x.astype(float)) and frame.rdd.getNumPartitions() == 7


def test_files_that_are_no_matrix(spark, tmp_path):
    prepare(spark)
    (tmp_path / "bad.npy").write_bytes(b"no matrix at all")
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "words.npy", np.array([["a"]]))
    np.save(tmp_path / "good.npy", X)
    (tmp_path / "cut.npy").write_bytes((tmp_path / "good.npy").read_bytes()[:-8])
    for name in ("bad", "cube", "words", "cut", "absent"):
        with pytest.raises(ValueError):
            M.matrix_file_shape(str(tmp_path / f"{name}.npy"))
    folder = tmp_path / "ragged"
    folder.mkdir()
    with pytest.raises(ValueError):
        M.matrix_file_shape(str(folder))
    np.save(folder / "a.npy", X)
    np.save(folder / "b.npy", X[:, :3])
    with pytest.raises(ValueError, match="3 to 12"):
        M.matrix_file_shape(str(folder))
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        M.write_matrix(ragged, str(tmp_path / "out"))
    assert not [f for f in (tmp_path / "out").glob("*") if f.name.startswith("part-")]
    np.save(tmp_path / "none.npy", np.zeros((0, 12)))
    assert M.matrix_file_shape(str(tmp_path / "none.npy")) == (0, 12) and M.read_matrix(spark, str(tmp_path / "none.npy")).collect() == []


def test_cluster_reads_a_matrix_file_and_leaves_the_session_alone(spark, tmp_path):
    mid = np.random.default_rng(2).standard_normal((3, 12)) * 10
    x = mid[np.arange(120) % 3] + X[:120] * 0.1
    np.save(tmp_path / "x.npy", np.asfortranarray(x.T))
    before = prepare(spark).conf.get("spark.sql.files.maxPartitionBytes")
    result = cluster(str(tmp_path / "x.npy"), 3, spark=spark, samples="columns", partition_mb=0.005, seed=1, replicates=3)
    groups = {}
    for r in result.assignments.collect():
        groups.setdefault(r.id % 3, set()).add(r.k)
    assert sorted(map(len, groups.values())) == [1, 1, 1] and len(set.union(*groups.values())) == 3
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>").repartition(1).write.parquet(f"{tmp_path}/p")
    small = V.read(spark, f"{tmp_path}/p", partition_mb=0.002)
    assert small.rdd.getNumPartitions() > 3 and sorted(r.id for r in small.collect()) == list(range(120))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


@pytest.mark.parametrize("block", [1, 200, V.BLOCK_BYTES])
def test_transposed(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_BYTES", block)
    whole = [(j, 0, X[:, j].tolist()) for j in range(12)]
    pieces = [(j, a, X[a : a + 30 + j, j].tolist()) for j in range(12) for a in range(0, 137, 30 + j)]
    for rows in (whole, pieces):
        frame = prepare(spark).createDataFrame(rows, "j int, first long, x array<double>").repartition(5)
        assert rows_of(V.transposed(frame)) == all_of(X)
    assert rows_of(V.scan_vectors(frame.where("first = 0").drop("first").limit(0), samples="columns")) == []


def test_transposed_refuses_gaps(spark):
    """A place that lacks, comes twice or is negative spoils its samples, and only those."""
    rows = [(0, 0, [1.0, 2.0, 3.0]), (1, 0, [4.0, 5.0]), (1, 1, [9.0]), (2, 0, [6.0, 7.0, 8.0]), (None, 0, [1.0]), (1, 5, None), (-1, 3, [1.0])]
    got = rows_of(V.transposed(prepare(spark).createDataFrame(rows, "j int, first long, x array<double>")))
    assert got == [(0, [1.0, 4.0, 6.0]), (1, None), (2, None), (3, None)]
    with pytest.raises(ValueError):
        V.checked_shape(V.transposed(spark.createDataFrame(rows, "j int, first long, x array<double>")))


@pytest.mark.parametrize("p", [1, 2, 3, 7, 48, 64, 101])
def test_cosine_transform(p):
    x = np.random.default_rng(p).standard_normal((5, p))
    k, j = np.arange(p)[:, None], np.arange(p)[None]
    matrix = np.cos(np.pi * (j + 0.5) * k / p) * np.where(k == 0, np.sqrt(1 / p), np.sqrt(2 / p))
    assert np.allclose(T.dct_rows(x), x @ matrix.T, atol=1e-12) and np.allclose(T.idct_rows(x), x @ matrix, atol=1e-12)


def test_cosine_transform_of_long_vectors():
    x = np.random.default_rng(3).standard_normal((20, 10_000))
    t = T.Transform("dct", 10_000, 5)
    began = time.time()
    y = t.forward(x)
    assert np.abs(t.adjoint(y) - x).max() < 1e-9 and np.allclose((y * y).sum(axis=1), (x * x).sum(axis=1)) and time.time() - began < 1
    one = np.cos(np.pi * (np.arange(10_000) + 0.5) * 17 / 10_000) * np.sqrt(2 / 10_000) * t.signs
    assert np.abs(t.forward(one[None])[0] - np.eye(10_000)[17]).max() < 1e-9
