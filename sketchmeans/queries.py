"""Every operator as a named query over the table of embeddings, with DuckDB SQL where SQL can say the same.

Results are in long form, numbers rounded to six places, so that both engines' sums compare equal.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchmeans.api import cluster
from sketchmeans.functions import distances as D
from sketchmeans.functions import transforms as T
from sketchmeans.operators import centers as C
from sketchmeans.operators import init as I
from sketchmeans.operators import sketch as S
from sketchmeans.operators import twopass
from sketchmeans.operators.lloyd import lloyd, shift
from sketchmeans.plans.params import Params, SketchShape, sketch_shape
from sketchmeans.session import scratch
from sketchmeans.sources import vectors as V
from sketchmeans.sources.matrix import matrix_file_shape, read_matrix, write_matrix

SEED, K, M, P, CUT = 7, 5, 16, 64, 48
PLAIN = SketchShape(P, P, M)

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def r6(c: Column, name: str) -> Column:
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def vectors(spark: SparkSession, sf_dir: str, p: int = P) -> DataFrame:
    rows = V.scan_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return rows if p == P else rows.select("id", F.slice("x", 1, p).alias("x"))


def long(df: DataFrame, column: str = "x") -> DataFrame:
    return df.select("id", F.posexplode(column).alias("j", "v")).select("id", "j", r6(F.col("v"), "v"))


def long_sketch(df: DataFrame, scale: float = 1.0) -> DataFrame:
    return df.select("id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("id", F.col("e.idx").alias("j"), r6(F.col("e.val") * F.lit(scale), "v"))


def first_rows(data: DataFrame, p2: int = P, k: int = K) -> C.Centers:
    """The rows with ids 0 to k - 1 as centers."""
    return I.rows_as_centers([r.asDict() for r in data.where(F.col("id") < k).orderBy("id").collect()], p2)


def plain_sketch(spark, sf_dir) -> DataFrame:
    return S.sketch(vectors(spark, sf_dir), T.Transform("none", P), PLAIN, SEED, "md5")


def dense_seeds(spark, sf_dir) -> C.Centers:
    return first_rows(vectors(spark, sf_dir))


def centers_frame(spark: SparkSession, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k + 1, j, float(v)) for k, row in enumerate(c) for j, v in enumerate(row)], "k int, j int, v double").select("k", "j", r6(F.col("v"), "c"))


H = lambda s: f"('0x' || substr(md5({s}), 1, 8))::BIGINT"
VEC = "v AS (SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)"
VCUT = f"{VEC}, w AS (SELECT * FROM v WHERE j < {CUT})"
SIGN = f"sg AS (SELECT j::INTEGER AS j, CASE WHEN {H(f"'{SEED}|sign|' || j")} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS s FROM range({P}) t(j))"
MASK = f"mk AS (SELECT id, j, x FROM (SELECT id, j, x, row_number() OVER (PARTITION BY id ORDER BY {H(f"'{SEED}|mask|' || id || '|' || j")}, j) AS r FROM v) WHERE r <= {M})"
C0 = f"c0 AS (SELECT (id + 1)::INTEGER AS k, j, x AS c FROM v WHERE id < {K})"
NEAR = "SELECT id, k, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, k) AS r FROM {0}) WHERE r = 1"
A0 = f"{VEC}, {C0}, d0 AS (SELECT id, k, sum((x - c) * (x - c)) AS d2 FROM v JOIN c0 USING (j) GROUP BY id, k), a0 AS ({NEAR.format('d0')})"


def lloyd_sql(steps: int, start: str = f"{VEC}, {C0}") -> str:
    """CTEs c0, d0, a0, c1, ...: full vectors."""
    out = [start]
    for t in range(steps):
        out.append(f"d{t} AS (SELECT id, k, sum((x - c) * (x - c)) AS d2 FROM v JOIN c{t} USING (j) GROUP BY id, k), a{t} AS ({NEAR.format(f'd{t}')}), c{t + 1} AS (SELECT k, j, avg(x) AS c FROM v JOIN a{t} USING (id) GROUP BY k, j)")
    return ", ".join(out)


# --- sources ---------------------------------------------------------------------------------------------------------


@query(f"WITH {VEC} SELECT id, j, round(x, 6) + 0.0 AS v FROM v")
def scan_vectors(spark, d):
    return long(vectors(spark, d))


@query(f"WITH {VEC}, s AS (SELECT id, count(*) AS p, count(*) FILTER (WHERE x IS NULL OR isnan(x)) AS bad FROM v GROUP BY id) SELECT count(*) AS n, min(p)::INTEGER AS p_min, max(p)::INTEGER AS p_max, count(*) FILTER (WHERE bad > 0) AS n_bad FROM s")
def matrix_shape(spark, d):
    return V.matrix_shape(vectors(spark, d))


@query(f"WITH {VEC} SELECT id, j, round(x, 6) + 0.0 AS v FROM v")
def columns_as_samples(spark, d):
    cells = vectors(spark, d).select("id", F.posexplode("x").alias("j", "v"))
    return long(V.columns_as_samples(cells))


@query(f"WITH {VEC}, s AS (SELECT count(DISTINCT id) AS n, max(j) + 1 AS p FROM v), r AS (SELECT n, least(n, greatest(1, floor(0.0625 * 1048576 / (8 * p))))::BIGINT AS chunk_rows FROM s) SELECT chunk_rows, ceil(n / chunk_rows)::BIGINT AS n_chunks FROM r")
def chunk_plan(spark, d):
    return V.matrix_shape(vectors(spark, d)).select(*V.chunk_plan(F.col("n"), F.col("p_max"), 0.0625))


@query(f"WITH {VEC} SELECT id, j, round(x, 6) + 0.0 AS v FROM v")
def coordinate_rows(spark, d):
    """Rows of one coordinate each, in pieces of 100 samples, turned into vectors."""
    cells = vectors(spark, d).select(F.posexplode("x").alias("j", "v"), F.floor(F.col("id") / 100).alias("piece"), "id")
    rows = cells.groupBy("j", "piece").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("cells"))
    return long(V.scan_vectors(rows.select("j", F.col("cells")[0]["id"].alias("first"), F.col("cells.v").alias("x")), samples="columns"))


NUMBERED = f"{VEC}, n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM embeddings)"


@query(f"WITH {NUMBERED} SELECT n.id, j, round(x, 6) + 0.0 AS v FROM v JOIN n ON n.vec_id = v.id")
def matrix_files(spark, d):
    """Vectors written as matrix files and read back in slices of 0.05 MB, numbered in the order of their ids."""
    path = scratch(spark, "matrix")
    write_matrix(vectors(spark, d), path, 0.1)
    return long(read_matrix(spark, path, partition_mb=0.05))


@query("SELECT count(*) AS n, any_value(len(embedding)) AS p FROM embeddings")
def matrix_header(spark, d):
    """Number and length of the vectors of matrix files, from their headers."""
    path = scratch(spark, "matrix")
    write_matrix(vectors(spark, d), path, 0.1)
    return spark.createDataFrame([matrix_file_shape(path)], "n long, p long")


@query(f"WITH {VEC} SELECT round(min(x), 6) + 0.0 AS least, round(max(x), 6) + 0.0 AS most FROM v")
def value_range(spark, d):
    return S.value_range(vectors(spark, d), "x").select(r6(F.col("least"), "least"), r6(F.col("most"), "most"))


# --- mixing ----------------------------------------------------------------------------------------------------------


@query(f"WITH {VCUT} SELECT i.vec_id AS id, t.j::INTEGER AS j, round(coalesce(w.x, 0), 6) + 0.0 AS v FROM embeddings i CROSS JOIN range({P}) t(j) LEFT JOIN w ON w.id = i.vec_id AND w.j = t.j")
def pad_pow2(spark, d):
    return long(vectors(spark, d, CUT).select("id", T.pad(F.col("x"), CUT, P).alias("x")))


@query(f"WITH {SIGN} SELECT j, s FROM sg")
def rademacher_signs(spark, d):
    return spark.createDataFrame([(j, float(s)) for j, s in enumerate(T.signs(P, SEED))], "j int, s double")


@query(f"WITH {VEC}, {SIGN} SELECT id, j, round(x * s, 6) + 0.0 AS v FROM v JOIN sg USING (j)")
def sign_flip(spark, d):
    return long(vectors(spark, d).select("id", T.sign_flip(F.col("x"), T.signs(P, SEED)).alias("x")))


WALSH = "SELECT id, i::INTEGER AS j, round(sum(CASE WHEN bit_count(i & j) % 2 = 0 THEN x ELSE -x END){1}, 6) + 0.0 AS v FROM {0} CROSS JOIN range(64) t(i) GROUP BY id, i"


@query(f"WITH {VEC} {WALSH.format('v', '')}")
def fwht(spark, d):
    return long(vectors(spark, d).select("id", T.fwht(F.col("x"), P).alias("x")))


@query(f"WITH {VEC} {WALSH.format('v', ' / 8')}")
def fwht_orthonormal(spark, d):
    return long(vectors(spark, d).select("id", T.fwht_orthonormal(F.col("x"), P).alias("x")))


COSINE = f"SELECT id, k::INTEGER AS j, round(sum(x * cos(pi() * (j + 0.5) * k / {P})) * CASE WHEN k = 0 THEN sqrt(1.0 / {P}) ELSE sqrt(2.0 / {P}) END, 6) + 0.0 AS v FROM v CROSS JOIN range({P}) t(k) GROUP BY id, k"


@query(f"WITH {VEC} {COSINE}")
def dct(spark, d):
    return long(vectors(spark, d).select("id", T.Transform("dct", P, sign_kind="ones").column(F.col("x")).alias("x")))


@query(f"WITH {VEC} SELECT id, i::INTEGER AS j, round(sum(x * cos(pi() * (i + 0.5) * j / {P}) * CASE WHEN j = 0 THEN sqrt(1.0 / {P}) ELSE sqrt(2.0 / {P}) END), 6) + 0.0 AS v FROM v CROSS JOIN range({P}) t(i) GROUP BY id, i")
def idct(spark, d):
    return long(T.map_rows(vectors(spark, d), T.Transform("dct", P, sign_kind="ones").adjoint))


@query(f"WITH {VEC}, {SIGN}, f AS (SELECT id, j, x * s AS x FROM v JOIN sg USING (j)) {WALSH.format('f', ' / 8')}")
def mix(spark, d):
    return long(vectors(spark, d).select("id", T.Transform("hadamard", P, SEED).column(F.col("x")).alias("x")))


@query(f"WITH {VEC} SELECT id, j, round(x, 6) + 0.0 AS v FROM v")
def unmix_roundtrip(spark, d):
    t = T.Transform("hadamard", P, SEED)
    return long(T.map_rows(vectors(spark, d).select("id", t.column(F.col("x")).alias("x")), t.adjoint))


@query(f"WITH {VEC}, {C0}, {SIGN}, y AS (SELECT k, i::INTEGER AS j, sum(CASE WHEN bit_count(i & j) % 2 = 0 THEN c ELSE -c END) / 8 AS c FROM c0 CROSS JOIN range({P}) t(i) GROUP BY k, i) SELECT k, j, round(c * s, 6) + 0.0 AS c FROM y JOIN sg USING (j)")
def unmix_centers(spark, d):
    return centers_frame(spark, twopass.unmix_centers(dense_seeds(spark, d), T.Transform("hadamard", P, SEED)).c)


@query(f"WITH {VEC}, {SIGN} SELECT id, ({P - 1} - j)::INTEGER AS j, round(x * s, 6) + 0.0 AS v FROM v JOIN sg USING (j)")
def user_transform(spark, d):
    """A pair of functions of one's own: reversal and its inverse, after the signs."""
    flip = lambda x: x[:, ::-1]
    return long(vectors(spark, d).select("id", T.Transform((flip, flip), P, SEED).column(F.col("x")).alias("x")))


# --- sampling --------------------------------------------------------------------------------------------------------

GRID = [(p, s) for p in (1, 3, 48, 64, 500, 512) for s in (0.001, 0.01, 0.05, 0.25, 1.0)]


@query("WITH g AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {s}::DOUBLE)" for p, s in GRID) + ") t(p, sparsity)), h AS (SELECT p, sparsity, CASE WHEN p > 1 AND p & (p - 1) = 0 THEN p WHEN p = 1 THEN 1 ELSE (2 ** ceil(log2(p)))::INTEGER END AS p2 FROM g), m AS (SELECT p, sparsity, p2, least(p2, greatest(1, floor(sparsity * p2 + 0.5)))::INTEGER AS m FROM h) SELECT p, sparsity, p2, m, round(m / p2, 6) + 0.0 AS gamma FROM m")
def sketch_params(spark, d):
    rows = [(x.p, s, x.p2, x.m, x.gamma) for p, s in GRID for x in [sketch_shape(p, s, "hadamard")]]
    return spark.createDataFrame(rows, "p int, sparsity double, p2 int, m int, gamma double").withColumn("gamma", r6(F.col("gamma"), "gamma"))


@query(f"WITH {VEC}, {MASK} SELECT id, j FROM mk")
def sample_indices(spark, d):
    return vectors(spark, d).select("id", F.explode(S.sample_indices(F.col("id"), P, M, SEED)).alias("j"))


@query(f"WITH {VEC}, {MASK} SELECT id, j, round(x * ({P}.0 / {M}), 6) + 0.0 AS v FROM mk")
def sketch_sample(spark, d):
    """Values scaled by p / m, as an unbiased sample has them."""
    return long_sketch(plain_sketch(spark, d), P / M)


@query(f"WITH {VEC}, {MASK} SELECT id, j, round(x, 6) + 0.0 AS v FROM mk")
def sketch_none(spark, d):
    return long_sketch(plain_sketch(spark, d))


@query(f"WITH {VEC}, {MASK}, {SIGN}, f AS (SELECT id, j, x * s AS x FROM v JOIN sg USING (j)), y AS ({WALSH.format('f', ' / 8')}) SELECT y.id, y.j, y.v FROM y JOIN mk ON y.id = mk.id AND y.j = mk.j")
def sketch(spark, d):
    return long_sketch(S.sketch(vectors(spark, d), T.Transform("hadamard", P, SEED), PLAIN, SEED, "md5"))


@query(f"WITH {VEC}, {MASK} SELECT round((SELECT count(*) FROM mk) / (SELECT count(*) FROM v), 6) + 0.0 AS density")
def sketch_density(spark, d):
    return S.sketch_density(plain_sketch(spark, d), P).select(r6(F.col("density"), "density"))


# --- distances -------------------------------------------------------------------------------------------------------

NEAREST = "SELECT id, k, round(d2, 6) + 0.0 AS d2 FROM a"


@query(f"WITH {A0} SELECT id, k, round(sqrt(d2), 6) + 0.0 AS dist FROM a0")
def assign_dense(spark, d):
    data = vectors(spark, d)
    return C.assign(data, first_rows(data), C.Metric(P)).select("id", "k", r6(F.col("dist"), "dist"))


def _assigned(spark, d, centers: C.Centers, metric: C.Metric, factor: float = 1.0) -> DataFrame:
    """(id, k, d2) of the plain sketch by the kernel that cluster() uses; `factor` scales d2 to another's formula."""
    out = C.assign(plain_sketch(spark, d), centers, metric)
    return out.select("id", "k", r6(F.col("dist") * F.col("dist") * factor, "d2"))


@query(f"WITH {VEC}, {MASK}, {C0}, d AS (SELECT id, k, sum((x - c) * (x - c)) AS d2 FROM mk JOIN c0 USING (j) GROUP BY id, k), a AS ({NEAR.format('d')}) {NEAREST}")
def assign_masked(spark, d):
    return _assigned(spark, d, dense_seeds(spark, d), C.Metric(P))


@query(f"WITH {VEC}, {MASK}, {C0}, d AS (SELECT id, k, sum((x * 4.0 - c * 4.0) * (x * 4.0 - c * 4.0)) AS d2 FROM mk JOIN c0 USING (j) GROUP BY id, k), a AS ({NEAR.format('d')}) {NEAREST}")
def assign_sketched(spark, d):
    """Both sides over gamma."""
    return _assigned(spark, d, dense_seeds(spark, d), C.Metric(P, M / P))


def _own_support(scale: str) -> str:
    return f"WITH {VEC}, {MASK}, q AS (SELECT (id + 1)::INTEGER AS k, j, x AS c FROM mk WHERE id < {K}), e AS (SELECT id, k, sum((x * {scale} - c * {scale}) * (x * {scale} - c * {scale})) AS d2 FROM mk JOIN q USING (j) GROUP BY id, k), d AS (SELECT i.vec_id AS id, n.k, coalesce(d2, 0) AS d2 FROM embeddings i CROSS JOIN (SELECT DISTINCT k FROM q) n LEFT JOIN e ON e.id = i.vec_id AND e.k = n.k), a AS ({NEAR.format('d')}) {NEAREST}"


@query(_own_support("4.0"))
def assign_intersect(spark, d):
    """Sketched centers and rows, both scaled by 1 / gamma, over the places both have."""
    own = first_rows(plain_sketch(spark, d))
    return _assigned(spark, d, C.Centers(own.c * P / M, own.support), C.Metric(P, M / P, unbiased=False))


@query(_own_support("16.0"))
def assign_intersect_gamma(spark, d):
    """Each side over gamma times the center's share of places; the kernel divides the squares by that share once."""
    return _assigned(spark, d, first_rows(plain_sketch(spark, d)), C.Metric(P, M / P), P / M)


@query(f"WITH {VEC}, {C0} SELECT id, k, round(sqrt(sum((x - c) * (x - c))), 6) + 0.0 AS dist FROM v JOIN c0 USING (j) GROUP BY id, k")
def pairwise_distance(spark, d):
    seeds = dense_seeds(spark, d)
    each = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.sqrt(D.dense(F.col("x"), D.literal(c))).alias("dist")) for k, c in enumerate(seeds.c)])
    return vectors(spark, d).select("id", F.explode(each).alias("e")).select("id", "e.k", r6(F.col("e.dist"), "dist"))


@query(f"WITH {VEC}, {C0} SELECT id, round(greatest(0, sum(x * x - 2 * 0.5 * x * c + c * c)), 6) + 0.0 AS d2 FROM v JOIN c0 USING (j) WHERE k = 1 GROUP BY id")
def dist_beta(spark, d):
    c = D.literal(dense_seeds(spark, d).c[0])
    return vectors(spark, d).select("id", r6(D.with_beta(F.col("x"), c, 0.5), "d2"))


@query(f"WITH {VEC}, {MASK}, {C0} SELECT id, round(sum(x * c), 6) + 0.0 AS dot, round(sum(x * x), 6) + 0.0 AS norm2 FROM mk JOIN c0 USING (j) WHERE k = 1 GROUP BY id")
def inner_product_norm(spark, d):
    c = D.literal(dense_seeds(spark, d).c[0])
    return plain_sketch(spark, d).select("id", r6(D.inner_product(F.col("idx"), F.col("val"), c), "dot"), r6(D.norm_sq(F.col("val")), "norm2"))


@query(f"WITH {VEC} SELECT id, round(sum(x * x), 6) + 0.0 AS norm2 FROM v GROUP BY id")
def norm_sq(spark, d):
    return vectors(spark, d).select("id", r6(D.norm_sq(F.col("x")), "norm2"))


# --- aggregates ------------------------------------------------------------------------------------------------------


def members(spark, d) -> DataFrame:
    data = vectors(spark, d)
    return data.join(C.assign(data, first_rows(data), C.Metric(P)).select("id", "k"), "id")


def _updated(spark, d, data: DataFrame, metric: C.Metric, ml: bool = True) -> tuple[C.Centers, dict]:
    """Centers after one iteration from the first rows, and the sums they come from."""
    seeds = dense_seeds(spark, d)
    sums = C.iterate(data, {0: seeds}, metric)
    return C.updated(seeds, sums, 0, "idx" in data.columns, ml, metric.gamma)[0], sums


def _long_centers(spark, c: C.Centers, sums: dict) -> DataFrame:
    """(k, j, n_observed, c) of the coordinates that members have."""
    rows = [(k + 1, j, int(n), float(c.c[k, j])) for (_, k), (_, _, _, counts) in sorted(sums.items()) for j, n in enumerate(counts) if n]
    return spark.createDataFrame(rows, "k int, j int, n_observed long, c double").select("k", "j", "n_observed", r6(F.col("c"), "c"))


@query(f"WITH {lloyd_sql(1)} SELECT k, j, round(c, 6) + 0.0 AS c FROM c1")
def center_update(spark, d):
    return _long_centers(spark, *_updated(spark, d, vectors(spark, d), C.Metric(P))).drop("n_observed")


S0 = f"{VEC}, {MASK}, {C0}, d0 AS (SELECT id, k, sum((x - c) * (x - c)) AS d2 FROM mk JOIN c0 USING (j) GROUP BY id, k), a0 AS ({NEAR.format('d0')})"


@query(f"WITH {S0} SELECT k, j, count(*) AS n_observed, round(avg(x), 6) + 0.0 AS c FROM mk JOIN a0 USING (id) GROUP BY k, j")
def center_update_ml(spark, d):
    return _long_centers(spark, *_updated(spark, d, plain_sketch(spark, d), C.Metric(P, M / P)))


@query(f"WITH {S0}, n AS (SELECT k, count(*) AS n FROM a0 GROUP BY k) SELECT k, j, round(sum(x) * {P / M} / any_value(n), 6) + 0.0 AS c FROM mk JOIN a0 USING (id) JOIN n USING (k) GROUP BY k, j")
def center_update_zero_fill(spark, d):
    return _long_centers(spark, *_updated(spark, d, plain_sketch(spark, d), C.Metric(P, M / P), ml=False)).drop("n_observed")


FAR = f"{VEC}, c0 AS (SELECT (id + 1)::INTEGER AS k, j, x AS c FROM v WHERE id < {K - 1} UNION ALL SELECT {K}, j::INTEGER, 100.0 FROM range({P}) t(j))"


def far_seeds(spark, d) -> C.Centers:
    """Four rows and a center so far away that it gets no members."""
    seeds = dense_seeds(spark, d)
    seeds.c[K - 1] = 100.0
    return seeds


@query(f"WITH {lloyd_sql(1, FAR)} SELECT g.k::INTEGER AS k, t.j::INTEGER AS j, round(coalesce(c1.c, 0), 6) + 0.0 AS c FROM range(1, {K + 1}) g(k) CROSS JOIN range({P}) t(j) LEFT JOIN c1 ON c1.k = g.k AND c1.j = t.j")
def assign_and_update(spark, d):
    """Assignment and means in one pass over the data; a cluster without members has zeros."""
    merged = C.iterate(vectors(spark, d), {0: far_seeds(spark, d)}, C.Metric(P))
    return centers_frame(spark, np.stack([merged[0, k][2] / merged[0, k][0] if (0, k) in merged else np.zeros(P) for k in range(K)]))


@query(f"WITH {A0} SELECT k, count(*) AS n FROM a0 GROUP BY k")
def cluster_sizes(spark, d):
    return members(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A0} SELECT round(sqrt(sum(d2)), 6) + 0.0 AS objective FROM a0")
def objective(spark, d):
    data = vectors(spark, d)
    return twopass.objective(C.assign(data, first_rows(data), C.Metric(P))).select(r6(F.col("objective"), "objective"))


SUMD = "SELECT g.k::INTEGER AS k, count(a.id) AS n, round(coalesce(sum(d2), 0), 6) + 0.0 AS sumd FROM range(1, 6) g(k) LEFT JOIN {0} a ON a.k = g.k GROUP BY g.k"


@query(f"WITH {lloyd_sql(1, FAR)} {SUMD.format('a0')}")
def sumd(spark, d):
    return C.sumd(C.assign(vectors(spark, d), far_seeds(spark, d), C.Metric(P)), K).select("k", "n", r6(F.col("sumd"), "sumd"))


@query(f"WITH {lloyd_sql(1)} SELECT round(sqrt(sum((c1.c - c0.c) * (c1.c - c0.c))), 6) + 0.0 AS shift FROM c0 JOIN c1 USING (k, j)")
def center_shift(spark, d):
    data = vectors(spark, d)
    seeds = first_rows(data)
    new, _ = C.updated(seeds, C.iterate(data, {0: seeds}, C.Metric(P)), 0, False, True, None)
    return spark.createDataFrame([(shift(seeds, new),)], "shift double").select(r6(F.col("shift"), "shift"))


@query(f"WITH {A0} SELECT id, k, round(sqrt(d2), 6) + 0.0 AS dist FROM a0 ORDER BY d2 DESC, id LIMIT 1")
def farthest_point(spark, d):
    data = vectors(spark, d)
    return C.farthest(C.assign(data, first_rows(data), C.Metric(P))).select("id", "k", r6(F.col("dist"), "dist"))


# --- seeding ---------------------------------------------------------------------------------------------------------


@query(f"SELECT vec_id AS id FROM embeddings ORDER BY {H(f"'{SEED}|sample|0|' || vec_id")}, vec_id LIMIT {K}")
def init_sample(spark, d):
    return I.init_sample(vectors(spark, d), K, SEED, 0, "md5").select("id")


@query(f"WITH {VEC}, r AS (SELECT min(x) AS a, max(x) AS b FROM v) SELECT (t.k + 1)::INTEGER AS k, j.j::INTEGER AS j, round(a + (b - a) * (({H(f"'{SEED}|uniform|0|' || t.k || '|' || j.j")}) + 0.5) / 4294967296.0, 6) + 0.0 AS c FROM r CROSS JOIN range({K}) t(k) CROSS JOIN range({P}) j(j)")
def init_uniform(spark, d):
    return centers_frame(spark, I.init_uniform(vectors(spark, d), K, P, SEED, 0, "md5").c)


def _u(purpose: str, t: int) -> str:
    return f"(({H(f"'{SEED}|{purpose}|0|{t}|' || id")}) + 0.5) / 4294967296.0"


def _kmeanspp_sql(k: int = 4) -> str:
    parts = [VEC, "e AS (SELECT DISTINCT id FROM v)", f"s0 AS (SELECT id, 0 AS t FROM e ORDER BY {_u('pp', 0)}, id LIMIT 1)"]
    for t in range(1, k):
        parts.append(f"d{t} AS (SELECT a.id, b.id AS s, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM v a JOIN v b USING (j) WHERE b.id IN (SELECT id FROM s{t - 1}) GROUP BY a.id, b.id)")
        parts.append(f"m{t} AS (SELECT id, min(d2) AS d2 FROM d{t} WHERE id NOT IN (SELECT id FROM s{t - 1}) GROUP BY id)")
        parts.append(f"s{t} AS (SELECT * FROM s{t - 1} UNION ALL SELECT * FROM (SELECT id, {t} FROM m{t} ORDER BY -ln({_u('pp', t)}) / d2, id LIMIT 1))")
    return f"WITH {', '.join(parts)} SELECT t::INTEGER AS round, id FROM s{k - 1}"


@query(_kmeanspp_sql())
def init_kmeanspp(spark, d):
    ids, _ = I.init_kmeanspp(vectors(spark, d), 4, C.Metric(P), SEED, 0, "md5")
    return spark.createDataFrame(list(enumerate(ids)), "round int, id long")


def _parallel_sql(k: int, rounds: int) -> str:
    """Candidates n0, n1, ... of k-means||, their weights, and weighted draws from them."""
    near = "SELECT a.id, min(d2) AS d2 FROM (SELECT a.id, b.id AS s, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM v a JOIN v b USING (j) WHERE b.id IN (SELECT id FROM {0}) GROUP BY a.id, b.id) a GROUP BY a.id"
    parts = [VEC, "e AS (SELECT DISTINCT id FROM v)", f"n0 AS (SELECT id, 0 AS turn FROM e ORDER BY {_u('pp', 0)}, id LIMIT 1)"]
    for r in range(rounds):
        parts.append(f"g{r} AS ({near.format(f'n{r}')})")
        parts.append(f"n{r + 1} AS (SELECT * FROM n{r} UNION ALL SELECT id, {r + 1} FROM g{r} WHERE {_u('parallel', r)} < d2 * {2.0 * k} / (SELECT sum(d2) FROM g{r}))")
    parts.append(f"o AS (SELECT id AS s, row_number() OVER (ORDER BY turn, id) AS o FROM n{rounds})")
    parts.append("y AS (SELECT a.id, o.o, o.s, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM v a JOIN v b USING (j) JOIN o ON o.s = b.id GROUP BY a.id, o.o, o.s)")
    parts.append("z AS (SELECT s AS id, count(*) AS n FROM (SELECT id, s FROM y QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, o) = 1) GROUP BY s)")
    parts.append(f"s0 AS (SELECT id, 0 AS t FROM z ORDER BY -ln({_u('reduce', 0)}) / n, id LIMIT 1)")
    for t in range(1, k):
        parts.append(f"m{t} AS (SELECT id, min(d2) AS d2 FROM y WHERE s IN (SELECT id FROM s{t - 1}) AND id NOT IN (SELECT id FROM s{t - 1}) GROUP BY id)")
        parts.append(f"s{t} AS (SELECT * FROM s{t - 1} UNION ALL SELECT * FROM (SELECT id, {t} FROM m{t} JOIN z USING (id) ORDER BY -ln({_u('reduce', t)}) / (n * d2), id LIMIT 1))")
    return f"WITH {', '.join(parts)} SELECT t::INTEGER AS round, id FROM s{k - 1}"


@query(_parallel_sql(6, 2))
def init_kmeans_parallel(spark, d):
    [(ids, _)] = I.seed_parallel(vectors(spark, d), 6, C.Metric(P), SEED, [0], "md5", rounds=2)
    return spark.createDataFrame(list(enumerate(ids)), "round int, id long")


# --- iterations ------------------------------------------------------------------------------------------------------


def run(spark, d, seeds, max_iter, **options):
    return lloyd(vectors(spark, d), [seeds], C.Metric(P), Params(max_iter=max_iter, tol=0.0, **options))


@query(f"WITH {lloyd_sql(1, FAR)}, f AS (SELECT id FROM a0 ORDER BY d2 DESC, id LIMIT 1) SELECT k, j, round(c, 6) + 0.0 AS c FROM c1 UNION ALL SELECT {K}, j, round(x, 6) + 0.0 FROM v JOIN f USING (id)")
def empty_singleton(spark, d):
    return centers_frame(spark, run(spark, d, far_seeds(spark, d), 1)[0].c)


@query(f"WITH {lloyd_sql(1, FAR)} SELECT k, j, round(c, 6) + 0.0 AS c FROM c1")
def empty_drop(spark, d):
    return centers_frame(spark, run(spark, d, far_seeds(spark, d), 1, empty_action="drop")[0].c)


@query(f"WITH {lloyd_sql(3)} SELECT id, k, round(sqrt(d2), 6) + 0.0 AS dist FROM a2")
def lloyd_warm_start(spark, d):
    """Three iterations from given rows; the assignment is that of the third, before its update."""
    result = cluster(vectors(spark, d), K, init=dense_seeds(spark, d).c, max_iter=3, tol=0.0)
    return result.assignments.select("id", "k", r6(F.col("dist"), "dist"))


@query(f"WITH {lloyd_sql(3)} SELECT k, j, round(c, 6) + 0.0 AS c FROM c3")
def lloyd_dense(spark, d):
    return centers_frame(spark, run(spark, d, dense_seeds(spark, d), 3)[0].c)


def _sketched_sql() -> str:
    out = [VEC, MASK, C0]
    for t in range(2):
        out.append(f"d{t} AS (SELECT id, k, sum((x - c) * (x - c)) * {(P / M) ** 2} AS d2 FROM mk JOIN c{t} USING (j) GROUP BY id, k), a{t} AS ({NEAR.format(f'd{t}')}), c{t + 1} AS (SELECT k, j, avg(x) AS c FROM mk JOIN a{t} USING (id) GROUP BY k, j)")
    return f"WITH {', '.join(out)} SELECT id, k, round(sqrt(d2), 6) + 0.0 AS dist FROM a1"


@query(_sketched_sql())
def lloyd_sketched(spark, d):
    data, metric = plain_sketch(spark, d), C.Metric(P, M / P)
    _, used, _ = lloyd(data, [dense_seeds(spark, d)], metric, Params(max_iter=2, tol=0.0))
    return C.assign(data, used, metric).select("id", "k", r6(F.col("dist"), "dist"))


TRACE = lloyd_sql(3) + ", t AS (" + " UNION ALL ".join(f"SELECT {t + 1} AS iteration, round((SELECT sqrt(sum(d2)) FROM a{t}), 6) + 0.0 AS objective, round((SELECT sqrt(sum((n.c - o.c) * (n.c - o.c))) FROM c{t + 1} n JOIN c{t} o USING (k, j)), 6) + 0.0 AS shift" for t in range(3)) + ")"


@query(f"WITH {TRACE} SELECT iteration, objective, shift FROM t")
def convergence_trace(spark, d):
    info = run(spark, d, dense_seeds(spark, d), 3)[2]
    rows = spark.createDataFrame([(i, o, s) for _, i, o, s in info.trace], "iteration int, objective double, shift double")
    return rows.select("iteration", r6(F.col("objective"), "objective"), r6(F.col("shift"), "shift"))


def _replicates_sql() -> str:
    parts = [VEC]
    for rep in range(3):
        parts.append(f"c{rep}_0 AS (SELECT (id - {rep * K} + 1)::INTEGER AS k, j, x AS c FROM v WHERE id >= {rep * K} AND id < {rep * K + K})")
        for t in range(2):
            parts.append(f"d{rep}_{t} AS (SELECT id, k, sum((x - c) * (x - c)) AS d2 FROM v JOIN c{rep}_{t} USING (j) GROUP BY id, k), a{rep}_{t} AS ({NEAR.format(f'd{rep}_{t}')}), c{rep}_{t + 1} AS (SELECT k, j, avg(x) AS c FROM v JOIN a{rep}_{t} USING (id) GROUP BY k, j)")
    every = " UNION ALL ".join(f"SELECT {rep} AS replicate, (SELECT sqrt(sum(d2)) FROM a{rep}_1) AS o" for rep in range(3))
    return f"WITH {', '.join(parts)}, o AS ({every}) SELECT replicate, round(o, 6) + 0.0 AS objective, replicate = first_value(replicate) OVER (ORDER BY o, replicate) AS best FROM o"


@query(_replicates_sql())
def replicates_best(spark, d):
    """Three starts run in the same passes; the first of the least objectives is best."""
    data = vectors(spark, d)
    rows = data.where(F.col("id") < 3 * K).orderBy("id").collect()
    seeds = [I.rows_as_centers([r.asDict() for r in rows[i : i + K]], P) for i in range(0, 3 * K, K)]
    _, _, info = lloyd(data, seeds, C.Metric(P), Params(max_iter=2, tol=0.0))
    out = spark.createDataFrame([(i, float(o), i == info.best) for i, o in enumerate(info.objectives)], "replicate int, objective double, best boolean")
    return out.select("replicate", r6(F.col("objective"), "objective"), "best")


# --- second pass -----------------------------------------------------------------------------------------------------

SK = _sketched_sql().removeprefix("WITH ").split(" SELECT id, k, round(sqrt(d2), 6)")[0]


def _sketched(spark, d) -> tuple[C.Centers, C.Centers, C.Metric]:
    metric = C.Metric(P, M / P)
    new, used, _ = lloyd(plain_sketch(spark, d), [dense_seeds(spark, d)], metric, Params(max_iter=2, tol=0.0))
    return new, used, metric


@query(f"WITH {SK} SELECT k, j, round(avg(x), 6) + 0.0 AS c FROM v JOIN a1 USING (id) GROUP BY k, j")
def two_pass_centers(spark, d):
    _, used, metric = _sketched(spark, d)
    rows = S.sketch(vectors(spark, d), T.Transform("none", P), PLAIN, SEED, "md5", carry=("x",))
    return twopass.two_pass_centers(rows, used, metric).select("k", "j", r6(F.col("c"), "c"))


SECOND = f"{SK}, f AS (SELECT k, t.j::INTEGER AS j, coalesce(c, 0) AS c FROM (SELECT DISTINCT k FROM a1) CROSS JOIN range({P}) t(j) LEFT JOIN c2 USING (k, j)), d9 AS (SELECT id, k, sum((x - c) * (x - c)) AS d2 FROM v JOIN f USING (j) GROUP BY id, k), a9 AS ({NEAR.format('d9')})"


def _second(spark, d) -> DataFrame:
    new = _sketched(spark, d)[0]
    return twopass.two_pass_assign(vectors(spark, d), twopass.unmix_centers(new, T.Transform("none", P)))


@query(f"WITH {SECOND} SELECT id, k, round(sqrt(d2), 6) + 0.0 AS dist FROM a9")
def two_pass_assign(spark, d):
    return _second(spark, d).select("id", "k", r6(F.col("dist"), "dist"))


@query(f"WITH {SECOND} {SUMD.format('a9')}")
def sumd_two_pass(spark, d):
    return C.sumd(_second(spark, d), K).select("k", "n", r6(F.col("sumd"), "sumd"))


# --- whole runs ------------------------------------------------------------------------------------------------------


def _seeded_sql(steps: int, k: int = 4) -> str:
    """k seeds as init_kmeanspp draws them, then iterations."""
    seeds = _kmeanspp_sql(k).removeprefix(f"WITH {VEC}, ").removesuffix(f" SELECT t::INTEGER AS round, id FROM s{k - 1}")
    seeds = re.sub(r"\bd([0-9]+)\b", r"e\1", seeds)
    return lloyd_sql(steps, f"{VEC}, {seeds}, c0 AS (SELECT (t + 1)::INTEGER AS k, j, x AS c FROM v JOIN s{k - 1} USING (id))")


@query(f"WITH {_seeded_sql(3)} SELECT id, k, round(sqrt(d2), 6) + 0.0 AS dist FROM a2")
def cluster_dense(spark, d):
    """Seed and iterate, as a user would, with hashes that SQL has too."""
    result = cluster(vectors(spark, d), 4, max_iter=3, tol=0.0, seed=SEED, hashing="md5")
    return result.assignments.select("id", "k", r6(F.col("dist"), "dist"))


@query(f"WITH {_seeded_sql(10, 10)} SELECT id, k, round(sqrt(d2), 6) + 0.0 AS dist FROM a9")
def cluster_dense_10(spark, d):
    """Ten clusters, ten iterations, from ten seeds of K-means++."""
    result = cluster(vectors(spark, d), 10, max_iter=10, tol=0.0, seed=SEED, hashing="md5")
    return result.assignments.select("id", "k", r6(F.col("dist"), "dist"))


def _cluster_sketched_sql() -> str:
    """Mix, sample, seed from sketched rows, two iterations over what rows and centers have, un-mix, assign again."""
    mixed = WALSH.format("f", " / 8").replace("round(", "(").replace(", 6) + 0.0", ")")
    parts = [VEC, SIGN, f"f AS (SELECT id, j, x * s AS x FROM v JOIN sg USING (j)), y AS ({mixed})", MASK.replace("id, j, x", "id, j").replace("mk AS", "mj AS"), "mk AS (SELECT y.id, y.j, y.v AS x FROM y JOIN mj ON y.id = mj.id AND y.j = mj.j)"]
    parts.append(f"s AS (SELECT vec_id AS id, (row_number() OVER (ORDER BY {H(f"'{SEED}|sample|0|' || vec_id")}, vec_id))::INTEGER AS k FROM embeddings QUALIFY k <= {K})")
    parts.append("c0 AS (SELECT k, j, x AS c FROM mk JOIN s USING (id))")
    for t in range(2):
        parts.append(f"h{t} AS (SELECT k, {P}.0 / count(*) AS f FROM c{t} GROUP BY k), e{t} AS (SELECT id, k, sum((x - c) * (x - c)) AS d2 FROM mk JOIN c{t} USING (j) GROUP BY id, k)")
        parts.append(f"d{t} AS (SELECT i.vec_id AS id, h.k, coalesce(d2, 0) * h.f AS d2 FROM embeddings i CROSS JOIN h{t} h LEFT JOIN e{t} e ON e.id = i.vec_id AND e.k = h.k), a{t} AS ({NEAR.format(f'd{t}')}), c{t + 1} AS (SELECT k, j, avg(x) AS c FROM mk JOIN a{t} USING (id) GROUP BY k, j)")
    parts.append(f"u AS (SELECT k, i::INTEGER AS j, sum(CASE WHEN bit_count(i & j) % 2 = 0 THEN c ELSE -c END) / 8 AS c FROM c2 CROSS JOIN range({P}) t(i) GROUP BY k, i), w AS (SELECT k, j, c * s AS c FROM u JOIN sg USING (j))")
    parts.append(f"d9 AS (SELECT id, k, sum((x - c) * (x - c)) AS d2 FROM v JOIN w USING (j) GROUP BY id, k), a9 AS ({NEAR.format('d9')})")
    return f"WITH {', '.join(parts)} SELECT id, k, round(sqrt(d2), 6) + 0.0 AS dist FROM a9"


@query(_cluster_sketched_sql())
def cluster_sketched(spark, d):
    """Sketch, seed, iterate and un-mix, as a user would; assignments of the second pass."""
    result = cluster(vectors(spark, d), K, sparsify=True, sparsity=M / P, init="sample", max_iter=2, tol=0.0, seed=SEED, hashing="md5")
    return result.two_pass_assignments.select("id", "k", r6(F.col("dist"), "dist"))


@query()
def cluster_sketched_10(spark, d):
    """The same on a sketch, two replicates from ten seeds of K-means++ each, ten iterations; assignments of the second pass."""
    result = cluster(vectors(spark, d), 10, sparsify=True, sparsity=M / P, replicates=2, max_iter=10, tol=0.0, seed=SEED)
    return result.two_pass_assignments.select("id", "k", r6(F.col("dist"), "dist"))
