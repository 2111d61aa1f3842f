"""Seeding: sampled rows, uniform draws, K-means++, k-means||, or given centers.

K-means++ asks for seed after seed, each drawn by its distance to those before it. A draw is an exponential race: the row
with the least E / d2 wins, where E is -ln of a hash of (seed, replicate, round, row). Distances only fall as seeds come, so
a round's race by old distances gives lower bounds for the race by new ones. One job over the rows runs the races of many
rounds ahead, for all replicates, by the distances it finds; of each race only the leading rows leave a partition. The driver
then plays the rounds one by one, with the leaders' distances to the seeds drawn meanwhile, and stops where a row that did
not lead could have won. So the seeds are those of K-means++ to the letter, in a number of jobs that grows
with the logarithm of K at first and with K over AHEAD_BYTES' worth of rounds later, and a job's plan is always the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchmeans.functions.hashing import uniform, uniform_of
from sketchmeans.operators.centers import Centers, Metric, blocks, nearest
from sketchmeans.operators.sketch import value_range


def rows_as_centers(rows: list, p2: int) -> Centers:
    """Rows (x) or (idx, val) as centers; a sketch's support is its mask."""
    c, support = np.zeros((len(rows), p2)), np.zeros((len(rows), p2), bool)
    for k, r in enumerate(rows):
        if "x" in r:
            c[k], support[k] = r["x"], True
        else:
            c[k, r["idx"]], support[k, r["idx"]] = r["val"], True
    return Centers(c, support)


def init_sample(data: DataFrame, k: int, seed: int, rep: int = 0, hashing: str = "xxhash64") -> DataFrame:
    """k rows with the smallest hashes of their ids: a top-k, no full sort."""
    return data.orderBy(uniform(hashing, F.lit(seed), F.lit("sample"), F.lit(rep), F.col("id")), "id").limit(k)


def init_uniform(data: DataFrame, k: int, p2: int, seed: int, rep: int = 0, hashing: str = "xxhash64") -> Centers:
    """Entries uniform between the least and the largest value of the data, by hashes of (seed, replicate, center, place)."""
    r = value_range(data, "val" if "idx" in data.columns else "x").first()
    cells = data.sparkSession.range(k * p2, numPartitions=1).select("id", uniform(hashing, F.lit(seed), F.lit("uniform"), F.lit(rep), F.floor(F.col("id") / p2).cast("long"), F.col("id") % p2).alias("u"))
    u = np.array([x["u"] for x in cells.orderBy("id").collect()]).reshape(k, p2)
    return Centers.full(r["least"] + (r["most"] - r["least"]) * u)


#: Rows that a partition reports of each race, and the bytes of all its reports in one job.
LEADERS, AHEAD_BYTES = 8, 4 << 20


def _near(parts: tuple, seeds: Centers | None, metric: Metric) -> np.ndarray:
    """Least squared distance of each row to any seed; infinite without seeds."""
    return np.full(len(parts[1]), np.inf) if seeds is None else nearest(*parts, seeds, metric)[1]


def _leading(key: np.ndarray, u: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The n rows that come first by (key, u, id), in order."""
    if len(key) > 4 * n:
        at = np.flatnonzero(key <= np.partition(key, n - 1)[n - 1])
        return at[np.lexsort((ids[at], u[at], key[at]))][:n]
    return np.lexsort((ids, u, key))[:n]


def _key(u: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A race's time; a row on a seed comes last, and before there are seeds, all are alike but for u."""
    with np.errstate(divide="ignore"):
        return np.where(np.isinf(near), 0.0, np.where(near > 0, -np.log(u) / near, np.inf))


def _races(data: DataFrame, plays: list[tuple[int, int, int, Centers | None, list[int]]], metric: Metric, seed: int, hashing: str) -> DataFrame:
    """(rep, t, race, u, near, id and vector) of the LEADERS of each race; plays: (rep, first round, end, seeds, their ids)."""
    shared, sketched = data.sparkSession.sparkContext.broadcast(plays), "idx" in data.columns
    names = ["id", "idx", "val"] if sketched else ["id", "x"]
    head = "rep int, t int, race double, u double, near double, id long, "
    schema = head + ("idx array<int>, val array<double>" if sketched else "x array<double>")

    def leaders(it: Iterator) -> Iterator:
        import pyarrow as pa

        best: dict[tuple[int, int], pa.Table] = {}
        for batch in it:
            if not batch.num_rows:
                continue
            parts = blocks(batch, names, sketched)
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rep, first, end, seeds, taken in shared.value:
                near = _near(parts, seeds, metric)
                free = np.flatnonzero(~np.isin(every, taken))
                ids = every[free]
                for t in range(first, end):
                    u = uniform_of(hashing, ids, seed, "pp", rep, t)
                    race = _key(u, near[free])
                    at = _leading(race, u, ids, LEADERS)
                    rows = pa.Table.from_batches([batch.take(pa.array(free[at]))])
                    own = [pa.array(np.full(len(at), v, np.int32)) for v in (rep, t)] + [pa.array(v) for v in (race[at], u[at], near[free[at]])]
                    rows = pa.table([*own, *rows.columns], names=["rep", "t", "race", "u", "near", *names])
                    if (rep, t) in best:
                        rows = pa.concat_tables([best[rep, t], rows])
                        rows = rows.sort_by([("race", "ascending"), ("u", "ascending"), ("id", "ascending")]).slice(0, LEADERS)
                    best[rep, t] = rows
        if best:
            yield from pa.concat_tables(best.values()).combine_chunks().to_batches()

    first = data.select(*names).mapInArrow(leaders, schema)
    order = Window.partitionBy("rep", "t").orderBy("race", "u", "id")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS)


def _arrays(rows: list[dict]) -> tuple:
    """Rows as blocks() has them: (idx, x, real); masks of unequal length are padded."""
    if "x" in rows[0]:
        return None, np.array([r["x"] for r in rows]), None
    m = max(len(r["idx"]) for r in rows)
    real = np.array([np.arange(m) < len(r["idx"]) for r in rows])
    idx, val = np.zeros(real.shape, np.int64), np.zeros(real.shape)
    idx[real] = np.concatenate([r["idx"] for r in rows])
    val[real] = np.concatenate([r["val"] for r in rows])
    return idx, val, None if real.all() else real


def _play(found: dict[int, list[dict]], first: int, taken: set[int], metric: Metric) -> list[dict]:
    """The winners of as many rounds from `first` on as the leaders found decide; empty if no row is left."""
    won: list[dict] = []
    for t in range(first, first + len(found)):
        leaders = found.get(t, [])
        if not leaders:
            break
        near = np.array([r["near"] for r in leaders])
        if won:
            near = np.minimum(near, _near(_arrays(leaders), rows_as_centers(won, metric.p2), metric))
        keys = sorted((float(k), r["u"], r["id"], i) for i, (k, r) in enumerate(zip(_key(np.array([r["u"] for r in leaders]), near), leaders, strict=True)) if r["id"] not in taken)
        last = leaders[-1]
        # A row that did not lead had a later time than the last leader even by its old distance.
        if not keys or (len(leaders) == LEADERS and keys[0][:3] > (last["race"], last["u"], last["id"])):
            break
        won.append(leaders[keys[0][3]])
        taken.add(won[-1]["id"])
    return won


def seed_kmeanspp(data: DataFrame, k: int, metric: Metric, seed: int, reps: list[int], hashing: str = "xxhash64", start: dict[int, list[dict]] | None = None) -> list[tuple[list[int], Centers]]:
    """For each replicate the ids and rows of k seeds: the first uniform, each next in proportion to its squared distance.

    Draws are hashed from (seed, replicate, round, id); if every distance is 0, a draw is uniform among the rows not chosen
    yet. Rows that share an id count as one: once one of them is a seed, none of the others is. `start` has seeds chosen
    before. ValueError if there are too few rows. `data` is read once a job and should be cached.
    """
    rows: dict[int, list[dict]] = {rep: list((start or {}).get(rep, [])) for rep in reps}
    row_bytes = 16 * metric.p2 + 64
    while any(len(r) < k for r in rows.values()):
        open_ = [rep for rep in reps if len(rows[rep]) < k]
        most = max(1, AHEAD_BYTES // (LEADERS * row_bytes * len(open_)))
        plays = []
        for rep in open_:
            t = len(rows[rep])
            ahead = min(k - t, most, max(1, 2 * t))
            plays.append((rep, t, t + ahead, rows_as_centers(rows[rep], metric.p2) if t else None, [r["id"] for r in rows[rep]]))
        found: dict[int, dict[int, list[dict]]] = {rep: {t: [] for t in range(a, b)} for rep, a, b, _, _ in plays}
        for r in sorted((r.asDict() for r in _races(data, plays, metric, seed, hashing).collect()), key=lambda r: (r["race"], r["u"], r["id"])):
            found[r["rep"]][r["t"]].append(r)
        for rep, t, _, _, taken in plays:
            won = _play(found[rep], t, set(taken), metric)
            if not won:
                raise ValueError(f"only {t} rows to seed {k} clusters from")
            rows[rep] += won
    return [([r["id"] for r in rows[rep]], rows_as_centers(rows[rep], metric.p2)) for rep in reps]


def init_kmeanspp(data: DataFrame, k: int, metric: Metric, seed: int, rep: int = 0, hashing: str = "xxhash64") -> tuple[list[int], Centers]:
    """seed_kmeanspp() for one replicate."""
    return seed_kmeanspp(data, k, metric, seed, [rep], hashing)[0]


def _costs(data: DataFrame, seeds: dict[int, Centers], metric: Metric) -> dict[int, float]:
    """Sum of squared distances of all rows to the nearest seed, for each replicate."""
    shared, sketched = data.sparkSession.sparkContext.broadcast(seeds), "idx" in data.columns
    names = ["id", "idx", "val"] if sketched else ["id", "x"]

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        total = dict.fromkeys(shared.value, 0.0)
        for batch in it:
            if batch.num_rows:
                parts = blocks(batch, names, sketched)
                for rep, own in shared.value.items():
                    near = _near(parts, own, metric)
                    total[rep] += float(near[np.isfinite(near)].sum())
        yield pa.RecordBatch.from_pydict({"rep": pa.array(list(total), pa.int32()), "cost": pa.array(list(total.values()), pa.float64())})

    return {r["rep"]: r["cost"] for r in data.select(*names).mapInArrow(run, "rep int, cost double").groupBy("rep").agg(F.sum("cost").alias("cost")).collect()}


def _drawn(data: DataFrame, seeds: dict[int, Centers], chance: dict[int, float], turn: int, metric: Metric, seed: int, hashing: str) -> DataFrame:
    """(rep, id and vector) of the rows drawn: each with its distance times `chance`, for itself."""
    shared, sketched = data.sparkSession.sparkContext.broadcast((seeds, chance)), "idx" in data.columns
    names = ["id", "idx", "val"] if sketched else ["id", "x"]

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            if not batch.num_rows:
                continue
            parts, ids = blocks(batch, names, sketched), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own, share = shared.value
            for rep in own:
                near = _near(parts, own[rep], metric)
                near = np.where(np.isfinite(near), near, 0)
                at = np.flatnonzero(uniform_of(hashing, ids, seed, "parallel", rep, turn) < near * share[rep])
                if len(at):
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), rep, np.int32)), *rows.columns], ["rep", *names])

    return data.select(*names).mapInArrow(run, "rep int, id long, " + ("idx array<int>, val array<double>" if sketched else "x array<double>"))


def _weights(data: DataFrame, seeds: dict[int, Centers], metric: Metric) -> DataFrame:
    """(rep, k, n): the rows nearest to each seed, k from 0."""
    shared, sketched = data.sparkSession.sparkContext.broadcast(seeds), "idx" in data.columns
    names = ["id", "idx", "val"] if sketched else ["id", "x"]

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        count = {rep: np.zeros(len(own), np.int64) for rep, own in shared.value.items()}
        for batch in it:
            if batch.num_rows:
                parts = blocks(batch, names, sketched)
                for rep, own in shared.value.items():
                    count[rep] += np.bincount(nearest(*parts, own, metric)[0], minlength=len(own))
        for rep, n in count.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), rep, np.int32)), pa.array(k.astype(np.int32)), pa.array(n[k])], ["rep", "k", "n"])

    return data.select(*names).mapInArrow(run, "rep int, k int, n long").groupBy("rep", "k").agg(F.sum("n").alias("n"))


def reduce_weighted(rows: list[dict], weights: np.ndarray, k: int, metric: Metric, seed: int, rep: int, hashing: str) -> list[dict]:
    """k of the candidates by weighted K-means++: races by weight times distance, the first one by weight alone."""
    ids = np.array([r["id"] for r in rows], np.int64)
    parts, near, out = _arrays(rows), np.ones(len(rows)), []
    for t in range(k):
        u = uniform_of(hashing, ids, seed, "reduce", rep, t)
        race = _key(u, near * weights)
        race[out] = np.nan  # sorted last, behind the candidates that lie on a seed
        best = int(np.lexsort((ids, u, race))[0])
        out.append(best)
        d2 = _near(parts, rows_as_centers([rows[best]], metric.p2), metric)
        near = d2 if t == 0 else np.minimum(near, d2)
    return [rows[i] for i in out]


#: Bytes of candidates, of all replicates together, that the driver holds and sends to the tasks.
CANDIDATE_BYTES = 1 << 30


def seed_parallel(data: DataFrame, k: int, metric: Metric, seed: int, reps: list[int], hashing: str = "xxhash64", rounds: int = 3, oversampling: float = 2.0) -> list[tuple[list[int], Centers]]:
    """k-means||: for each replicate the ids and rows of k seeds, in 2 + 2 * rounds jobs whatever k is.

    From one uniform row on, each round draws every row with the chance oversampling * k * d2 / (sum of all d2), some
    oversampling * k rows a round. Every row then counts for its nearest candidate, and weighted K-means++ picks k of the candidates. Draws are
    hashed from (seed, replicate, round, id). Of rows that share an id one is a candidate. Where fewer than k candidates come
    together, as with few rows or many equal ones, the rest is seeded by K-means++. ValueError if the candidates would be
    more than CANDIDATE_BYTES: fewer replicates at once, or a smaller oversampling, are needed then.
    """
    wanted = oversampling * k
    if (1 + rounds * wanted) * metric.p2 * 9 * len(reps) > CANDIDATE_BYTES:
        raise ValueError(f"k-means|| for {len(reps)} replicates would hold more than {CANDIDATE_BYTES} bytes of candidates")
    rows: dict[int, dict[int, dict]] = {rep: {} for rep in reps}
    first = _races(data, [(rep, 0, 1, None, []) for rep in reps], metric, seed, hashing).where(F.col("place") == 1)
    for r in first.collect():
        rows[r["rep"]][r["id"]] = r.asDict()
    if not all(rows.values()):
        raise ValueError(f"no rows to seed {k} clusters from")
    centers = lambda rep: rows_as_centers(list(rows[rep].values()), metric.p2)
    for turn in range(rounds):
        seeds = {rep: centers(rep) for rep in reps}
        costs = _costs(data, seeds, metric)
        chance = {rep: wanted / c for rep, c in costs.items() if c > 0}
        if not chance:
            break
        for r in sorted((r.asDict() for r in _drawn(data, {rep: seeds[rep] for rep in chance}, chance, turn, metric, seed, hashing).collect()), key=lambda r: (r["rep"], r["id"], str(r))):
            rows[r["rep"]].setdefault(r["id"], r)
    weights = {rep: np.zeros(len(rows[rep])) for rep in reps}
    for r in _weights(data, {rep: centers(rep) for rep in reps}, metric).collect():
        weights[r["rep"]][r["k"]] = r["n"]
    start = {rep: reduce_weighted(list(rows[rep].values()), weights[rep], min(k, len(rows[rep])), metric, seed, rep, hashing) for rep in reps}
    return seed_kmeanspp(data, k, metric, seed, reps, hashing, start)
