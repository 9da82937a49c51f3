"""Nearest neighbours by balanced posting lists.

Inner products become distances by one more coordinate, sqrt(M - |x|^2) with M the largest squared norm, so that the nearest
vector is the one with the largest product. Centroids are fitted on a bounded sample by k-means whose assignment charges for
full clusters. Every vector is then posted to its nearest centroid and, if it lies near a boundary, to up to ``REPLICAS`` in all:
those within ``CLOSURE`` times the smallest distance, unless a centroid taken before lies in nearly the same direction (closer
to it than ``APART`` times the vector's distance). Centroids are searched with a best-first walk over their neighbour graph, held
in memory (``MAX_LISTS`` centroids at most).

Neighbouring lists are read together, as parts of about ``BLOCK`` postings; longer lists are split by hash, and a query goes to all
their parts. A query first reads the part of its nearest list, which gives it a kth score. Then it reads every other list that may
hold a better row: the product with a row is at most that with the list's centroid plus |q| times the list's radius, and at most
|q| times the list's largest norm. So the result is exact, whatever the rows look like; only the work depends on how well the lists
separate them. With ``exact=False`` only those of these lists are read whose centroid is within a ratio of the distance of the
nearest one. The ratio is fitted on the sample: ``TRIALS`` of its rows are searched among all its rows by brute force, and the
ratio is the least that finds ``COVER`` of their neighbours; rows unlike the sample may then be missed.

A task holds the postings of one part and takes its queries as they come. It returns the best ``k`` per query of its parts, of
those that reach the query's kth score so far, and the best of all tasks are ranked.

Defined results: vectors that are NULL, zero, hold a NULL, NaN or infinite component, or have another length than the valid
vector with the smallest id take no part. A NULL id takes no part. Rows that repeat an id are queries and candidates of their own,
each row but the query's own. Ties go to the smaller id. With fewer than two vectors there are no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, table

K, LIST_SIZE, MAX_LISTS, SAMPLE = 20, 400, 2048, 40_000
CLOSURE, REPLICAS, APART = 1.12, 4, 0.5
COVER, TRIALS = 0.97, 256
BLOCK, DEGREE, BEAM, SEED, HELD, ASKED, PAIRS = 8192, 24, 96, 2, 1 << 18, 256, 1 << 16


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 12, charge: float = 0.5, seed: int = SEED) -> np.ndarray:
    """k-means whose assignment cost grows with a cluster's size in the round before."""
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:lists]].astype(np.float64)
    size = np.full(lists, len(x) / lists)
    spread = float(np.mean(np.var(x, axis=0).sum()))
    for _ in range(rounds):
        cost = charge * spread * (size / (len(x) / lists) - 1) * 0.1
        near = np.concatenate([
            np.argmin((centre**2).sum(1) - 2 * x[a:a + 4096] @ centre.T + cost, axis=1) for a in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=lists).astype(float)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        filled = size > 0
        centre[filled] = total[filled] / size[filled, None]
    return centre


def neighbour_graph(centre: np.ndarray, degree: int) -> np.ndarray:
    """Nearest centroids of each centroid, plus a ring that keeps the graph connected."""
    n = len(centre)
    d = (centre**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * centre @ centre.T
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : min(degree, n - 1)]
    return np.concatenate([near, ((np.arange(n) + 1) % n)[:, None]], axis=1)


def walk(x: np.ndarray, centre: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for the ``beam`` nearest centroids of each row, all rows in step. Distances, numbers; nearest first."""
    n, lists = len(x), len(centre)
    beam = min(beam, lists)
    starts = np.linspace(0, lists - 1, min(lists, max(beam, 16))).astype(int)
    square, own = (centre**2).sum(1), (x**2).sum(1)
    seen = np.zeros((n, lists), bool)
    seen[:, starts] = True
    ids = np.tile(starts, (n, 1))
    dist = own[:, None] + square[starts] - 2 * x @ centre[starts].T
    opened = np.zeros(ids.shape, bool)
    rows = np.arange(n)[:, None]
    for _ in range(4 * beam):
        waiting = np.where(opened, np.inf, dist)
        pick = np.argpartition(waiting, min(4, waiting.shape[1]) - 1, axis=1)[:, :4]
        if not np.isfinite(np.take_along_axis(waiting, pick, 1)).any():
            break
        np.put_along_axis(opened, pick, True, 1)
        found = graph[np.take_along_axis(ids, pick, 1)].reshape(n, -1)
        found = np.sort(found, axis=1)
        fresh = ~seen[rows, found]
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen[rows, found] = True
        d = own[:, None] + square[found] - 2 * np.einsum("ij,ikj->ik", x, centre[found])
        d = np.where(fresh, d, np.inf)
        ids = np.concatenate([ids, found], 1)
        dist = np.concatenate([dist, d], 1)
        opened = np.concatenate([opened, ~fresh], 1)
        keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        ids, dist, opened = (np.take_along_axis(a, keep, 1) for a in (ids, dist, opened))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.sqrt(np.maximum(np.take_along_axis(dist, order, 1), 0)), np.take_along_axis(ids, order, 1)


def lists_near(x: np.ndarray, centre: np.ndarray, graph: np.ndarray, ratio: float, beam: int = BEAM) -> tuple[np.ndarray, ...]:
    """Every centroid within ``ratio`` times the distance of the nearest one, as (row, list, whether it is the nearest).

    Rows whose beam ends before that distance walk again with twice the beam, so the ratio alone decides.
    """
    rows, lists, nearest_ = [], [], []
    open_ = np.arange(len(x))
    while len(open_):
        dist, ids = walk(x[open_], centre, graph, beam)
        inside = np.isfinite(dist) & (dist <= ratio * dist[:, :1] + 1e-12)
        done = ~inside[:, -1] | (dist.shape[1] == len(centre))
        at, place = np.nonzero(inside & done[:, None])
        rows.append(open_[at])
        lists.append(ids[at, place])
        nearest_.append(place == 0)
        open_, beam = open_[~done], 2 * beam
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, lists, nearest_))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]], axis=1)


def posted_lists(x: np.ndarray, centre: np.ndarray, graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of every lifted vector, as (row, list): the nearest, and more for vectors at a boundary."""
    dist, ids = walk(x, centre, graph, 32)
    rows, lists = [], []
    for r in range(len(x)):
        chosen = []
        for d, c in zip(dist[r], ids[r]):
            if len(chosen) == REPLICAS or (chosen and d > CLOSURE * dist[r, 0]):
                break
            if not np.isfinite(d) or any(((centre[c] - centre[o]) ** 2).sum() < (APART * d) ** 2 for o in chosen):
                continue
            chosen.append(c)
        rows += [r] * len(chosen)
        lists += chosen
    return np.array(rows, np.int64), np.array(lists, np.int64)


def fitted_ratio(x: np.ndarray, lifted: np.ndarray, centre: np.ndarray, graph: np.ndarray, k: int) -> float:
    """The least ratio whose lists hold ``COVER`` of the neighbours that the first ``TRIALS`` rows have among all rows."""
    trials = x[:TRIALS]
    score = trials @ x.T
    score[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
    top = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not top.size:
        return 1.0
    flat = np.concatenate([trials, np.zeros((len(trials), 1))], axis=1)
    far = np.sqrt(np.maximum((flat**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * flat @ centre.T, 0))
    far = far / np.maximum(far.min(1, keepdims=True), 1e-12)
    held, place = np.unique(top, return_inverse=True)
    row, lists = posted_lists(lifted[held], centre, graph)
    inside = np.zeros((len(held), len(centre)), bool)
    inside[row, lists] = True
    place = place.reshape(top.shape)
    need = np.array([np.where(inside[place[i]], far[i], np.inf).min(1) for i in range(len(trials))])
    return float(np.quantile(need, COVER, method="higher"))


def _post(index, most):
    def run(frames):
        centre, graph = index.value
        for f in frames:
            for at in range(0, len(f), 1024):
                g = f.iloc[at:at + 1024]
                x = np.stack(g["v"]).astype(np.float64)
                row, lists = posted_lists(_lifted(x, most), centre, graph)
                out = g.iloc[row]
                yield pd.DataFrame({
                    "row": out["row"].to_numpy(), "vec_id": out["vec_id"].to_numpy(), "v": out["v"].to_numpy(), "list": lists,
                    "first": np.diff(row, prepend=-1) != 0,  # each row's nearest list comes first
                    "away": np.linalg.norm(x[row] - centre[lists, :-1], axis=1), "norm": np.linalg.norm(x[row], axis=1)})
    return run


def _route(index, ratio):
    """Lists that each query reads."""
    def run(frames):
        centre, graph = index.value
        for f in frames:
            for at in range(0, len(f), 1024):
                g = f.iloc[at:at + 1024]
                x = np.stack(g["v"]).astype(np.float64)
                at_row, lists, first = lists_near(np.concatenate([x, np.zeros((len(x), 1))], axis=1), centre, graph, ratio)
                out = g.iloc[at_row]
                yield pd.DataFrame({"row": out["row"].to_numpy(), "vec_id": out["vec_id"].to_numpy(), "v": out["v"].to_numpy(),
                                    "list": lists, "first": first.astype(bool)})
    return run


def list_parts(centre: np.ndarray, size: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First part of every list and its number of parts. Neighbouring lists share a part; a list above ``block`` has its own."""
    first, number = np.zeros(len(size), np.int64), np.maximum(-(-size // block), 1)
    left, at, part, filled = np.ones(len(size), bool), 0, 0, 0
    while True:
        left[at] = False
        if filled and filled + size[at] > block:
            part, filled = part + 1, 0
        first[at] = part
        if number[at] > 1:
            part += number[at]
        else:
            filled += size[at]
        if not left.any():
            return first, number
        at = int(np.argmin(np.where(left, ((centre - centre[at]) ** 2).sum(1), np.inf)))


def _rest(index, ratio):
    """Parts besides the first one that may hold a row above a query's kth score so far; all lists within ``ratio`` if it is given."""
    def run(frames):
        centre, radius, norm, first, number = index.value
        flat = centre[:, :-1]
        size = np.linalg.norm(flat, axis=1) + radius
        for f in frames:
            for at in range(0, len(f), 1024):
                g = f.iloc[at:at + 1024]
                x = np.stack(g["v"]).astype(np.float64)
                length = np.linalg.norm(x, axis=1, keepdims=True)
                most = np.minimum(x @ flat.T + length * radius, length * norm) + 1e-9 * length * size
                read = (most >= g["least"].to_numpy(float)[:, None]) & (first != first[g["list"].to_numpy()][:, None]) & (norm >= 0)
                if ratio is not None:
                    far = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * x @ flat.T, 0))
                    read &= far <= ratio * far.min(1, keepdims=True) + 1e-12
                row, lists = np.nonzero(read)
                times = number[lists]
                row, part = np.repeat(row, times), np.repeat(first[lists], times)
                part = part + np.arange(len(part)) - np.repeat(np.cumsum(times) - times, times)
                row, part = np.unique(np.stack([row, part], 1), axis=0).T if len(row) else (row, part)
                out = g.iloc[row]
                yield pd.DataFrame({"row": out["row"].to_numpy(), "vec_id": out["vec_id"].to_numpy(), "v": out["v"].to_numpy(),
                                    "part": part, "least": out["least"].to_numpy()})
    return run


def _best(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """Best ``k`` different rows of every query."""
    whole = pd.concat(found).drop_duplicates(["query_row", "row"])
    whole = whole.sort_values(["query_row", "score", "vec_id", "row"], ascending=[True, False, True, True], kind="stable")
    return whole[whole.groupby("query_row").cumcount() < k]


def _search(k):
    """Best of the parts of a task, put together as they come, some ``HELD`` rows at a time."""
    def run(frames):
        held, size = [], 0
        for found in search_parts(frames):
            held.append(found)
            size += len(found)
            if size > HELD:
                yield _best(held, k)
                held, size = [], 0
        if size:
            yield _best(held, k)

    def search_parts(frames):
        part, waiting, stored = None, [], None
        for f in frames:
            cuts = np.flatnonzero(np.diff(f["part"].to_numpy())) + 1
            for a, b in zip([0, *cuts], [*cuts, len(f)]):
                g = f.iloc[a:b]
                if not len(g):
                    continue
                if g["part"].iat[0] != part:
                    part, waiting, stored = g["part"].iat[0], [], None
                query = g["query"].to_numpy(bool)  # a part's postings come before its queries
                if not query.all():
                    waiting.append(g[~query])
                if query.any() and waiting:
                    if stored is None:
                        other = pd.concat(waiting).drop_duplicates("row")
                        base = np.stack(other["v"]).astype(np.float64)
                        stored = other["row"].to_numpy(), other["vec_id"].to_numpy(), base, np.linalg.norm(base, axis=1)
                    for at in range(0, query.sum(), ASKED):
                        yield from found_in(g[query].iloc[at:at + ASKED], *stored)

    def found_in(mine, other, other_id, base, norm):
        own, own_id = mine["row"].to_numpy(), mine["vec_id"].to_numpy()
        vectors, least = np.stack(mine["v"]).astype(np.float64), mine["least"].to_numpy(float)[:, None]
        score = vectors @ base.T
        # Products of a batch differ in the last places from those summed one by one.
        loose = 1e-12 * np.linalg.norm(vectors, axis=1)[:, None] * norm
        score += loose
        score[own[:, None] == other] = -np.inf
        if score.shape[1] > k:
            kth = np.partition(score - 2 * loose, -k, axis=1)[:, -k][:, None]
            least = np.maximum(least, kth)
        q, j = np.nonzero((score >= least) & np.isfinite(score))
        exact = np.concatenate([np.zeros(0)] + [
            np.einsum("ij,ij->i", vectors[q[a:a + PAIRS]], base[j[a:a + PAIRS]]) for a in range(0, len(q), PAIRS)])
        order = np.lexsort((other[j], other_id[j], -exact, q))
        q, j, exact = q[order], j[order], exact[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, j, exact = q[keep], j[keep], exact[keep]
        yield pd.DataFrame({"query_row": own[q], "query_id": own_id[q], "row": other[j], "vec_id": other_id[j], "score": exact})
    return run


def nearest(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, exact: bool = True,
) -> DataFrame:
    """The ``k`` nearest other vectors of every row that fulfils ``queries`` (a condition on ``vec_id``)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    v = F.col(vector_col).cast("array<double>")
    named = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    named = scratch.write(named, "vectors")
    first = named.agg(F.min_by(F.size("v"), "vec_id")).first()[0]
    named = named.where(F.size("v") == F.lit(first or 0))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    count, most = named.agg(F.count("*"), F.max(norm)).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], result)
    lists = int(min(MAX_LISTS, max(1, -(-count // LIST_SIZE))))
    sample = named.orderBy(F.xxhash64("row", F.lit(SEED)), "row").limit(SAMPLE).select("v").toPandas()
    x = _lifted(np.stack(sample["v"]).astype(np.float64), most)
    lists = min(lists, len(x))
    centre = fit_centroids(x, lists)
    graph = neighbour_graph(centre, DEGREE) if lists > 1 else np.zeros((1, 1), int)
    ratio = None if exact else fitted_ratio(x[:, :-1], x, centre, graph, k)
    index = spark.sparkContext.broadcast((centre, graph))  # at most MAX_LISTS rows
    shape = "row long, vec_id long, v array<double>, list int, first boolean"
    posted = scratch.write(named.mapInPandas(_post(index, most), shape + ", away double, norm double"), "posted")
    size, radius, longest = np.zeros(lists, np.int64), np.zeros(lists), np.full(lists, -1.0)  # -1: nothing has this list as its nearest
    for r in posted.groupBy("list").agg(
            F.count("*").alias("n"), F.max(F.when(F.col("first"), F.col("away"))).alias("away"),
            F.max(F.when(F.col("first"), F.col("norm"))).alias("norm")).collect():  # at most MAX_LISTS rows
        size[r["list"]] = r["n"]
        if r["away"] is not None:
            radius[r["list"]], longest[r["list"]] = r["away"], r["norm"]
    start, number = list_parts(centre, size)
    reach = spark.sparkContext.broadcast((centre, radius, longest, start, number))  # at most MAX_LISTS rows
    asked = scratch.write(named.where(queries).mapInPandas(_route(index, 1.0), shape).where("first"), "asked")

    def at(values) -> Column:
        return F.get(F.lit(list(map(int, values))), F.col("list")).cast("long")

    part = at(start) + F.pmod(F.xxhash64("row"), at(number))
    columns = "row long, vec_id long, v array<double>, part long, least double"

    def search(stored: DataFrame, asked: DataFrame) -> DataFrame:
        """Best ``k`` of every part for every query, of those that reach the query's ``least`` score."""
        stored = stored.select("row", "vec_id", "v", part.alias("part"), F.lit(0.0).alias("least"), F.lit(False).alias("query"))
        both = stored.unionAll(asked.select("row", "vec_id", "v", "part", "least", F.lit(True).alias("query")))
        return both.repartition("part").sortWithinPartitions("part", "query").mapInPandas(
            _search(k), "query_row long, query_id long, row long, vec_id long, score double")

    own = asked.withColumn("part", F.explode(F.sequence(at(start), at(start) + at(number) - 1)))
    near = scratch.write(search(posted, own.withColumn("least", F.lit(float("-inf")))), "near")
    order = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    floor = near.withColumn("at", order).where(F.col("at") == k).select("query_row", F.col("score").alias("least"))
    open_ = asked.join(floor, F.col("row") == F.col("query_row"), "left").select(
        "row", "vec_id", "v", "list", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    # A row's nearest list alone decides here: the other lists that hold it need not be read for it.
    found = near.unionByName(search(posted.where("first"), open_.mapInPandas(_rest(reach, ratio), columns)))
    unique = found.groupBy("query_row", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return unique.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
