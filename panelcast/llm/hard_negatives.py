"""Hard negatives by a tree of bounding boxes, packed by sort-tile-recursive (STR).

Rows are dealt to tiles of about ``TILE`` rows: the label and the coordinates of widest spread are cut in turn into slices,
by cuts fitted on a bounded sample; a tile that holds more (a hot vector, a large table) is dealt to parts by row, so that no
group is larger. A tile is packed the same way into leaves of ``LEAF`` rows, and every leaf and tile has its minimum bounding
box. For a query vector q a box gives an interval of inner products: each coordinate adds q * low or q * high.

A search looks for the first k rows of the same (or another) label whose score lies in a window. It goes best first: each query
visits the tile of the highest bound, which gives its kth score; then all other tiles whose interval meets the window and is
not strictly below that kth. Inside a tile leaves are taken from the highest bound on, ``STEP`` at a time, under the same two
tests. Nothing else is left out, so results are exact. Positives are one window without bounds, negatives one window for each
positive of an anchor, all windows of an anchor sharing its visits.

Scale: queries and the directory of tiles meet in blocks of ``BLOCK`` queries by ``DIRECTORY`` tiles, queries and tiles in
groups of ``BLOCK`` queries by one tile. The driver holds the sample and its cuts (4,096 tiles before parts). Boxes of many
wide-spread coordinates prune little; then all rows are read by every block of anchors, which grows with (anchors) x (rows).

Defined results: rows with a NULL id, label or vector or any NULL or non-finite component take no part. Shorter vectors count
as filled up with zeros. Rows that repeat an id are rows of their own; ties go to the smaller id, then to the row read first.
Anchors without positives or without a negative in a window give no rows for it. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, table

TILE, LEAF, STEP = 4096, 64, 8
SAMPLE, MOST_TILES = 16_384, 4096
BLOCK, DIRECTORY = 1024, 1024
FAR = 1 << 62  # beyond every score


# --- sort-tile-recursive packing -----------------------------------------------------------------------------------

def widest(points: np.ndarray) -> np.ndarray:
    """Coordinates from the widest spread down."""
    return np.argsort(-points.astype(float).std(0), kind="stable") if len(points) else np.arange(points.shape[1])


def fit_cuts(points: np.ndarray, axes: list[int], tiles: int):
    """A tree of (axis, cuts, children) with about ``tiles`` leaves of equal numbers of points."""
    if tiles <= 1 or not axes or len(points) < 2:
        return None
    slices = min(max(2, int(np.ceil(tiles ** (1 / len(axes)) - 1e-9))), tiles)
    values = np.sort(points[:, axes[0]])
    cuts = np.unique(values[(np.arange(1, slices) * len(values)) // slices])
    at = np.searchsorted(cuts, points[:, axes[0]], side="right")
    share = -(-tiles // slices)
    return axes[0], cuts, [fit_cuts(points[at == s], axes[1:], share) for s in range(len(cuts) + 1)]


def tile_of(points: np.ndarray, tree, first: int = 0) -> tuple[np.ndarray, int]:
    """Leaf number of each point, and the next free number."""
    out = np.full(len(points), first, np.int64)
    if tree is None:
        return out, first + 1
    axis, cuts, children = tree
    at = np.searchsorted(cuts, points[:, axis], side="right")
    for s, child in enumerate(children):
        here = at == s
        out[here], first = tile_of(points[here], child, first)
    return out, first


def str_order(points: np.ndarray, axes: list[int], capacity: int) -> np.ndarray:
    """Order of the points in which every ``capacity`` neighbours form a leaf."""
    leaves = -(-len(points) // capacity)
    if leaves <= 1 or not axes:
        return np.arange(len(points))
    slices = max(2, int(np.ceil(leaves ** (1 / len(axes)) - 1e-9)))
    order = np.argsort(points[:, axes[0]], kind="stable")
    size = -(-leaves // slices) * capacity
    return np.concatenate([
        part[str_order(points[part], axes[1:], capacity)] for part in (order[i:i + size] for i in range(0, len(order), size))])


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every query with any point of every box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


# --- search --------------------------------------------------------------------------------------------------------

def reachable(least, most, low, high, kth):
    """Best score still to be had by (query, window, box), -inf where the box can be left out."""
    best = np.minimum(most[:, None, :], high[:, :, None]).astype(float)
    out = (most[:, None, :] < low[:, :, None]) | (least[:, None, :] > high[:, :, None]) | (low > high)[:, :, None]
    out |= best < kth[:, :, None]
    best[out] = -np.inf
    return best


def label_fits(labels: np.ndarray, first: np.ndarray, last: np.ndarray, same: bool) -> np.ndarray:
    """Whether a box with labels from first to last can hold a row of the same (another) label."""
    if same:
        return (first <= labels[:, None]) & (labels[:, None] <= last)
    return ~((first == labels[:, None]) & (last == labels[:, None]))


def first_k(key, score, ids, rows, k):
    """Positions of the first k entries of every key: by score from the highest, then id, then row."""
    order = np.lexsort((rows, ids, -score, key))
    ordered = key[order]
    start = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
    at = np.arange(len(ordered))
    return order[at - np.maximum.accumulate(np.where(start, at, 0)) < k]


def search_tile(q, own, labels, low, high, kth, tile, k, same):
    """First k rows of a tile for every (query, window): arrays (query, window, score, id, row)."""
    points, ids, rows, row_labels = tile["points"], tile["ids"], tile["rows"], tile["labels"]
    starts = np.arange(0, len(ids), LEAF)
    box = [f.reduceat(points, starts, axis=0) for f in (np.minimum, np.maximum)]
    span = [f.reduceat(row_labels, starts) for f in (np.minimum, np.maximum)]
    least, most = intervals(q, *box)
    fits = label_fits(labels, *span, same)
    kth, windows = kth.astype(float), low.shape[1]
    best = reachable(least, most, low, high, kth)
    best[np.broadcast_to(~fits[:, None, :], best.shape)] = -np.inf
    order = np.argsort(-best.max(1), axis=1, kind="stable")
    held = [np.zeros(0, np.int64), np.zeros(0, points.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for step in range(0, len(starts), STEP):
        pick = order[:, step:step + STEP]
        bound = np.take_along_axis(best, pick[:, None, :], 2)
        query, place = np.nonzero((np.isfinite(bound) & (bound >= kth[:, :, None])).any(1))
        leaf = pick[query, place]
        by_leaf = np.argsort(leaf, kind="stable")
        query, leaf = query[by_leaf], leaf[by_leaf]
        found = [[h] for h in held]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)])) if len(leaf) else [0]
        for i, to in zip(cuts[:-1], cuts[1:]):
            who, at = query[i:to], int(starts[leaf[i]])
            rest = slice(at, at + LEAF)
            score = q[who] @ points[rest].T
            right = (row_labels[rest] == labels[who][:, None]) == same
            right &= rows[rest] != own[who][:, None]
            for w in range(windows):
                keep = right & (score >= low[who, w][:, None]) & (score <= high[who, w][:, None]) & (score >= kth[who, w][:, None])
                x, y = np.nonzero(keep)
                if len(x):
                    for column, values in zip(found, (who[x] * windows + w, score[x, y], ids[rest][y], rows[rest][y])):
                        column.append(values)
        if len(found[0]) > 1:
            held = [np.concatenate(c) for c in found]
            keep = first_k(*held, k)
            held = [h[keep] for h in held]
            key, count = np.unique(held[0], return_counts=True)
            full = key[count == k]
            last = np.searchsorted(held[0], full, side="right") - 1  # first_k leaves entries by key, best first
            kth.ravel()[full] = np.maximum(kth.ravel()[full], held[1][last])
    query, window = np.divmod(held[0], windows)
    return query, window, held[1].astype(np.int64), held[2], held[3]


# --- the job -------------------------------------------------------------------------------------------------------

def _pack_vectors(dims, kind):
    def run(frames):
        at = TaskContext.get().partitionId() << 33
        for f in frames:
            q = np.zeros((len(f), dims))
            for i, v in enumerate(f["_vec"]):
                q[i, : len(v)] = v
            q = np.floor(256.0 * q).astype(kind)
            yield pd.DataFrame({"row": np.arange(at, at + len(f)), "vec_id": f["_id"], "label": f["_label"],
                                "anchor": f["_anchor"], "q": [v.tobytes() for v in q]})
            at += len(f)
    return run


def _matrix(raw, kind, dims):
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), dims)


def _with_label(f, kind, dims):
    return np.concatenate([_matrix(f["q"], kind, dims).astype(np.int64), f["label"].to_numpy()[:, None]], 1)


def _deal(shared, kind, dims):
    def run(frames):
        for f in frames:
            if len(f):
                f["tile"] = tile_of(_with_label(f, kind, dims), shared.value)[0]
                yield f
    return run


def _build(kind, dims):
    """One row for a tile: its rows in leaf order, and its bounding box."""
    def run(f):
        f = f.sort_values("row")  # leaves do not depend on the order of arrival
        points = _with_label(f, kind, dims)
        f = f.iloc[str_order(points, [dims, *[a for a in widest(points).tolist() if a != dims]], LEAF)]
        q, labels = _matrix(f["q"], kind, dims), f["label"].to_numpy()
        return pd.DataFrame({
            "tile": [f["tile"].iloc[0]], "part": [f["part"].iloc[0]], "points": [q.tobytes()],
            **{name: [f[c].to_numpy(np.int64).tobytes()] for name, c in (("ids", "vec_id"), ("rows", "row"), ("labels", "label"))},
            "low": [q.min(0).astype("<i8").tobytes()], "high": [q.max(0).astype("<i8").tobytes()],
            "first": [labels.min()], "last": [labels.max()]})
    return run


_QUERY = "row long, label long, q binary, low array<long>, high array<long>, kth array<long>"


class HardNegatives:
    """The packed tree over a table of vectors, stored in the shared folder."""

    def __init__(self, vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                 label: Column | str = "label"):
        self.spark = vectors.sparkSession
        self.scratch = Scratch(self.spark, "hard_negatives")
        label = F.col(label) if isinstance(label, str) else label
        whole = vectors.select(
            F.col(id_col).cast("long").alias("_id"), label.cast("long").alias("_label"),
            F.coalesce(anchor, F.lit(False)).alias("_anchor"), F.col(vector_col).cast("array<double>").alias("_vec"),
        ).where("_id is not null and _label is not null and _vec is not null").where(
            F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        found = whole.agg(
            F.count("*").alias("n"), F.max(F.size("_vec")).alias("dims"),
            F.max(F.coalesce(F.array_max(F.transform("_vec", F.abs)), F.lit(0.0))).alias("most")).first()
        self.count, self.dims = found["n"], max(1, found["dims"] or 1)
        largest = 256.0 * (found["most"] or 0.0) + 1
        if self.dims * largest * largest * 100 >= FAR:
            raise ValueError("components are too large for scores of 64 bits")
        self.kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
        # Sums of products stay exact in doubles, which have the fast products, up to 2**53.
        self.exact = np.float64 if self.dims * largest * largest < 1 << 53 else np.int64
        self.rows = self.scratch.write(
            whole.mapInPandas(_pack_vectors(self.dims, self.kind), "row long, vec_id long, label long, anchor boolean, q binary"),
            "rows")
        self._build_tree()

    def _build_tree(self) -> None:
        kind, dims = self.kind, self.dims
        tiles = min(MOST_TILES, -(-self.count // TILE))
        sample = self.rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, self.count))) < SAMPLE).select("label", "q").limit(
            2 * SAMPLE).toPandas()
        points = _with_label(sample, kind, dims) if len(sample) else np.zeros((0, dims + 1), np.int64)
        axes = [dims, *[a for a in widest(points).tolist() if a != dims]]
        tree = fit_cuts(points, axes, tiles)
        dealt = self.rows.mapInPandas(
            _deal(self.spark.sparkContext.broadcast(tree), kind, dims),
            "row long, vec_id long, label long, anchor boolean, q binary, tile long")
        dealt = self.scratch.write(dealt, "dealt")
        sizes = dealt.groupBy("tile").agg(F.count("*").alias("size")).withColumnRenamed("tile", "_tile")
        parts = dealt.join(F.broadcast(sizes), F.col("tile") == F.col("_tile")).withColumn(  # at most MOST_TILES rows
            "part", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / F.lit(TILE)).cast("long")))
        self.tiles = self.scratch.write(
            parts.select("row", "vec_id", "label", "q", "tile", "part").groupBy("tile", "part").applyInPandas(
                _build(kind, dims),
                "tile long, part long, points binary, ids binary, rows binary, labels binary, low binary, high binary, "
                "first long, last long"), "tiles")
        self.directory_blocks = max(1, -(-self.tiles.count() // DIRECTORY))
        self.directory = self.tiles.select(
            "tile", "part", "low", "high", "first", "last",
            F.pmod(F.xxhash64("tile", "part"), F.lit(self.directory_blocks)).alias("_dir"))

    def _route(self, queries: DataFrame, same: bool, seeds: bool) -> DataFrame:
        """Queries with the tiles they must visit: the best one, or all others still in reach."""
        dims, kind, exact = self.dims, self.kind, self.exact

        def choose(f: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            columns = ["tile", "part", "row", "label", "q", "low", "high", "kth", "_block"]
            if not len(f) or not len(d):
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
            d = d.sort_values(["tile", "part"])
            least, most = intervals(_matrix(f["q"], kind, dims).astype(exact), *(
                _matrix(d[c], "<i8", dims).astype(exact) for c in ("low", "high")))
            low, high, kth = (np.stack(f[c].to_numpy()) for c in ("low", "high", "kth"))
            fits = label_fits(f["label"].to_numpy(), d["first"].to_numpy(), d["last"].to_numpy(), same)

            def best(limit):
                out = reachable(least, most, low, high, limit).max(1)
                out[~fits] = -np.inf
                return out

            start = best(np.full(kth.shape, -np.inf))
            seed = start.argmax(1)
            live = np.zeros(start.shape, bool)
            if seeds:
                live[np.arange(len(f)), seed] = True
                live &= np.isfinite(start)
            else:
                live = np.isfinite(best(kth.astype(float)))
                live[np.arange(len(f)), seed] = False
            at, to = np.nonzero(live)
            out = f.iloc[at].reset_index(drop=True)
            out["tile"], out["part"] = d["tile"].to_numpy()[to], d["part"].to_numpy()[to]
            return out[columns]

        blocks = F.sequence(F.lit(0).cast("long"), F.lit(self.directory_blocks - 1).cast("long"))
        left = queries.withColumn("_dir", F.explode(blocks))
        right = self.directory.withColumn(
            "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.query_blocks - 1).cast("long"))))
        return left.groupBy("_block", "_dir").cogroup(right.groupBy("_block", "_dir")).applyInPandas(
            choose, f"tile long, part long, {_QUERY}, _block long")

    def _visit(self, routed: DataFrame, k: int, same: bool) -> DataFrame:
        dims, kind, exact = self.dims, self.kind, self.exact

        def look(f: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            columns = ["row", "slot", "score", "hit_id", "hit_row"]
            if not len(f) or not len(t):
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
            t = t.iloc[0]
            tile = {"points": np.frombuffer(t["points"], kind).reshape(-1, dims).astype(exact),
                    **{c: np.frombuffer(t[c], np.int64) for c in ("ids", "rows", "labels")}}
            low, high, kth = (np.stack(f[c].to_numpy()) for c in ("low", "high", "kth"))
            query, slot, *rest = search_tile(
                _matrix(f["q"], kind, dims).astype(exact), f["row"].to_numpy(), f["label"].to_numpy(), low, high, kth, tile, k, same)
            return pd.DataFrame(dict(zip(columns, (f["row"].to_numpy()[query], slot, *rest))))

        keys = routed.select(F.col("tile").alias("_t"), F.col("part").alias("_p"), F.col("_block").alias("_b")).distinct()
        tiles = self.tiles.select("tile", "part", "points", "ids", "rows", "labels").join(
            keys, (F.col("tile") == F.col("_t")) & (F.col("part") == F.col("_p")))
        return routed.groupBy("tile", "part", "_block").cogroup(tiles.groupBy("_t", "_p", "_b")).applyInPandas(
            look, "row long, slot int, score long, hit_id long, hit_row long")

    def search(self, queries: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """First k rows in every window of every query: (row, slot, rank, score, hit_id, hit_row).

        ``queries`` has (row, label, q, low, high); low and high are arrays with one entry a window.
        """
        count = queries.count()
        self.query_blocks = max(1, -(-count // BLOCK))
        queries = queries.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(self.query_blocks)))
        open_ = queries.withColumn("kth", F.transform("low", lambda _: F.lit(-FAR)))
        seeds = self.scratch.write(self._visit(self.scratch.write(self._route(open_, same, True), f"{name}_to"), k, same), f"{name}_seed")
        # A window's kth score, where the first tile gave k rows.
        full = seeds.groupBy("row", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(
            F.col("n") == k).groupBy(F.col("row").alias("_row")).agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("known"))
        ready = queries.join(full, F.col("row") == F.col("_row"), "left").withColumn(
            "kth", F.transform("low", lambda _, i: F.coalesce(F.try_element_at("known", i), F.lit(-FAR)))).drop("_row", "known")
        rest = self._visit(self.scratch.write(self._route(ready, same, False), f"{name}_on"), k, same)
        order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "hit_id", "hit_row")
        return self.scratch.write(
            seeds.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)

    def mine(self, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90) -> DataFrame:
        """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

        Negatives have least_percent * positive_score <= 100 * negative_score <= most_percent * positive_score.
        """
        anchors = self.rows.where("anchor").select("row", "vec_id", "label", "q")
        near = self.search(
            anchors.drop("vec_id").withColumns({"low": F.array(F.lit(-FAR)), "high": F.array(F.lit(FAR))}), positives, True, "near")
        # A window of a score below zero is empty: its lower bound lies above the upper one.
        windows = near.select(
            "row", "rank", F.when(F.col("score") < 0, F.lit(FAR)).otherwise(
                F.expr(f"(score * {least_percent}L + 99L) div 100L")).alias("up"),
            F.when(F.col("score") < 0, F.lit(-FAR)).otherwise(F.expr(f"(score * {most_percent}L) div 100L")).alias("down"))
        slots = F.sequence(F.lit(0), F.lit(positives - 1))

        def bound(name, without):
            return F.transform(slots, lambda i: F.coalesce(F.get("w", i)[name], F.lit(without)))

        ready = windows.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "up", "down"))).alias("w")).select(
            F.col("row").alias("_row"), bound("up", FAR).alias("low"), bound("down", -FAR).alias("high"))
        queries = self.scratch.write(anchors.drop("vec_id").join(ready, F.col("row") == F.col("_row")).drop("_row"), "windows")
        far = self.search(queries, negatives, False, "far").select(
            F.col("row").alias("_row"), F.col("slot").alias("_slot"), F.col("rank").cast("int").alias("rank"),
            F.col("hit_id").alias("negative_id"), F.col("score").alias("negative_score"))
        return near.select("row", "rank", "hit_id", "score").withColumnsRenamed(
            {"rank": "_rank", "hit_id": "positive_id", "score": "positive_score"}).join(
            far, (F.col("row") == F.col("_row")) & (F.col("_rank") == F.col("_slot") + 1)).join(
            anchors.select(F.col("row").alias("_anchor"), F.col("vec_id").alias("anchor_id")), F.col("row") == F.col("_anchor")).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector, every seventh one being mislabelled."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return HardNegatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label).mine()


ORACLE_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 10
"""
