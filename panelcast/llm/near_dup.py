"""Near-duplicate groups with SetSketch registers.

A document is the set of its 5-word shingles (64-bit hashes). Its sketch has ``REGISTERS`` registers: register j is the
truncated, exponentially spaced minimum floor(1 - log_b(min_x E_j(x))) of exponential values E_j over the set, kept in two
bytes. Registers merge by maximum, and two sets agree in a register with a probability close to their Jaccard similarity.

1. Documents with equal sets are one node. Everything below works on nodes, so copies cost one row each.
2. Bands of four registers put nodes into buckets; at similarity 0.85 a pair meets with probability above 1 - 1e-9. The
   smallest node of a bucket leads it and is paired with every other member: as many pairs as members.
3. A pair is kept if the joint likelihood of the counts (larger, equal, smaller registers) at the threshold or above is
   not far below its maximum (five standard deviations). The size ratio alone excludes pairs exactly.
4. Kept pairs are verified on full sets, computed anew from the texts of the documents concerned.
5. Links only matter between different components. Buckets whose members are in one component are done. In the others the
   members outside the leader's component meet all members of another component, in blocks of at most ``CHUNK`` by
   ``CHUNK`` nodes; a block that has a plausible pair is verified exactly and returns a spanning forest of its links. So no
   link between different texts is lost, and rows never grow with the square of a bucket.
6. Components by repeated contraction: every node takes its smallest neighbour, labels are followed, edges are relabelled.

Defined results: a NULL or empty text, or one without words, has no shingles and is linked with nothing. Fewer than five
words are one shingle. Repeated rows are in one group. A NULL id counts as larger than all others. An empty table gives an
empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import TEXT_ROWS, Scratch, mix64, sorted_groups, table, text_chunks, word_hashes

SHINGLE, PERCENT = 5, 85
REGISTERS, ROWS, BASE, RATE = 128, 4, 1.001, 20.0
CHUNK, CHUNK_SHINGLES = 1024, 1 << 21
BROADCAST_KEYS = 1 << 21  # ids of texts to read again: 16 bytes each
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_C = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = word_hashes(texts)
    n = np.diff(first)
    if len(h) >= size:
        flat = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            flat += mix64(h[k:len(h) - size + 1 + k] ^ _C[k]) * _C[k]
        flat = mix64(flat)
    out = []
    for i, k in enumerate(n.tolist()):
        at = first[i]
        if k >= size:
            out.append(np.unique(flat[at:at + k - size + 1]))
        elif k:
            short = np.uint64(k)
            for j, x in enumerate(h[at:at + k]):
                short = mix64(np.array([short]) + mix64(np.array([x]) ^ _C[j + 32]) * _C[j + 32])[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that is not empty."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        x = shingles[at:at + 512, None] ^ _B
        x *= _A
        np.minimum(low, x.min(axis=0), out=low)
    u = (low.astype(np.float64) + 1.0) / 18446744073709551616.0
    value = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype("<u2")


def _set_id(shingles: np.ndarray) -> int:
    """Order-free 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mix64(np.array([np.sum(mix64(shingles ^ _C[60]), dtype=np.uint64) + np.uint64(len(shingles)) * _C[61]]))
    return int(total.view(np.int64)[0])


def _log_p(x: np.ndarray) -> np.ndarray:
    """Probability that one register is larger, for the part x of the union that only its set has."""
    return np.log(np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12))


def plausible(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a similarity of at least ``threshold`` is within five standard deviations of the likeliest one."""
    ratio = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = REGISTERS - larger - smaller

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _log_p(u - v * j), _log_p(v - u * j)
        rest = np.log(np.maximum(1 - np.exp(p) - np.exp(q), 1e-12))
        return larger * p + smaller * q + equal * rest

    best_all = best_above = np.full(len(ratio), -np.inf)
    for f in np.linspace(0, 1, 17):
        best_all = np.maximum(best_all, log_likelihood(ratio * f))
        best_above = np.maximum(best_above, log_likelihood(np.minimum(threshold + (ratio - threshold) * f, ratio)))
    best_all = np.maximum(best_all, best_above)
    return (ratio >= threshold - 1e-12) & (best_all - best_above <= 12.5)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), REGISTERS)


def _sketch(frames):
    for f in text_chunks(frames, 4 << 20):
        sets = shingle_sets(f["_text"].tolist())
        yield pd.DataFrame({
            "_id": f["_id"], "text_key": f["text_key"],
            "node": pd.array([_set_id(s) if len(s) else None for s in sets], "Int64"),
            "n": [len(s) for s in sets],
            "registers": [registers(s).tobytes() if len(s) else None for s in sets]})


def _sets(frames):
    for f in text_chunks(frames, 4 << 20):
        sets = shingle_sets(f["_text"].tolist())
        yield pd.DataFrame({"node": [_set_id(s) for s in sets], "shingles": [s.tobytes() for s in sets]})


def _likely(threshold: float):
    def keep(frames):
        for f in frames:
            if not len(f):
                continue
            a, b = _matrix(f["ra"]), _matrix(f["rb"])
            ok = plausible((a > b).sum(1), (a < b).sum(1), f["na"].to_numpy(float), f["nb"].to_numpy(float), threshold)
            yield f.loc[ok, ["a", "b"]]
    return keep


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of whether 100 * intersection >= percent * union, exactly."""
    shared = np.zeros((len(sets_a), len(sets_b)), np.int64)
    if len(sets_a) * len(sets_b) <= 256:
        for i, a in enumerate(sets_a):
            for j, b in enumerate(sets_b):
                shared[i, j] = len(np.intersect1d(a, b, assume_unique=True))
    else:  # incidence matrices over slices of the shingles that both sides have
        both = np.intersect1d(np.unique(np.concatenate(sets_a)), np.unique(np.concatenate(sets_b)), assume_unique=True)
        for at in range(0, len(both), 8192):
            part = both[at:at + 8192]

            def incidence(sets):
                m = np.zeros((len(sets), len(part)), np.float32)
                for i, s in enumerate(sets):
                    s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                    place = np.searchsorted(part, s)
                    m[i, place[part[np.minimum(place, len(part) - 1)] == s]] = 1
                return m

            shared += np.rint(incidence(sets_a) @ incidence(sets_b).T).astype(np.int64)
    total = np.array([len(s) for s in sets_a])[:, None] + np.array([len(s) for s in sets_b])
    return 100 * shared >= percent * (total - shared)


def _forest(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Links that join different groups, in order; enough to connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(links)):
        x, y = root(a[i]), root(b[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a[i], b[j]))
    return out


def _verify(percent: int):
    def check(frames):
        for g in sorted_groups(frames, "block"):
            g = g.drop_duplicates(["node", "first"])
            sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            first, nodes = g["first"].to_numpy(bool), g["node"].to_numpy()
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(left) or not len(right):
                continue
            links = linked([sets[i] for i in left], [sets[j] for j in right], percent)
            links &= nodes[left][:, None] != nodes[right]
            edges = _forest(nodes[left], nodes[right], links)
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])
    return check


def _open_pairs(threshold: float):
    """Members of a block that have a plausible pair across components which no earlier band has shown."""
    bands = REGISTERS // ROWS

    def check(frames):
        for g in sorted_groups(frames, "block"):
            first, comp, band = g["first"].to_numpy(bool), g["comp"].to_numpy(), int(g["band"].iloc[0])
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(left) or not len(right):
                continue
            node, n, regs = g["node"].to_numpy(), g["n"].to_numpy(float), _matrix(g["registers"])
            pairs = comp[left][:, None] != comp[right]
            keys = regs.view("<u8").reshape(len(g), bands)
            for k in range(band):
                pairs &= keys[left, k][:, None] != keys[right, k]
            i, j = np.nonzero(pairs)
            ok = np.zeros(len(i), bool)
            for at in range(0, len(i), 8192):
                x, y = left[i[at:at + 8192]], right[j[at:at + 8192]]
                ok[at:at + 8192] = plausible(
                    (regs[x] > regs[y]).sum(1), (regs[x] < regs[y]).sum(1), n[x], n[y], threshold)
            if ok.any():
                keep = np.unique(np.concatenate([left[i[ok]], right[j[ok]]]))
                yield pd.DataFrame({"block": g["block"].to_numpy()[keep], "node": node[keep], "first": first[keep]})
    return check


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) with the smallest node of each component, for all nodes that have an edge."""
    edges = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}_e0")
    labels, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.write(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")), f"{name}_p{turn}")
        up = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = scratch.write(parent.join(up, "up", "left").select("node", F.coalesce("top", "up").alias("to")), f"{name}_s{turn}")
        if labels is None:
            labels = step.withColumnRenamed("to", "comp")
        else:
            moved = step.select(F.col("node").alias("comp"), "to")
            labels = labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = scratch.write(labels, f"{name}_l{turn}")
        one = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        two = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = scratch.write(
            edges.join(one, "a").join(two, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}_e{turn + 1}")
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, ``text_key``, ``n_shingles``, ``component_id`` (its smallest id), ``kept``.

    ``kept`` marks the rows with the smallest (id, text_key) of a group; only repeated rows share that pair.
    """
    spark, threshold = docs.sparkSession, percent / 100
    scratch = Scratch(spark, "neardup", TEXT_ROWS)
    id_type = dict(docs.dtypes)[id_col]
    named = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn(
        "text_key", F.xxhash64("_text"))
    sketches = scratch.write(
        named.withColumn("_id", F.col("_id").cast("string"))  # text, as pandas has no NULL for integers
        .mapInPandas(_sketch, "_id string, text_key long, node long, n long, registers binary")
        .withColumn("_id", F.col("_id").cast(id_type)), "sketches")
    nodes = scratch.write(
        sketches.where("n > 0").groupBy("node").agg(
            F.min(F.struct("_id", "text_key")).alias("at"), F.any_value("n").alias("n"),
            F.any_value("registers").alias("registers")), "nodes")

    bands = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1))).alias("band"), "registers").select(
        "node", "band", F.expr(f"substring(registers, band * {2 * ROWS} + 1, {2 * ROWS})").alias("key"))
    buckets = bands.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1")
    shared = scratch.write(bands.join(buckets, ["band", "key"]), "shared")

    pairs = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    side = nodes.select("node", "n", "registers")
    wide = (
        pairs.join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "b")
        .join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    stars = scratch.write(wide.mapInPandas(_likely(threshold), "a long, b long"), "stars")
    fan = stars.groupBy("a").agg(F.count("*").alias("fan"))
    star_rows = stars.join(fan, "a").withColumn(
        "block", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("fan") / CHUNK))))
    blocks = star_rows.select("block", F.col("b").alias("node"), F.lit(False).alias("first")).unionAll(
        star_rows.select("block", F.col("a").alias("node"), F.lit(True).alias("first")).distinct())

    def verify(blocks: DataFrame, name: str) -> DataFrame:
        blocks = scratch.write(blocks, f"{name}_blocks")
        wanted = nodes.join(blocks.select("node").distinct(), "node", "left_semi").select(
            F.col("at._id").alias("want_id"), F.col("at.text_key").alias("want_key"))
        wanted = scratch.write(wanted, f"{name}_wanted")
        few = wanted.count() <= BROADCAST_KEYS
        texts = named.join(
            F.broadcast(wanted) if few else wanted,
            (F.col("text_key") == F.col("want_key")) & F.col("_id").eqNullSafe(F.col("want_id")), "left_semi")
        sets = texts.select("_text").mapInPandas(_sets, "node long, shingles binary")
        full = blocks.join(sets, "node").select("block", "node", "first", "shingles")
        return scratch.write(
            full.repartition("block").sortWithinPartitions("block").mapInPandas(_verify(percent), "a long, b long"),
            f"{name}_edges")

    edges = verify(blocks, "stars")
    labels = components(edges, scratch, "stars")

    # Buckets that still hold several components.
    member = shared.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    state = member.groupBy("band", "key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"),
        F.max(F.when(F.col("node") == F.col("leader"), F.col("comp"))).alias("lead_comp")).where("low <> high AND size > 2")
    opened = member.join(state, ["band", "key"]).where("node <> leader").join(side, "node")
    weight = opened.groupBy("band", "key").agg(
        F.sum("n").alias("weight"), F.sum((F.col("comp") != F.col("lead_comp")).cast("long")).alias("outside")).where("outside > 0")
    # Fewest blocks: members outside are cut into as many parts as they need, all members likewise.
    parts = F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int")
    opened = opened.join(weight, ["band", "key"]).withColumn("all_parts", parts).withColumn(
        "out_parts", F.ceil(F.col("all_parts") * F.col("outside") / F.col("size")).cast("int"))
    name = F.xxhash64("node", "band")
    columns = ["band", "node", "comp", "n", "registers"]
    rows = opened.where("comp <> lead_comp").withColumn("x", F.pmod(name, "out_parts")).withColumn(
        "y", F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1))).select(
        F.xxhash64("band", "key", F.col("x").cast("int"), "y").alias("block"), F.lit(True).alias("first"), *columns,
    ).unionAll(opened.withColumn("y", F.pmod(name, "all_parts")).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col("out_parts") - 1))).select(
        F.xxhash64("band", "key", "x", F.col("y").cast("int")).alias("block"), F.lit(False).alias("first"), *columns))
    open_blocks = rows.repartition("block").sortWithinPartitions("block").mapInPandas(
        _open_pairs(threshold), "block long, node long, first boolean")
    more = verify(open_blocks, "open")
    labels = components(edges.unionAll(more), scratch, "all")

    found = sketches.join(labels, "node", "left").select(
        "_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("comp"))
    heads = found.where("n_shingles > 0").groupBy("comp").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "text_key")).alias("head"))
    return found.join(heads, "comp", "left").select(
        F.col("_id").alias(id_col), "text_key", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("_id")).otherwise(F.col("head._id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | (F.col("_id").eqNullSafe(F.col("head._id")) & (F.col("text_key") == F.col("head.text_key")))
         ).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
