"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: sources in code point order, NULL last, take the weights in turn and share ``factor`` times all words; a target
stops at ``max_repeat`` times its source's size, and the excess is shared anew by weight (the level at which the sum of
min(cap, level * weight) meets the total).

The total is dealt out in blocks of ``block`` words: each next block goes to the source with the highest quotient
target / (2 * blocks + 1). A source's documents are dealt by hash to shards of about ``shard`` words; within a shard they
stand in hash order and are cut every ``block`` words. The source's blocks are apportioned to its shards in the same way.
A shard that gets q of n blocks takes each block q // n times and the first q % n blocks of a seeded permutation once more.

Scale: the driver sees one row per source (name, size), no more. Shards bound the rows that meet in one window, however
large a source is. A very common (id, text) pair lies in one shard, where the window spills.

Defined results: NULL text has size 0. Sources that hold no words get target 0. Repeated rows are separate rows with the
same hash; the words they take may differ by a block, in an order that their other columns do not influence. An empty
table gives an empty table. Extra columns are carried by ``mix`` if named in ``carry``.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from panelcast.llm.common import Scratch, table, words

WEIGHTS, FACTOR, MAX_REPEAT = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK, SHARD, SEED = 32, 1 << 18, 20
BROADCAST_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], factor: float, max_repeat: float) -> list[float]:
    """Target of each source, in the order given: shares by weight that stop at the cap, the excess reshared."""
    caps = [max_repeat * s for s in sizes]
    left, open_ = factor * sum(sizes), [i for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if caps[i] <= level * weights[i % len(weights)]]
        if not full:
            for i in open_:
                out[i] = level * weights[i % len(weights)]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        stopped = set(full)
        open_ = [i for i in open_ if i not in stopped]
    return out


def apportion(shares: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Sainte-Laguë: ``seats`` given one by one to the highest share / (2 * given + 1), ties to the earlier, up to caps.

    Starts from the rounded ideal and moves single seats until no seat wants to move, which gives the same result.
    """
    total = float(sum(shares))
    if total <= 0 or seats <= 0:
        return [0] * len(shares)
    seats = min(seats, sum(c for c, s in zip(caps, shares) if s > 0))
    given = [min(int(s * seats / total + 0.5), c) for s, c in zip(shares, caps)]
    want = [(-s / (2 * g + 1), i) for i, (s, g, c) in enumerate(zip(shares, given, caps)) if g < c and s > 0]
    have = [(s / (2 * g - 1), -i) for i, (s, g) in enumerate(zip(shares, given)) if g > 0]
    heapq.heapify(want)
    heapq.heapify(have)
    short = seats - sum(given)

    def give() -> None:
        _, i = heapq.heappop(want)
        given[i] += 1
        heapq.heappush(have, (shares[i] / (2 * given[i] - 1), -i))
        if given[i] < caps[i]:
            heapq.heappush(want, (-shares[i] / (2 * given[i] + 1), i))

    def take() -> None:
        _, i = heapq.heappop(have)
        i = -i
        if given[i] == 0:
            return
        given[i] -= 1
        if given[i]:
            heapq.heappush(have, (shares[i] / (2 * given[i] - 1), -i))
        heapq.heappush(want, (-shares[i] / (2 * given[i] + 1), i))

    def clean() -> None:
        while want and (given[want[0][1]] >= caps[want[0][1]] or -shares[want[0][1]] / (2 * given[want[0][1]] + 1) != want[0][0]):
            heapq.heappop(want)
        while have and (given[-have[0][1]] == 0 or shares[-have[0][1]] / (2 * given[-have[0][1]] - 1) != have[0][0]):
            heapq.heappop(have)

    clean()
    while short > 0 and want:
        give()
        short -= 1
        clean()
    while short < 0 and have:
        take()
        short += 1
        clean()
    while want and have and (-want[0][0], -want[0][1]) > have[0]:  # a waiting quotient beats one that was served
        take()
        clean()
        give()
        clean()
    return given


def _shard_quotas(block: int, max_repeat: float):
    def fill(key, frame: pd.DataFrame) -> pd.DataFrame:
        """Quota of each shard of one source. A shard is a row here, so a group has size / shard rows."""
        frame = frame.sort_values("shard", kind="stable")
        blocks = [-(-int(s) // block) for s in frame["shard_size"]]
        caps = [int(b * max_repeat) for b in blocks]
        seats = int(frame["seats"].iloc[0])
        return pd.DataFrame({
            "source_rank": frame["source_rank"], "shard": frame["shard"], "blocks": blocks,
            "quota": apportion(frame["shard_size"].astype(float).tolist(), caps, seats)})
    return fill


def _taken(seed: int, block: int):
    def run(batches):
        """Words taken of each row: overlaps of its span with the shard's blocks, times the blocks' counts."""
        for batch in batches:  # Arrow, so that carried columns pass through unchanged
            columns = {c: batch.column(c).to_pylist() for c in ("source_rank", "shard", "quota", "blocks", "at", "size")}
            lists, taken = [], []
            for rank, shard, quota, blocks, at, size in zip(*columns.values()):
                first, last = at // block, (at + max(size, 1) - 1) // block
                times = [0] * (last - first + 1 if size else 0)
                if size and quota:
                    base, more = divmod(quota, blocks)
                    times = (base + (_ranks(seed, rank, shard, blocks)[first:last + 1] < more)).tolist()
                lists.append(times)
                taken.append(sum(
                    t * (min((b + 1) * block, at + size) - max(b * block, at)) for b, t in enumerate(times, first)))
            table = pa.Table.from_batches([batch])
            table = table.append_column("times", pa.array(lists, pa.list_(pa.int64()))).append_column("taken", pa.array(taken, pa.int64()))
            yield from table.to_batches()
    return run


_rank_cache: dict[tuple, np.ndarray] = {}


def _ranks(seed: int, source: int, shard: int, blocks: int) -> np.ndarray:
    """Rank of each block in the shard's seeded permutation; rows of a shard follow each other, so one is held."""
    key = (seed, source, shard, blocks)
    if key not in _rank_cache:
        _rank_cache.clear()
        _rank_cache[key] = np.random.default_rng([seed, source, shard]).permutation(blocks)
    return _rank_cache[key]


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS, factor: float = FACTOR, max_repeat: float = MAX_REPEAT,
    block: int = BLOCK, shard: int = SHARD, seed: int = SEED,
) -> DataFrame:
    """One row per document: ``_id``, ``size``, ``source_size``, ``target``, ``taken``, and ``times``: how often each of
    the blocks that the document meets is taken, the first of them ``first_block`` words long. ``carry`` are more columns
    of the input, returned as ``c0``, ``c1`` and so on.
    """
    spark = docs.sparkSession
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    named = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("h"), *kept)
    named = Scratch(spark, "mixture").write(named, "sizes")  # words are counted once, for three uses
    rows = named.groupBy("_source").agg(F.sum("size").alias("n")).collect()  # one row per source
    rows.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode("utf-8")))
    sizes = [r["n"] for r in rows]
    want = targets(sizes, weights, factor, max_repeat)
    shards = [max(1, -(-n // shard)) for n in sizes]
    caps = [int(max_repeat * (n // block)) + (2 if n % block else 0) * k for n, k in zip(sizes, shards)]
    seats = apportion(want, caps, round(sum(want) / block))
    plan = spark.createDataFrame(
        [(r["_source"], i, sizes[i], float(want[i]), shards[i], seats[i]) for i, r in enumerate(rows)],
        "plan_source string, source_rank int, source_size long, target double, shards int, seats long")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_SOURCES else plan
    placed = named.join(plan, F.col("_source").eqNullSafe(F.col("plan_source"))).withColumn(
        "shard", F.pmod(F.xxhash64("h", F.lit(1)), F.col("shards")).cast("int"))
    quotas = (
        placed.groupBy("source_rank", "shard", "seats").agg(F.sum("size").alias("shard_size"))
        .groupBy("source_rank").applyInPandas(
            _shard_quotas(block, max_repeat), "source_rank int, shard int, blocks long, quota long"))
    key = Window.partitionBy("source_rank", "shard").orderBy("h", "_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("at", F.sum("size").over(key) - F.col("size"))
    joined = placed.join(quotas, ["source_rank", "shard"])
    columns = ["_id", *(f"c{i}" for i in range(len(carry))), "size", "source_size", "target", "source_rank", "shard",
               "blocks", "quota", "at"]
    out = joined.select(*columns)
    schema = StructType([*out.schema, StructField("times", ArrayType(LongType())), StructField("taken", LongType())])
    return out.mapInArrow(_taken(seed, block), schema).withColumn(
        "first_block", F.least(F.lit(block) - F.col("at") % block, F.col("size"))).drop(
        "source_rank", "shard", "blocks", "quota", "at")


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """The documents' own columns with the taken words as text: one row for what is taken once, one for what is taken
    twice, and so on. Words keep their spelling; white space between them becomes one space where blocks are cut, and a
    document that is taken whole keeps its text as it is. Rows of which nothing is taken are gone.
    """
    columns = docs.columns
    mixed = mix(docs, carry=columns, block=block, **options)
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    most = F.array_max(F.col("times"))
    rounds = mixed.where(F.col("taken") > 0).withColumn("_round", F.explode(F.sequence(F.lit(1), most)))
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    cut = F.concat_ws(" ", F.filter(
        words(text), lambda w, i: F.get(
            F.col("times"), F.when(i < F.col("first_block"), 0).otherwise(
                F.floor((i - F.col("first_block")) / block) + 1).cast("int")) >= F.col("_round")))
    whole = F.array_min(F.col("times")) >= F.col("_round")
    rounds = rounds.withColumn("_new", F.when(whole, text).otherwise(cut))
    types = dict(docs.dtypes)
    return rounds.select(*[
        F.col("_new").alias(c) if c == "text"
        else F.length("_new").cast(types[c]).alias(c) if c == "n_chars" else F.col(at[c]).alias(c) for c in columns])
