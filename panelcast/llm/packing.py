"""Packing by lexical retrieval: a sharded BM25 inverted index fills each window with unused neighbours of its seed.

Documents are encoded once and stored (an end id closes each). Windows that one document fills alone are cut off first. What
is left of every document, less than a window, goes to a shard of at most about ``shard_tokens`` tokens that holds its lexical
neighbours: its BM25 weights are projected to ``DIM`` numbers, a tree of median splits along principal directions, fitted on a
bounded sample, gives its leaf, and shards are cut from the leaves in tree order, each leaf ordered by a hash of the document's
strongest term. Only a leaf and term that alone exceed a shard are dealt to several by row. A shard builds an
inverted index over token ids (BM25; document frequencies come from the whole table, a vector as long as the vocabulary).
The first unused document seeds a window; its ``query_terms`` strongest terms are looked up, and the best-scoring unused
documents follow until the window is full. The last one is cut to fit and its rest is unused again. At the end of a shard the
last window is cut into sequences whose lengths are powers of two, which need no padding.

Neighbours on two sides of a cut between shards do not meet; the README states how many do.

Scale: a shard bounds what a task holds, whatever a source or a group of copies holds; only the encoded documents are
shuffled, once. They are stored a second time with their place in the tree, and the first table is dropped. Token ids take two
bytes where the vocabulary allows. The driver holds the sample's projections and one total for each leaf and hash
(``2 ** MAX_DEPTH * TERM_BINS`` at most).

Defined results: a NULL or empty text is the end id alone. Repeated rows are packed each. A longer text is cut into many
windows. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.bpe import byte_lengths, encoder, public_files
from panelcast.llm.common import TEXT_ROWS, Scratch, arrow_rows, sorted_groups, table

WINDOW, END_ID = 2048, 1
SHARD_TOKENS, QUERY_TERMS = 1 << 20, 24
K1, B = 1.2, 0.75
DIM, SAMPLE, MAX_DEPTH, TERM_BINS, SEED = 64, 16_384, 12, 64, 4


def _encode(files, end_id, vocab):
    kind = "<u2" if vocab <= 65536 else "<u4"

    def run(frames):
        enc = encoder(**(files or public_files()))
        for f in frames:
            ids = [np.append(enc.encode(t), end_id).astype(kind).tobytes() for t in f["_text"]]
            yield pd.DataFrame({"row": f["row"], "_id": f["_id"], "ids": ids, "n": [len(i) // int(kind[2]) for i in ids]})
    return run


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, sorted, and their counts; a stable sort of two-byte ids is a radix sort, a third of ``np.unique``'s time."""
    x = np.sort(ids, kind="stable")
    new = np.ones(len(x) + 1, bool)
    np.not_equal(x[1:], x[:-1], out=new[1:-1])
    at = np.flatnonzero(new)
    return x[at[:-1]], at[1:] - at[:-1]


def _frequencies(kind):
    """Documents that hold each token id, summed over a task."""
    def run(frames):
        total = np.zeros(0, np.int64)
        for f in frames:
            for b in f["ids"]:
                terms = term_counts(np.frombuffer(b, kind))[0]
                if terms[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(terms[-1]) + 1 - len(total), np.int64)])
                total[terms] += 1
        held = np.flatnonzero(total)
        yield pd.DataFrame({"term": held, "df": total[held]})
    return run


def pack_rests(terms: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, idf: np.ndarray, window: int, query_terms: int):
    """Windows of (document, from, length) over documents of the given sizes; every token lies in one window.

    ``terms`` gives each document's distinct ids and their counts.
    """
    n = len(sizes)
    count = np.array([len(t) for t, _ in terms])
    doc = np.repeat(np.arange(n), count)
    term = np.concatenate([t for t, _ in terms]).astype(np.int64)
    tf = np.concatenate([c for _, c in terms]).astype(np.float64)
    length = sizes / max(1.0, sizes.mean())
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc]))
    order = np.argsort(term, kind="stable")
    posting_doc, posting_weight = doc[order], weight[order]
    start_of = np.searchsorted(term[order], np.arange(len(idf) + 1))
    offset_of = np.concatenate(([0], np.cumsum(count)))
    done, free = np.zeros(n, np.int64), np.ones(n, bool)
    windows, seed = [], 0
    while seed < n:
        if not free[seed]:
            seed += 1
            continue
        room = window - min(window, int(sizes[seed] - done[seed]))
        pieces = [(seed, int(done[seed]), window - room)]
        done[seed] += window - room
        free[seed] = done[seed] < sizes[seed]
        if room:
            at, to = offset_of[seed], offset_of[seed + 1]
            best = at + np.argsort(-weight[at:to], kind="stable")[:query_terms]
            score = np.zeros(n)
            for t in term[best]:
                a, b = start_of[t], start_of[t + 1]
                score[posting_doc[a:b]] += posting_weight[a:b]
            score[~free] = -1.0
            while room:
                j = int(np.argmax(score))
                if score[j] < 0:
                    break
                take = min(room, int(sizes[j] - done[j]))
                pieces.append((j, int(done[j]), take))
                done[j] += take
                room -= take
                free[j] = done[j] < sizes[j]
                score[j] = -1.0
        windows.append(pieces)
    return windows


def binary_cuts(pieces, window: int):
    """The pieces of a window that is not full, cut into sequences whose lengths are powers of two."""
    left = sum(p[2] for p in pieces)
    if left == window:
        return [pieces]
    out, queue = [], [list(p) for p in reversed(pieces)]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        part = []
        while room:
            d, at, k = queue.pop()
            take = min(k, room)
            part.append((d, at, take))
            room -= take
            if take < k:
                queue.append([d, at + take, k - take])
        out.append(part)
    return out


def projection(vocab: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((vocab, DIM), dtype=np.float32)


def signature(ids: np.ndarray, window: int, idf: np.ndarray, project: np.ndarray) -> tuple[np.ndarray, int]:
    """Direction of the projected BM25 weights of what full windows leave of a document, and its strongest term."""
    term, tf = term_counts(ids[len(ids) // window * window:] if len(ids) % window else ids)
    weight = idf.take(term) * (tf * (K1 + 1) / (tf + K1))
    v = weight.astype(np.float32) @ project.take(term, axis=0)
    return v / max(float(np.sqrt(v @ v)), 1e-9), int(term[np.argmax(weight)])


def fit_tree(x: np.ndarray, depth: int) -> list[tuple[np.ndarray, float]]:
    """Splits of a complete binary tree in heap order: (direction, median) for ``2 ** depth - 1`` nodes."""
    rng = np.random.default_rng(SEED)
    rows, splits = [np.arange(len(x))], []
    for node in range(2**depth - 1):
        held = x[rows[node]].astype(np.float64)
        u = rng.standard_normal(x.shape[1])
        if len(held) > 1:
            spread = np.cov(held.T)
            for _ in range(30):
                u = spread @ u + 1e-12 * u
                u /= max(float(np.sqrt(u @ u)), 1e-30)
        along = held @ u
        cut = float(np.median(along)) if len(held) else 0.0
        splits.append((u, cut))
        rows += [rows[node][along <= cut], rows[node][along > cut]]
    return splits


def leaves(x: np.ndarray, splits: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Number of each row's leaf, from left to right."""
    node = np.zeros(len(x), np.int64)
    if splits:
        direction, cut = np.stack([u for u, _ in splits]), np.array([c for _, c in splits])
        for _ in range(len(splits).bit_length()):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, direction[node]) > cut[node])
    return node - len(splits)


def cut_shards(codes: np.ndarray, tokens: np.ndarray, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each code; neighbouring codes share a shard while they fit."""
    order = np.argsort(codes)
    first, parts = np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64)
    shard, held = 0, 0
    for i in order:
        if held and held + tokens[i] > shard_tokens:
            shard, held = shard + 1, 0
        first[i], parts[i] = shard, max(1, math.ceil(tokens[i] / shard_tokens))
        held += tokens[i]
        if parts[i] > 1:
            shard, held = shard + int(parts[i]), 0
    return first, parts


def _signatures(idf_value, window, kind):
    def run(frames):
        idf = idf_value.value
        project = projection(len(idf))
        for f in frames:
            yield pd.DataFrame({"v": [signature(np.frombuffer(b, kind), window, idf, project)[0] for b in f["ids"]]})
    return run


def _codes(idf_value, splits_value, window, kind):
    def run(frames):
        idf, splits = idf_value.value, splits_value.value
        project = projection(len(idf))
        for f in frames:
            if len(f):
                found = [signature(np.frombuffer(b, kind), window, idf, project) for b in f["ids"]]
                term = np.array([t for _, t in found], np.int64)
                leaf = leaves(np.stack([v for v, _ in found]).astype(np.float64), splits)
                yield f.assign(code=leaf * TERM_BINS + term * 40503 % 65536 // (65536 // TERM_BINS))
    return run


def route(scratch: Scratch, tokens: DataFrame, rows: int, idf, window: int, kind: str, shards: int, shard_tokens: int) -> DataFrame:
    """The table ``tokens`` of ``scratch`` with a column ``shard``: lexical neighbours get the same one."""
    spark = tokens.sparkSession
    depth = min(MAX_DEPTH, math.ceil(math.log2(4 * shards)))
    chance = min(1.0, min(SAMPLE, 64 << depth) / max(1, rows))
    drawn = tokens.where(F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(1 << 30)) < int(chance * (1 << 30))).select("ids")
    with arrow_rows(spark, TEXT_ROWS):
        vectors = drawn.mapInPandas(_signatures(idf, window, kind), "v array<float>").limit(SAMPLE).toPandas()["v"]
    x = np.stack(vectors) if len(vectors) else np.zeros((1, DIM), np.float32)
    depth = min(depth, max(0, (len(x) // 8).bit_length() - 1))  # eight sampled documents a leaf at least
    splits = spark.sparkContext.broadcast(fit_tree(x, depth))
    # The encoded documents are stored once more, with their codes, in place of the first table: codes are worked out once.
    every = scratch.write(tokens.mapInPandas(_codes(idf, splits, window, kind), "row long, _id string, ids binary, n long, code long"), "coded")
    scratch.drop("tokens")
    totals = every.groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    first, parts = cut_shards(totals["code"].to_numpy(), totals["n"].to_numpy(), shard_tokens)
    cuts = spark.createDataFrame(pd.DataFrame({"code": totals["code"], "first": first, "parts": parts}))
    return every.join(F.broadcast(cuts), "code").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("code", "first", "parts")


def _pack(idf_value, window, query_terms, kind, keep_ids):
    def run(frames):
        idf = idf_value.value
        for g in sorted_groups(frames, "shard"):
            g = g.sort_values("row", kind="stable")
            ids = [np.frombuffer(b, kind) for b in g["ids"]]
            names = g["_id"].tolist()
            full = [len(x) // window * window for x in ids]
            rest = [i for i, x in enumerate(ids) if len(x) > full[i]]
            sequences = [[(i, at, window)] for i, x in enumerate(ids) for at in range(0, full[i], window)]
            if rest:
                terms = [term_counts(ids[i][full[i]:]) for i in rest]
                sizes = np.array([len(ids[i]) - full[i] for i in rest])
                packed = pack_rests(terms, sizes, idf, window, query_terms)
                short = [w for w in packed if sum(p[2] for p in w) < window]
                whole = [w for w in packed if sum(p[2] for p in w) == window]
                # Only the last windows of a shard can be short; together they are cut again.
                flat = [p for w in short for p in w]
                while flat:
                    room, part = window, []
                    while flat and room:
                        d, at, k = flat.pop(0)
                        take = min(k, room)
                        part.append((d, at, take))
                        room -= take
                        if take < k:
                            flat.insert(0, (d, at + take, k - take))
                    whole.extend(binary_cuts(part, window))
                sequences += [[(rest[d], full[rest[d]] + at, k) for d, at, k in w] for w in whole]
            base = int(g["shard"].iloc[0]) << 32
            rows = []
            for s, pieces in enumerate(sequences):
                offset = 0
                for d, at, k in pieces:
                    part = ids[d][at:at + k].astype("<u4")
                    row = (names[d], at, k, zlib.crc32(part.tobytes()), len(ids[d]), base + s, offset)
                    rows.append((*row, part.astype(np.int64)) if keep_ids else row)
                    offset += k
            columns = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pd.DataFrame(rows, columns=columns + ["ids"] * keep_ids)
    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS, query_terms: int = QUERY_TERMS, files: dict | None = None, keep_ids: bool = True,
) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of sequences of at most ``window`` ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing", TEXT_ROWS)
    id_type = dict(docs.dtypes)[id_col]
    vocab = max(end_id + 1, len(byte_lengths((files or public_files())["path"])))
    kind = "<u2" if vocab <= 65536 else "<u4"
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    # Ids travel as text, as pandas has no NULL for integers.
    tokens = scratch.write(named.mapInPandas(_encode(files, end_id, vocab), "row long, _id string, ids binary, n long"), "tokens")
    total, rows = tokens.agg(F.sum("n"), F.count("*")).first()
    frequency = tokens.select("ids").mapInPandas(_frequencies(kind), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(vocab, np.float64)
    with arrow_rows(spark, TEXT_ROWS):
        counted = frequency.collect()  # at most one row per vocabulary entry
    for r in counted:
        df[r["term"]] = r["df"]
    idf = spark.sparkContext.broadcast(np.log1p((rows - df + 0.5) / (df + 0.5)))
    shards = max(1, math.ceil((total or 0) / shard_tokens))
    dealt = tokens.withColumn("shard", F.lit(0).cast("long"))
    if shards > 1:
        dealt = route(scratch, tokens, rows, idf, window, kind, shards, shard_tokens)
    out = "_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out += ", ids array<long>" if keep_ids else ""
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInPandas(
        _pack(idf, window, query_terms, kind, keep_ids), out).withColumn(
        "_id", F.col("_id").cast(id_type)).withColumnRenamed("_id", id_col)


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
