"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs over all training documents are quantised on a logarithmic scale: a count c has level
1 + floor(log_b c). The filter holds the events (n-gram, 1) .. (n-gram, level). A lookup probes levels upwards until one is
missing; the last hit gives the count back to within a factor b. Besides the n-grams, the filter holds for each word the
mass that its frequent successors keep, as a third kind of event.

Smoothing is absolute discounting: with tau = ``DISCOUNT``,

    p(w | h) = max(c(h w) - tau, 0) / c(h) + (1 - kept(h) / c(h)) * p(w),    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

so that pairs seen once carry no mass of their own and need no place. The first word of a text has the history "start of text".

The filter grows with the corpus: it lies in buckets of n-grams by hash, and no task holds more than one bucket. Documents are
stored in batches, their texts compressed. Each batch sends its distinct n-grams once, as one block of sorted keys to each
bucket, with their counts in its training documents (0 for others). A bucket adds the counts up, builds its part of the filter,
looks all keys of all blocks up in it, and sends a byte per key back to the batch. Pairs go first; what their counts keep by
history then meets the words in the words' buckets. ``max_bytes`` bounds a bucket's part of the filter: a bucket has about as
many events as tokens, and their number sets the number of buckets. Pairs and words are spread by hash, and a batch sends a
frequent one once, so no bucket is hot.

The base score needs exact counts of every word; a word's bucket sends its count beside its levels.

Words and pairs are 64-bit hashes (a pair: 32 bits of each word). Keys travel as differences, so their bytes in a shuffle
follow the distance of neighbours, not the hash's width.

Defined results: a NULL or empty text has one token, the end. Repeated rows are separate rows. A table without training
documents gives N = V = 0. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, crc_fold, mix64, table, text_chunks, word_hashes

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
MAX_BYTES, LEVEL_BASE, BITS_PER_EVENT, PROBES = 48 << 20, 1.5, 12, 6
DISCOUNT = 1
BATCH_CHARS, BUCKET_CHARS = 4 << 20, 16 << 20
WORDS, PAIRS, KEPT = 1, 2, 3
SEGMENT_BITS, LOOKUPS = 1 << 19, 1 << 16


def level_of(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1; 0 for no count."""
    return np.where(count >= 1, 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(LEVEL_BASE) + 1e-9), 0).astype(np.int64)


_LEVEL_VALUE = np.concatenate(([0.0], [
    max(1.0, (math.ceil(LEVEL_BASE ** (j - 1) - 1e-9) + math.ceil(LEVEL_BASE ** j - 1e-9) - 1) / 2) for j in range(1, 110)]))


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and each text's first token number (one more at the end)."""
    h, first = word_hashes(texts)
    n = np.diff(first) + 1
    start = np.concatenate(([0], np.cumsum(n)))
    out = np.full(start[-1], END, np.uint64)
    inside = np.ones(start[-1], bool)
    inside[start[1:] - 1] = False
    out[inside] = h
    return out, start


def pair_keys(words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories and pair keys of all tokens."""
    history = np.concatenate(([START], words[:-1]))
    history[start[:-1]] = START
    return history, (history & np.uint64(0xFFFFFFFF00000000)) | (mix64(words) >> np.uint64(32))


def unmix64(x: np.ndarray) -> np.ndarray:
    """The value that ``mix64`` has spread."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, as many bytes as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def _blocks(keys: np.ndarray, counts: np.ndarray, buckets: int):
    """(bucket, number, keys, counts) of sorted keys. Keys are differences: their high bytes are mostly zero, which compression removes."""
    bucket = bucket_of(keys, buckets)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(bucket[a]), int(b - a), _planes(np.diff(keys[a:b], prepend=np.uint64(0))), _planes(counts[a:b])


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high half of a key, so that sorted keys are sorted by bucket."""
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts.astype(np.int64)[order], at)


def _batches(frames):
    """A row per batch of documents: ids, folds, sizes in bytes, and the compressed texts."""
    for f in text_chunks(frames, BATCH_CHARS):
        raw = [t.encode("utf-8", "replace") for t in f["_text"]]
        yield pd.DataFrame({
            "batch": [int(f["row"].iat[0])], "_id": [f["_id"].tolist()], "trained": [[None if x is None else bool(x) for x in f["trained"]]],
            "sizes": [[len(r) for r in raw]], "data": [pa.compress(b"".join(raw), codec="zstd", asbytes=True)]})


def _batch_tokens(sizes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of a stored batch."""
    cut = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))
    whole = pa.decompress(data, decompressed_size=int(cut[-1]), codec="zstd", asbytes=True) if cut[-1] else b""
    return tokens([whole[a:b] for a, b in zip(cut[:-1], cut[1:])])


BLOCKS = "kind int, batch long, bucket int, n long, keys binary, counts binary"


def _frame(rows, shape: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")])


def _ask(kind: int, buckets: int):
    """Each batch's distinct pairs or words with their counts in training documents."""
    def run(frames):
        for f in frames:
            for batch, trained, sizes, data in zip(f["batch"], f["trained"], f["sizes"], f["data"]):
                words, start = _batch_tokens(sizes, data)
                taught = np.repeat(np.array([t is not None and bool(t) for t in trained]), np.diff(start))
                if kind == PAIRS:
                    keys, counts = _summed(mix64(pair_keys(words, start)[1]), taught)
                else:  # the start of a text is a history too
                    keys, counts = _summed(np.append(words, START), np.append(taught, sum(1 for t in trained if t)))
                yield _frame([(kind, batch, *block) for block in _blocks(keys, counts, buckets)], BLOCKS)
    return run


def event_bits(kind: np.ndarray, key: np.ndarray, level: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each n-gram, and the bit positions of its event (one row per event, one column per probe)."""
    name = mix64(key ^ (kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    segment = (name % np.uint64(segments)).astype(np.int64)
    event = mix64(name + level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    a, b = event & np.uint64(0xFFFFFFFF), (event >> np.uint64(32)) | np.uint64(1)
    bits = (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(SEGMENT_BITS)
    return segment, bits.astype(np.int64)


def build_filter(kind: np.ndarray, key: np.ndarray, level: np.ndarray) -> Filter:
    """The filter that holds the events of these n-grams; an n-gram's events all lie in one segment."""
    segments = max(1, math.ceil(int(level.sum()) * BITS_PER_EVENT / SEGMENT_BITS))
    held = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
    while len(key):  # level by level, from each n-gram's own down to 1
        for at in range(0, len(key), LOOKUPS):  # bounds the memory of the positions
            segment, bits = event_bits(kind[at:at + LOOKUPS], key[at:at + LOOKUPS], level[at:at + LOOKUPS], segments)
            place = (segment[:, None] * SEGMENT_BITS + bits).ravel()
            np.bitwise_or.at(held, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        more = level > 1
        kind, key, level = kind[more], key[more], level[more] - 1
    return Filter(held, segments)


class Filter:
    """A bucket's part of the filter: quantised counts of n-grams."""

    def __init__(self, bits: np.ndarray, segments: int):
        self.bits, self.segments = bits, segments

    def level(self, kind: int, key: np.ndarray) -> np.ndarray:
        if len(key) > LOOKUPS:  # bounds the memory of the probes
            return np.concatenate([self.level(kind, key[at:at + LOOKUPS]) for at in range(0, len(key), LOOKUPS)])
        out = np.zeros(len(key), np.int64)
        name = mix64(key ^ np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64)))
        first = (name % np.uint64(self.segments)) * np.uint64(SEGMENT_BITS)
        active, level = np.arange(len(key)), 1
        while len(active) and level < len(_LEVEL_VALUE):
            event = mix64(name[active] + np.uint64(level * 0xC2B2AE3D27D4EB4F % (1 << 64)))
            a, b, start = event & np.uint64(0xFFFFFFFF), (event >> np.uint64(32)) | np.uint64(1), first[active]
            for k in range(PROBES):  # most keys leave at the first or second probe
                at = start + ((a + b * np.uint64(k)) & np.uint64(SEGMENT_BITS - 1))
                hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                active, a, b, start = active[hit], a[hit], b[hit], start[hit]
            out[active] = level
            level += 1
        return out

    def count(self, kind: int, key: np.ndarray) -> np.ndarray:
        return _LEVEL_VALUE[self.level(kind, key)]


def _read_blocks(frame: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of each block, and the sums of all blocks."""
    keys = [np.cumsum(_from_planes(k, n), dtype=np.uint64) for k, n in zip(frame["keys"], frame["n"])]
    if not keys:
        return [], *_summed(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    counts = np.concatenate([_from_planes(c, n) for c, n in zip(frame["counts"], frame["n"])])
    return keys, *_summed(np.concatenate(keys), counts)


ANSWERED = BLOCKS.replace("keys binary, counts binary", "keys binary, counts binary, data binary")


def _pair_bucket(word_buckets: int):
    """A byte for each key asked for: its level in the filter, 0 where it has none; and what the pairs keep, by history."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        blocks, keys, counts = _read_blocks(frame)
        own = counts > DISCOUNT  # others keep no mass
        held = build_filter(np.full(int(own.sum()), PAIRS), keys[own], level_of(counts[own]))
        level = held.level(PAIRS, keys).astype(np.uint8)
        rows = [(PAIRS, batch, bucket, len(k), None, None, level[np.searchsorted(keys, k)].tobytes())
                for batch, bucket, k in zip(frame["batch"], frame["bucket"], blocks)]
        history = unmix64(keys[own]) & np.uint64(0xFFFFFFFF00000000)
        rows += [(KEPT, -1, *block, None) for block in _blocks(*_summed(history, counts[own] - DISCOUNT), word_buckets)]
        return _frame(rows, ANSWERED)
    return run


WORD_ANSWERS = "batch long, bucket int, n long, data binary, total long, distinct long"


def _word_bucket(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Levels of the words asked for and of what they keep as histories, and the words' exact counts; one row of totals."""
    asked = frame[frame["kind"] == WORDS]
    blocks, keys, counts = _read_blocks(asked)
    half, sums = _read_blocks(frame[frame["kind"] == KEPT])[1:]
    own = counts > 0
    kept = np.zeros(len(keys), np.int64)
    if len(half):
        high = keys & np.uint64(0xFFFFFFFF00000000)
        place = np.minimum(np.searchsorted(half, high), len(half) - 1)
        kept = np.where(own & (half[place] == high), sums[place], 0)
    known, keeps = keys[own], kept > 0
    held = build_filter(
        np.repeat([WORDS, KEPT], [len(known), int(keeps.sum())]), np.concatenate((known, keys[keeps])),
        np.concatenate((level_of(counts[own]), level_of(kept[keeps]))))
    levels = np.stack((held.level(WORDS, keys), held.level(KEPT, keys))).astype(np.uint8)
    rows = []
    for batch, bucket, k in zip(asked["batch"], asked["bucket"], blocks):
        at = np.searchsorted(keys, k)
        rows.append((batch, bucket, len(k), levels[:, at].tobytes() + _planes(counts[at]), 0, 0))
    words = known != START
    rows.append((-1, -1, 0, b"", int(counts[own][words].sum()), int(words.sum())))
    return _frame(rows, WORD_ANSWERS)


def token_scores(here, before, pair, count, kept, total: int, distinct: int) -> np.ndarray:
    """log10 p(w | h) of every token: places of its word and history in ``count`` and ``kept``, and its pair's count."""
    p = (count[here] + 0.5) / (total + 0.5 * (distinct + 1))
    c_history = np.maximum(count[before], 1)
    left = np.clip(1 - kept[before] / c_history, 0.02, 1)
    seen = np.minimum(np.maximum(pair - DISCOUNT, 0) / c_history, 1)
    return np.log10(np.minimum(np.where(seen > 0, (1 - left) * np.minimum(seen * c_history / np.maximum(kept[before], 1e-9), 1), 0)
                               + left * p, 1))


SCORES = "_id string, trained boolean, n_tokens long, n_known long, base_score double, score double"


def _score(total: int, distinct: int):
    def run(key, batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, trained, sizes, data = (batch[c].iat[0] for c in ("_id", "trained", "sizes", "data"))
        words, start = _batch_tokens(sizes, data)
        answers = answers.sort_values("bucket")  # blocks in the order of keys
        of = {kind: answers[answers["kind"] == kind] for kind in (WORDS, PAIRS)}
        unique, here = np.unique(words, return_inverse=True)
        keys = unique if START in unique else np.insert(unique, np.searchsorted(unique, START), START)
        first = int(np.searchsorted(keys, START))
        if len(keys) > len(unique):
            here = here + (here >= first)
        before = np.concatenate(([first], here[:-1]))
        before[start[:-1]] = first
        levels, exact = [], []
        for n, block in zip(of[WORDS]["n"], of[WORDS]["data"]):
            levels.append(np.frombuffer(block, np.uint8, 2 * n).reshape(2, n))
            exact.append(_from_planes(block[2 * n:], n))
        count, kept = _LEVEL_VALUE[np.concatenate(levels, axis=1)]
        exact = np.concatenate(exact).astype(np.float64)[here]
        pairs, back = np.unique(mix64(pair_keys(words, start)[1]), return_inverse=True)
        pair = _LEVEL_VALUE[np.frombuffer(b"".join(of[PAIRS]["data"]), np.uint8)]
        if len(count) != len(keys) or len(pair) != len(pairs):
            raise RuntimeError("a batch's answers are not complete")
        score = token_scores(here, before, pair[back], count, kept, total, distinct)
        base = np.log10((exact + 0.5) / (total + 0.5 * (distinct + 1)))
        return pd.DataFrame({
            "_id": list(ids), "trained": pd.array([None if t is None else bool(t) for t in trained], "boolean"), "n_tokens": np.diff(start),
            "n_known": np.add.reduceat((exact > 0).astype(np.int64), start[:-1]),
            "base_score": np.add.reduceat(base, start[:-1]), "score": np.add.reduceat(score, start[:-1])})
    return run


def lm_scores(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per document: ``_id``, ``trained``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``training`` is a condition on the input's columns; its documents teach the model, all documents are scored.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    id_type = dict(docs.dtypes)[id_col]
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("_id"), training.alias("trained"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    batches = scratch.write(named.mapInPandas(
        _batches, "batch long, _id array<string>, trained array<boolean>, sizes array<long>, data binary"), "batches")
    size, rows = batches.agg(
        F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)),
        F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    # A text of s characters has at most s / 2 + 1.5 tokens, and a bucket no more events than tokens.
    buckets = max(1, -(-size // BUCKET_CHARS), math.ceil((size / 2 + 1.5 * rows) * BITS_PER_EVENT / 8 / max_bytes))
    word_buckets = -(-buckets // 4)

    texts = batches.select("batch", "trained", "sizes", "data")
    pairs = scratch.write(texts.mapInPandas(_ask(PAIRS, buckets), BLOCKS).groupBy("bucket").applyInPandas(
        _pair_bucket(word_buckets), ANSWERED), "pairs")
    kept = pairs.where(F.col("kind") == KEPT).drop("data")
    words = scratch.write(texts.mapInPandas(_ask(WORDS, word_buckets), BLOCKS).unionByName(kept).groupBy("bucket").applyInPandas(
        _word_bucket, WORD_ANSWERS), "words")
    total, distinct = words.where("batch < 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    answers = pairs.where(F.col("kind") == PAIRS).select("kind", "batch", "bucket", "n", "data").unionByName(
        words.where("batch >= 0").select(F.lit(WORDS).alias("kind"), "batch", "bucket", "n", "data"))
    scored = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_score(total, distinct), SCORES)
    return scored.select(
        F.col("_id").cast(id_type).alias("_id"), "trained", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score")


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_fold(F.col("doc_id"), 5)
    scored = lm_scores(table(spark, sf_dir, "documents"), fold != 1)
    return scored.select(
        F.col("_id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")
