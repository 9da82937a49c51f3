"""Best-fit packing by patterns of lengths, fitted with non-negative least squares.

Documents are encoded (an end id closes each) and only those longer than the window are cut, into whole windows and a rest.
Then just the histogram of piece lengths matters, at most ``window`` numbers. All patterns of one, two or three lengths that
fill a window exactly are enumerated; non-negative least squares (an active-set solver) finds how often each must repeat to
give the histogram. Repeats are rounded and kept within the stock of each length. What is left is packed from the longest
down, each length into the fullest sequences that take it, whole counts at a time; short documents, of which more than three
fill a window, come this way.

The result is a plan of runs: "ranks a to b of length L go to sequences from s on, k in each, at offset o". A piece finds its
rank without a sort: it is numbered among equal lengths inside its block of at most ``BLOCK`` pieces while it is encoded, and
the counts of (block, length) are summed up over the blocks of a length.

Scale: one pass over the texts; token ids are not shuffled or stored unless asked for. The driver holds the histogram and the
plan, whose runs number at most ``2 * window`` groups of sequences times the 63 different lengths that a window can hold; the
plan is broadcast. Blocks follow the order of the table, so a hot length or a group of copies is spread over all blocks.

Defined results: a NULL or empty text is the end id alone. Repeated rows are packed each. An empty table gives no pieces. Other
columns are not read. The plan depends only on the histogram, so reruns agree in the number of sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, table, text_chunks

WINDOW, END_ID = 2048, 0
BLOCK, CHUNK = 1 << 16, 1 << 22
ROUNDS = 120  # of the solver; the residual is packed anyway


# --- token ids -----------------------------------------------------------------------------------------------------

# Characters for which this module's lower-casing and splitting are those of the vocabulary file; other texts go through
# ``tokenizers`` as they are.
_PLAIN = re.compile("[\t-\r -~\xa0-ɏ]*")
_ASCII_WORD = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LATIN_WORD = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zªµºß-öø-ʯⱥⱦ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ʯⱥⱦ²³¹¼½¾]+")
_MAX_WORDS, _LONG_WORD = 1 << 20, 32


class WordEncoder:
    """Ids of a vocabulary that splits at words, each word encoded once and kept; ids take two bytes each."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.full.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary needs more than two bytes an id")
        self.known: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers; none for NULL."""
        out: list = [b""] * len(texts)
        open_texts, missing = [], {}
        if len(self.known) > _MAX_WORDS:
            self.known.clear()
        get = self.known.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if not _PLAIN.fullmatch(text):
                out[i] = self._bytes([text])[0]
                continue
            found = (_ASCII_WORD if text.isascii() else _LATIN_WORD).findall(text.lower())
            parts = list(map(get, found))
            if None in parts:
                missing.update((w, None) for w, p in zip(found, parts) if p is None)
                open_texts.append((i, found))
            else:
                out[i] = b"".join(parts)
        if missing:
            new = list(missing)
            fresh = dict(zip(new, self._bytes(new)))
            for i, found in open_texts:
                out[i] = b"".join([get(w) or fresh[w] for w in found])
            self.known.update((w, b) for w, b in fresh.items() if len(w) <= _LONG_WORD)
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)


# --- patterns ------------------------------------------------------------------------------------------------------

def patterns(lengths: np.ndarray, window: int) -> np.ndarray:
    """All rows (a >= b >= c) of given lengths with a + b + c = window; 0 stands for no document."""
    held = np.zeros(window + 1, bool)
    held[lengths] = True
    held[0] = True
    rows = []
    for a in lengths[lengths * 3 >= window]:
        rest = window - int(a)
        b = np.arange((rest + 1) // 2, min(int(a), rest) + 1)
        c = rest - b
        keep = held[b] & held[c]
        rows.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def nonnegative_fit(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that bring the sum of squares of (lengths used - histogram) to its minimum.

    An active-set method: patterns with the steepest descent enter, as many at once as share no length; the least squares of
    those inside are solved, and patterns that would turn negative leave.
    """
    size, target = len(histogram), histogram.astype(float)
    target[0] = 0.0  # the place of "no document"
    x = np.zeros(len(rows))
    inside = np.zeros(0, np.int64)

    def used(which, times):
        total = np.zeros(size)
        for k in range(3):
            total += np.bincount(rows[which, k], weights=times, minlength=size)
        total[0] = 0.0
        return total

    def least_squares(which, times):
        """Conjugate gradients on the normal equations, from ``times`` on."""
        part = rows[which]
        cells = part.ravel()

        def apply(t):
            total = np.bincount(cells, weights=np.repeat(t, 3), minlength=size)
            total[0] = 0.0
            return total[part].sum(1)

        r = target[part].sum(1) - apply(times)
        d, power = r.copy(), float(r @ r)
        stop = 1e-10 * max(power, 1e-30)
        for _ in range(200):
            if power <= stop:
                break
            step = apply(d)
            a = power / float(d @ step)
            times = times + a * d
            r = r - a * step
            power, before = float(r @ r), power
            d = r + power / before * d
        return times

    tolerance = 1e-6 * max(1.0, target.max(initial=0.0))
    best, best_x, stale = np.inf, x.copy(), 0
    for _ in range(rounds):
        residual = target - used(inside, x[inside])
        loss = float(residual @ residual)
        if loss < best * (1 - 1e-4):
            best, best_x, stale = loss, x.copy(), 0
        else:
            stale += 1
        slope = residual[rows[:, 0]] + residual[rows[:, 1]] + residual[rows[:, 2]] if len(rows) else np.zeros(0)
        slope[inside] = 0.0
        steep = np.flatnonzero(slope > tolerance)
        if not len(steep) or stale > 4:
            break
        if len(steep) > 4 * size:
            steep = steep[np.argpartition(-slope[steep], 4 * size)[: 4 * size]]
        steep = steep[np.argsort(-slope[steep], kind="stable")]
        taken, enter = set(), []
        for p in steep:
            parts = {int(v) for v in rows[p] if v}
            if not parts & taken:
                taken |= parts
                enter.append(p)
        # Half of what could enter at first, one alone when rounds stop helping: entering many at once may undo each other.
        enter = enter[: 1 if stale > 2 else max(1, len(enter) // (1 + stale))]
        inside = np.concatenate([inside, np.array(enter, np.int64)])
        times = least_squares(inside, x[inside])
        for _ in range(20):
            if (times > 0).all():
                break
            inside, times = inside[times > 0], times[times > 0]
            times = least_squares(inside, times)
        inside, times = inside[times > 0], times[times > 0]
        x[:] = 0.0
        x[inside] = times
    return best_x


def packing_plan(histogram: dict[int, int], window: int = WINDOW) -> pd.DataFrame:
    """Runs (length, first, count, each, sequence, offset) that place ``histogram[length]`` pieces of every length.

    Ranks first..first+count-1 of a length go to sequences ``sequence``, ``sequence + 1``, ... with ``each`` pieces in each,
    side by side from ``offset`` on.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    rank, runs, sequence = np.zeros(window + 1, np.int64), [], 0

    def place(length, count, each, at, offset):
        runs.append((length, int(rank[length]), count, each, at, offset))
        rank[length] += count
        left[length] -= count

    rows = patterns(np.flatnonzero(left), window)
    x = nonnegative_fit(rows, left.copy())
    for p in np.argsort(-x, kind="stable"):
        repeats = int(np.floor(x[p] + 0.5))
        if repeats <= 0:
            break
        lengths, counts = np.unique(rows[p][rows[p] > 0], return_counts=True)
        repeats = int(min(repeats, (left[lengths] // counts).min()))
        if repeats <= 0:
            continue
        offset = 0
        for length, each in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
            place(length, repeats * each, each, sequence, offset)
            offset += length * each
        sequence += repeats

    # The rest: groups of equal sequences by the room they have left.
    groups: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        room = length
        while left[length]:
            while room <= window and not groups[room]:
                room += 1
            if room > window:
                each = min(window // length, int(left[length]))
                at, many, room_now = sequence, int(left[length]) // each, window
                sequence += many
            else:
                (at, many), room_now = groups[room].pop(), room
                each = min(room // length, int(left[length]))
                if (fits := int(left[length]) // each) < many:
                    groups[room].append((at + fits, many - fits))
                    many = fits
            place(length, many * each, each, at, window - room_now)
            groups[room_now - each * length].append((at, many))
            room = length
    return pd.DataFrame(runs, columns=["length", "first", "count", "each", "sequence", "offset"], dtype=np.int64)


# --- the job -------------------------------------------------------------------------------------------------------

def _ranks_of(lengths: np.ndarray) -> np.ndarray:
    """Number of each entry among equal entries before it."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
    out = np.empty(len(ordered), np.int64)
    out[order] = np.arange(len(ordered)) - start
    return out


def _pieces(path, window, end_id, keep_ids):
    def run(frames):
        import public_tokenizers

        enc = word_encoder(path or public_tokenizers.path("word_bpe_49k.json"))
        seen = np.zeros(window + 1, np.int64)  # pieces of each length so far in this block
        block, filled = TaskContext.get().partitionId() << 32, 0
        end = np.array([end_id], "<u2").tobytes()
        for f in text_chunks(frames, CHUNK):
            out: dict[str, list] = {c: [] for c in ("_id", "piece", "start", "length", "crc", "ids")}
            for doc, raw in zip(f["_id"], enc.encode(f["_text"].tolist())):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 2 * window)):
                    part = raw[at:at + 2 * window]
                    wide = np.frombuffer(part, "<u2").astype("<u4")
                    out["_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(at // 2)
                    out["length"].append(len(part) // 2)
                    out["crc"].append(zlib.crc32(wide))
                    if keep_ids:
                        out["ids"].append(part)
            if not keep_ids:
                del out["ids"]
            whole = pd.DataFrame(out)
            for at in range(0, len(whole), BLOCK):
                part = whole.iloc[at:at + BLOCK].copy()
                if filled + len(part) > BLOCK:
                    block, filled, seen = block + 1, 0, np.zeros(window + 1, np.int64)
                lengths = part["length"].to_numpy()
                part["block"], part["rank"] = block, seen[lengths] + _ranks_of(lengths)
                seen += np.bincount(lengths, minlength=window + 1)
                filled += len(part)
                yield part
    return run


def _place(shared, window):
    def run(frames):
        plan = shared.value
        key = plan[:, 0] * (1 << 48) + plan[:, 1]  # by length, then first rank
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            row = plan[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            within = rank - row[:, 1]
            f["sequence_id"] = row[:, 4] + within // row[:, 3]
            f["offset"] = row[:, 5] + within % row[:, 3] * length
            yield f.drop(columns="rank")
    return run


def pattern_pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
    vocabulary: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one for each piece of a document.

    ``ids`` (with ``keep_ids``) holds a piece's token ids as little-endian 16-bit numbers.
    """
    spark, id_type = docs.sparkSession, dict(docs.dtypes)[id_col]
    ids = ", ids binary" if keep_ids else ""
    stored = Scratch(spark, "pattern_packing").write(
        docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInPandas(
            _pieces(vocabulary, window, end_id, keep_ids),
            f"_id string, piece int, start long, length long, crc long{ids}, block long, rank long"), "pieces")
    counts = stored.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = packing_plan(histogram, window).sort_values(["length", "first"]).to_numpy()
    before = counts.select(
        F.col("block").alias("_block"), F.col("length").alias("_length"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = stored.join(before, (F.col("block") == F.col("_block")) & (F.col("length") == F.col("_length")))
    columns = ["_id", "piece", "start", "length", "crc", *(["ids"] if keep_ids else [])]
    placed = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank")).mapInPandas(
        _place(spark.sparkContext.broadcast(plan), window),
        f"_id string, piece int, start long, length long, crc long{ids}, sequence_id long, offset long")
    return placed.select(
        F.col("_id").cast(id_type).alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id",
        "offset", *(["ids"] if keep_ids else []))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as the fitted patterns give."""
    return pattern_pack(table(spark, sf_dir, "documents"))
