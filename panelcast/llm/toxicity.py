"""Toxicity through a noisy channel: disguised words are restored by Viterbi decoding, then the restored text is scored.

Restoring. A word that mixes letters with signs, or stretches a letter three times or more, and a row of single letters set
apart by spaces, is a lattice: a sign may stand for itself (a gap between words, or a digit), for a letter (leetspeak), or
for nothing (spacing; not for digits); a stretched letter may stand for one or two. The best path under a character trigram model and the channel's
costs is the restored text. The trigram counts cover the words of all documents; the alphabet is fixed, so they have one
size at any size of corpus.

Scoring. Features are the restored words and their beginnings of three to six letters. Each has the lower confidence bound
(Wilson) of the share of toxic documents among the distinct labelled texts that hold it. A text's evidence is the highest bound
among its words. The cut with the best F1 over the labelled texts, each judged without its own label, becomes score 0.5;
scores are linear in the evidence on both sides of it. Labels are learned from at most ``MAX_LABELS`` rows, those with the smallest hash of the id.

Scale: scoring is one narrow pass with a broadcast model; the model is bounded by the labelled sample.

Defined results: a NULL or empty text has no evidence and scores 0. Rows with equal texts score
the same. Without labels every score is 0. NULL labels and NULL ids teach nothing; of repeated labels the larger counts.
Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelcast.llm.common import TEXT_ROWS, Scratch, arrow_rows, crc_fold, table, text_chunks

MAX_LABELS, LEAST_TOXIC, Z = 20_000, 3, 2.0
PREFIXES = (3, 4, 5, 6)
CACHE, FEATURE_CACHE = 400_000, 100_000

# Letters that signs commonly stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "#": "h", "*": "aeiou",
}
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
GAP, DIGIT, OTHER = 0, len(LETTERS) + 1, len(LETTERS) + 2
SYMBOLS = OTHER + 1
LITERAL, SWAP, DROP, STRETCH = math.log(0.9), math.log(0.08), math.log(0.08), math.log(0.4)
SPELLED = math.log(0.9), math.log(0.02)  # nothing and gap, in a word whose letters are all set apart
BEAM = 48

_code = {c: i + 1 for i, c in enumerate(LETTERS)}
_table = np.zeros(0x250, np.int64)
for _i in range(0x250):
    _c = chr(_i).lower()
    _table[_i] = _code.get(_c, DIGIT if _c.isdigit() else OTHER if _c.isalpha() else GAP)
_NOISY = re.compile(r"(.)\1\1|[^\W\d_][\W\d_]+[^\W\d_]|^[\W\d_]+[^\W\d_]{2}|[^\W\d_]{2}[\W\d_]+$", re.S)
_THRICE = re.compile(r"(.)\1\1", re.S)
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?!\S)")
_SPELLED = re.compile(r"(?:[^\W\d_][\W_])+[^\W\d_]")
_EDGE = ".,;:?\"'()[]{}…«»“”‘’"


def trigram_cells(texts) -> np.ndarray:
    """Counts of symbol trigrams over the words of texts, gaps included."""
    joined = "\n".join(t for t in texts if t)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    s = np.where(points < 0x250, _table[np.minimum(points, 0x24F)], OTHER)
    s = np.concatenate(([GAP, GAP], s, [GAP]))
    # Runs of gaps are one gap.
    s = s[np.concatenate(([True], (s[1:] != GAP) | (s[:-1] != GAP)))]
    s = np.concatenate(([GAP], s))
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


class Decoder:
    """Viterbi search over a word's lattice. States are the last two symbols."""

    def __init__(self, cells: np.ndarray):
        c3 = cells.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
        p3 = (c3 + 10 * p2) / (c3.sum(2, keepdims=True) + 10)
        self.log_p = np.log(p3).tolist()

    def lattice(self, word: str) -> list[list[tuple[int, tuple[str, ...], float]]]:
        """For each position: (next position, symbols, cost)."""
        out: list[list[tuple[int, tuple[str, ...], float]]] = []
        drop, gap = SPELLED if _SPELLED.fullmatch(word) else (DROP, LITERAL)
        at = 0
        while at < len(word):
            c, run = word[at], 1
            while at + run < len(word) and word[at + run] == c:
                run += 1
            if c.isalpha():
                if run >= 3:
                    out.append([(at + run, (c,), STRETCH), (at + run, (c, c), STRETCH)])
                    out += [[] for _ in range(run - 1)]
                else:
                    out += [[(at + k + 1, (c,), 0.0)] for k in range(run)]
            else:
                for k in range(run):
                    edges = [(at + k + 1, (c,), LITERAL)] if c.isdigit() else [(at + k + 1, (" ",), gap), (at + k + 1, (), drop)]
                    edges += [(at + k + 1, (x,), SWAP - math.log(len(LEET[c]))) for x in LEET.get(c, "")]
                    out.append(edges)
            at += run
        return out

    def decode(self, word: str) -> str:
        edges, log_p = self.lattice(word), self.log_p
        layers: list[dict] = [{} for _ in range(len(edges) + 1)]
        layers[0] = {(GAP, GAP): (0.0, None)}  # a path is (path before, letter): long words are not copied at every step
        for at, options in enumerate(edges):
            states = layers[at]
            if not states:
                continue
            if len(states) > BEAM:
                states = dict(sorted(states.items(), key=lambda kv: -kv[1][0])[:BEAM])
            for to, symbols, cost in options:
                target = layers[to]
                for (a, b), (score, path) in states.items():
                    s, x, y, done = score + cost, a, b, path
                    for c in symbols:
                        k = GAP if c == " " else _code.get(c) or (DIGIT if c.isdigit() else OTHER)
                        if k == GAP and y == GAP:
                            continue
                        s += log_p[x][y][k]
                        x, y, done = y, k, (done, c)
                    held = target.get((x, y))
                    if held is None or s > held[0]:
                        target[(x, y)] = (s, done)
            layers[at] = {}
        best = max(layers[-1].items(), key=lambda kv: kv[1][0] + (0 if kv[0][1] == GAP else log_p[kv[0][0]][kv[0][1]][GAP]))
        path, letters = best[1][1], []
        while path is not None:
            path, c = path
            letters.append(c)
        return "".join(reversed(letters))

    def restored(self, word: str) -> list[str]:
        """Words that a lower-cased run of non-space characters stands for."""
        bare = word.strip(_EDGE)
        if not bare or not (_THRICE if bare.isalpha() else _NOISY).search(bare):
            return [bare] if bare else []
        return [w for w in self.decode(bare).split(" ") if w]


def restore_text(decoder: Decoder, text: str) -> str:
    """A whole text with disguised words restored; single letters set apart by spaces are read as one lattice."""
    text = _SPACED.sub(lambda m: "-".join(m[0].split()), text.lower())
    return " ".join(w for x in text.split() for w in decoder.restored(x))


def features(word: str) -> list[str]:
    return ["=" + word] + [word[:k] for k in PREFIXES if len(word) >= k]


def distinct_words(text: str) -> set[str]:
    """Lower-cased words of a text, and its rows of single letters, each joined by hyphens."""
    text = text.lower()
    found = set(text.split())
    for m in _SPACED.finditer(text):
        found.add("-".join(m[0].split()))
    return found


class Words:
    """What ``value`` gives for the restored words of a word, with a cache of the words met before."""

    def __init__(self, decoder: Decoder, value, room: int = CACHE):
        self.decoder, self.value, self.room, self.cache = decoder, value, room, {}

    def look_up(self, word: str):
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= self.room:
                self.cache.clear()
            got = self.value(self.decoder.restored(word))
            if len(word) < 200:
                self.cache[word] = got
        return got


def _count_trigrams(frames):
    total = np.zeros(SYMBOLS**3, np.int64)
    for f in text_chunks(frames, 4 << 20):
        total += trigram_cells(f["_text"].tolist())
    at = np.flatnonzero(total)
    yield pd.DataFrame({"cell": at, "n": total[at]})


def _count_features(cells):
    def run(frames):
        words = Words(Decoder(cells.value), lambda restored: tuple({x for r in restored for x in features(r)}), FEATURE_CACHE)
        for f in frames:
            held, taught = Counter(), Counter()
            for text, toxic in zip(f["_text"], f["toxic"]):
                mine = set().union(*map(words.look_up, distinct_words(text)))
                held.update(mine)
                if toxic:
                    taught.update(mine)
            yield pd.DataFrame([(k, d, taught[k]) for k, d in held.items()], columns=["feature", "d", "t"])
    return run


def lower_bound(t: float, d: float, z: float = Z) -> float:
    p = t / d
    return (p + z * z / (2 * d) - z * math.sqrt(p * (1 - p) / d + z * z / (4 * d * d))) / (1 + z * z / d)


def _left_out(cells, counts):
    """Evidence of the labelled texts without their own label, in thousandths."""
    def run(frames):
        table = counts.value
        words = Words(
            Decoder(cells.value), lambda restored: tuple({x for r in restored for x in features(r) if x in table}), FEATURE_CACHE)
        for f in frames:
            evidence = []
            for text, toxic in zip(f["_text"], f["toxic"]):
                mine = set().union(*map(words.look_up, distinct_words(text)))
                evidence.append(max((
                    lower_bound(table[x][0] - toxic, table[x][1] - 1) for x in mine if table[x][1] > 1), default=0.0))
            yield pd.DataFrame({"e": np.floor(np.array(evidence) * 1000).astype(int), "toxic": f["toxic"]})
    return run


def best_cut(rows: list[tuple[int, int, int]]) -> float:
    """Cut with the best F1 from (evidence in thousandths, toxic texts, other texts); the middle of its free range."""
    rows = sorted(rows, reverse=True)
    total = sum(t for _, t, _ in rows)
    best, cut, hit, wrong = 0.0, 0.5, 0, 0
    for i, (e, t, c) in enumerate(rows):
        hit, wrong = hit + t, wrong + c
        f1 = 2 * hit / max(1, hit + wrong + total)
        if f1 > best:
            below = rows[i + 1][0] + 1 if i + 1 < len(rows) else 0
            best, cut = f1, max(0.001, (e + below) / 2000)
    return cut


_worker: list = []  # the last model used by this worker process and its words, kept from task to task


def _known_words(cells, bounds) -> Words:
    table = bounds.value
    if not _worker or _worker[0] is not table:
        _worker[:] = [table, Words(Decoder(cells.value), lambda restored: max(
            (table.get(x, 0.0) for r in restored for x in features(r)), default=0.0))]
    return _worker[1]


def _evidence(cells, bounds, cut: float):
    words = _known_words(cells, bounds)

    def score(text: str) -> float:
        e = max(map(words.look_up, distinct_words(text)), default=0.0)
        return 0.5 * e / cut if e < cut else 0.5 + 0.5 * (e - cut) / max(1 - cut, 1e-9)
    return score


def _score(cells, bounds, cut, column: str, keep: bool):
    def run(batches):
        score = _evidence(cells, bounds, cut)
        for batch in batches:  # Arrow, so that the other columns pass through unchanged
            for at in range(0, batch.num_rows, TEXT_ROWS):  # few texts at once are Python strings
                part = pa.Table.from_batches([batch.slice(at, TEXT_ROWS)])
                scores = pa.array([score(t or "") for t in part[column].to_pylist()], pa.float64())
                yield from (part if keep else part.drop_columns(column)).append_column("score", scores).to_batches()
            batch = part = scores = None
            pa.default_memory_pool().release_unused()  # workers live on: what Arrow keeps would add to the next steps' memory
    return run


class Model:
    """A fitted model: broadcast trigram counts and feature bounds."""

    def __init__(self, cells, bounds, cut: float):
        self.cells, self.bounds, self.cut = cells, bounds, cut

    def scores(self, frame: DataFrame, column: str = "_text", keep: bool = False) -> DataFrame:
        """``frame`` has texts in ``column``, which becomes ``score`` or, with ``keep``, stays beside it; other columns stay."""
        fields = [f for f in frame.schema if keep or f.name != column]
        return frame.mapInArrow(
            _score(self.cells, self.bounds, self.cut, column, keep), StructType([*fields, StructField("score", DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> Model:
    """``labels`` has (id, toxic) of the rows that may teach."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    cells = np.zeros(SYMBOLS**3, np.int64)
    counted = docs.select(text.alias("_text")).mapInPandas(_count_trigrams, "cell long, n long")
    with arrow_rows(spark, TEXT_ROWS):
        rows = counted.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most SYMBOLS ** 3 rows
    for r in rows:
        cells[r["cell"]] = r["n"]
    shared = spark.sparkContext.broadcast(cells)
    known = (
        labels.where("toxic IS NOT NULL AND _id IS NOT NULL").groupBy("_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_labels))
    sample = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(known), "_id")  # max_labels rows
    distinct = Scratch(spark, "toxicity").write(
        sample.groupBy(F.xxhash64("_text").alias("key")).agg(F.max("_text").alias("_text"), F.max("toxic").alias("toxic"))
        .select("_text", "toxic"), "labelled")
    totals = distinct.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = totals[1] / totals[0] if totals[0] else 0.0
    counts = distinct.select("_text", "toxic").mapInPandas(_count_features(shared), "feature string, d long, t long").groupBy(
        "feature").agg(F.sum("d").alias("d"), F.sum("t").alias("t")).where(F.col("t") >= LEAST_TOXIC)
    # Only features above the average share matter; their number is bounded by the labelled sample.
    with arrow_rows(spark, TEXT_ROWS):
        held = {r["feature"]: (r["t"], r["d"]) for r in counts.where(F.col("t") > F.col("d") * share).collect()}
    judged = distinct.mapInPandas(_left_out(shared, spark.sparkContext.broadcast(held)), "e int, toxic int")
    with arrow_rows(spark, TEXT_ROWS):
        rows = judged.groupBy("e").agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).collect()  # at most 1001 rows
    bounds = {x: lower_bound(t, d) for x, (t, d) in held.items()}
    return Model(shared, spark.sparkContext.broadcast(bounds), best_cut([tuple(r) for r in rows]))


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that may teach: a fifth of the ids is held out."""
    return labels.where(crc_fold(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("_id"), "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = model.scores(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")))
    return scored.select(
        "doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic."""
    model = fit(docs, training_labels(labels))
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    scored = model.scores(docs.select(*columns), f"c{docs.columns.index('text')}", keep=True)  # a text travels once
    return scored.where("score < 0.5").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
