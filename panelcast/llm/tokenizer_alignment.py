"""Alignment of two tokenizers' tokens over the same bytes, in lockstep over all documents of a batch.

Both tokenizers cut the bytes of a document into spans. One NumPy state vector holds for every document the pointers to its
current A and B token. A step compares all current ends at once, emits the link (A token, B token) of every document, notes a
cut where both tokens end together, and moves the pointer of the token that ends first (both at a cut); documents that are
through leave the vector. A long document takes several places of the vector, each starting at an end of every ``LANE``-th
A token, where the B pointer is found by binary search; so the number of steps is bounded whatever the longest document is.

Links give pairs of ids. A pair's count is the number of documents that hold it linked. Documents are worked in blocks of
about ``CHUNK`` characters; a block emits its distinct pairs with their numbers of documents, which are summed over the corpus.
The counts come back by block, not by document: the block's pairs are joined with the counts (a frequent pair comes once a
block), and meet the block's documents, whose links are stored as numbers of the block's pairs.

Scale: one pass over the texts. Shuffled are distinct pairs of blocks, twice, and each document's distinct pairs, once. A pair
table has at most (A ids) x (B ids) rows; no group is larger than a block or the B ids seen with one A id. Memory follows the
block or the longest document.

Defined results: a text that is NULL or empty, or whose tokens of either tokenizer do not give back its bytes, has no tokens:
all figures 0 and an empty digest. Repeated rows count as documents of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.bpe import Encoder, public_files
from panelcast.llm.common import Scratch, table, text_chunks

LANE, CHUNK = 256, 1 << 21


# --- lockstep merging ----------------------------------------------------------------------------------------------

def lockstep(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray, lane: int = LANE):
    """Links and cuts of all documents: (A token, B token, is the end of a group), in order of the bytes.

    ``ends_*`` are byte ends of the tokens of all documents, each document after the other on one line of bytes; ``first_*``
    give each document's first token, and one more at the end. Both sides of a document end at the same byte.
    """
    n_a = np.diff(first_a)
    lanes_of = -(-n_a // lane)
    doc = np.repeat(np.arange(len(n_a)), lanes_of)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    a = first_a[doc] + within * lane
    last_a = np.minimum(a + lane, first_a[doc + 1])  # the place is through when its A tokens are
    begin = np.where(within > 0, ends_a[a - 1], -1)
    b = np.where(within > 0, np.searchsorted(ends_b, begin, side="right"), first_b[doc])
    place = np.arange(len(doc))
    links_a, links_b, cuts, places = [], [], [], []
    end_a, end_b = ends_a[a], ends_b[b]
    while len(a):
        cut = end_a == end_b
        links_a.append(a)
        links_b.append(b)
        cuts.append(cut)
        places.append(place)
        step_a, step_b = end_a <= end_b, end_b <= end_a
        a, b = a + step_a, b + step_b
        on = a < last_a
        if not on.all():
            a, b, last_a, place = a[on], b[on], last_a[on], place[on]
        end_a, end_b = ends_a[a], ends_b[np.minimum(b, len(ends_b) - 1)]
    if not links_a:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    order = np.argsort(np.concatenate(places), kind="stable")  # steps are in order already
    return np.concatenate(links_a)[order], np.concatenate(links_b)[order], np.concatenate(cuts)[order]


# --- token bytes ---------------------------------------------------------------------------------------------------

def _byte_of_character() -> dict[str, int]:
    """Bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabularies:
    """Both tokenizers, with the bytes of every id: a joined buffer, starts and lengths."""

    def __init__(self, a_files: tuple, b_file: str):
        import sentencepiece

        self.a = Encoder(*a_files)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte_of = _byte_of_character()
        vocab = self.a.full.get_vocab()
        raw_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            raw_a[i] = bytes(byte_of[c] for c in token)
        raw_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            raw_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.sides = [self._table(raw) for raw in (raw_a, raw_b)]
        # Ids as text behind each separator, padded with zero bytes to one width.
        most = max(len(raw_a), len(raw_b))
        width = len(str(most)) + 1
        digits = np.array([str(i).encode() for i in range(most)], f"S{width - 1}").view(np.uint8).reshape(most, -1)
        self.shown = np.zeros((4, most, width), np.uint8)
        for k, mark in enumerate(b"\0,|;"):
            self.shown[k, :, 0], self.shown[k, :, 1:] = mark, digits
        self.b_size = len(raw_b)

    @staticmethod
    def _table(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(r) for r in raw], np.int64)
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size

    def spell(self, side: int, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Joined bytes of tokens, and each token's end."""
        buf, start, size = self.sides[side]
        n = size[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b"", ends
        at = np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1])
        return buf[at].tobytes(), ends


@lru_cache(maxsize=1)
def vocabularies(a_files: tuple, b_file: str) -> Vocabularies:
    """Once for each worker process."""
    return Vocabularies(a_files, b_file)


def _default_files() -> tuple[tuple, str]:
    import public_tokenizers

    return tuple(public_files().values()), public_tokenizers.path("piece_bpe_32k.model")


def group_digests(voc, ids_a, first_a, ids_b, first_b, link_a, link_b, cut) -> tuple[np.ndarray, list[str]]:
    """Number of groups and digest of each document's groups, written as ``a1,a2|b1;a3|b2,b3``."""
    # Groups by A token and by B token: cuts before it. A cut's link holds the last token of its group on both sides.
    end_a, end_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    end_a[link_a[cut]] = 1
    end_b[link_b[cut]] = 1
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    groups = int(end_a.sum())
    a_before = np.searchsorted(group_a, np.arange(groups + 1))  # A tokens before each group
    b_before = np.searchsorted(group_b, np.arange(groups + 1))
    at_a = np.arange(len(ids_a)) + b_before[group_a]
    at_b = np.arange(len(ids_b)) + a_before[group_b + 1]
    opens_a = np.concatenate(([True], end_a[:-1] == 1))[: len(ids_a)]
    opens_b = np.concatenate(([True], end_b[:-1] == 1))[: len(ids_b)]
    mark_a = np.where(opens_a, 3, 1)
    full = np.diff(first_a) > 0
    mark_a[first_a[:-1][full]] = 0  # nothing before a document's first token
    rows = np.empty((len(ids_a) + len(ids_b), voc.shown.shape[2]), np.uint8)
    rows[at_a] = voc.shown[mark_a, ids_a]
    rows[at_b] = voc.shown[np.where(opens_b, 2, 1), ids_b]
    first = first_a + first_b
    digests = []
    for i, to in zip(first[:-1], first[1:]):
        part = rows[i:to].ravel()
        digests.append(hashlib.sha256(part[part != 0].tobytes()).hexdigest() if to > i else "")
    held = np.cumsum(np.concatenate(([0], end_a)))
    return held[first_a[1:]] - held[first_a[:-1]], digests


# --- the job -------------------------------------------------------------------------------------------------------

_LINKS = ("block long, _id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "codes binary, times binary, pairs binary, docs binary")


def encoded_batch(voc: Vocabularies, texts: list) -> tuple[np.ndarray, ...]:
    """Ids, ends on one line of bytes, and first tokens of both sides; texts that do not come back have no tokens."""
    texts = [t or "" for t in texts]
    pieces = voc.b.encode(texts, num_threads=1)
    parts: tuple[list, list] = ([], [])
    ends: tuple[list, list] = ([], [])
    at = 0
    none = np.zeros(0, np.int64)
    for text, b in zip(texts, pieces):
        ids = [none, none]
        if text:
            whole = " " + text
            raw = whole.encode()
            pair = [voc.a.encode(whole).astype(np.int64), np.array(b, np.int64)]
            spelt = [voc.spell(side, pair[side]) for side in (0, 1)]
            if spelt[0][0] == raw == spelt[1][0]:
                ids = pair
                for side in (0, 1):
                    ends[side].append(spelt[side][1] + at)
                at += len(raw)
        for side in (0, 1):
            parts[side].append(ids[side])
    out = []
    for side in (0, 1):
        out += [np.concatenate([none, *parts[side]]), np.concatenate([none, *ends[side]]),
                np.concatenate(([0], np.cumsum([len(p) for p in parts[side]]))).astype(np.int64)]
    return tuple(out)


def _align(files):
    def run(frames):
        voc = vocabularies(*(files or _default_files()))
        block = TaskContext.get().partitionId() << 32
        for f in text_chunks(frames, CHUNK):
            ids_a, ends_a, first_a, ids_b, ends_b, first_b = encoded_batch(voc, f["_text"].tolist())
            link_a, link_b, cut = lockstep(ends_a, first_a, ends_b, first_b)
            n_groups, digests = group_digests(voc, ids_a, first_a, ids_b, first_b, link_a, link_b, cut)
            pairs, code = np.unique(ids_a[link_a] * voc.b_size + ids_b[link_b], return_inverse=True)
            first = np.searchsorted(link_a, first_a)  # links are in order of their A tokens
            doc = np.repeat(np.arange(len(f)), np.diff(first))
            held, times = np.unique(doc * (len(pairs) + 1) + code, return_counts=True)
            doc, code = np.divmod(held, len(pairs) + 1)
            docs = np.bincount(code, minlength=len(pairs))
            cuts = np.searchsorted(doc, np.arange(len(f) + 1))
            code, times = code.astype("<u4"), times.astype("<u4")
            yield pd.DataFrame({
                "block": block, "_id": f["_id"], "n_a": np.diff(first_a), "n_b": np.diff(first_b), "n_groups": n_groups,
                "n_links": np.diff(first), "groups_sha256": digests,
                "codes": [code[i:to].tobytes() for i, to in zip(cuts[:-1], cuts[1:])],
                "times": [times[i:to].tobytes() for i, to in zip(cuts[:-1], cuts[1:])], "pairs": None, "docs": None})
            if len(pairs):
                yield pd.DataFrame({
                    "block": [block], "_id": None, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": None,
                    "codes": None, "times": None, "pairs": [pairs.astype("<u8").tobytes()],
                    "docs": [docs.astype("<u4").tobytes()]})
            block += 1
    return run


def _unfold(b_size):
    """Rows (block, code, a, b, docs) of the blocks' distinct pairs."""
    def run(frames):
        for f in frames:
            for block, raw, docs in zip(f["block"], f["pairs"], f["docs"]):
                a, b = np.divmod(np.frombuffer(raw, "<u8").astype(np.int64), b_size)
                yield pd.DataFrame({"block": block, "code": np.arange(len(a), dtype=np.int32), "a": a.astype(np.int32),
                                    "b": b.astype(np.int32), "docs": np.frombuffer(docs, "<u4").astype(np.int64)})
    return run


def _settle(links: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Figures of a block's documents from the counts of its pairs."""
    counts = counts.sort_values("code")
    count, best = counts["count"].to_numpy(np.int64), counts["best"].to_numpy(bool)
    total, top = [], []
    for codes, times in zip(links["codes"], links["times"]):
        code, n = np.frombuffer(codes, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        total.append(int((count[code] * n).sum()))
        top.append(int(n[best[code]].sum()))
    return links.drop(columns=["block", "codes", "times"]).assign(n_best=top, count_sum=total)


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): a row of figures for each document, and every linked pair of ids with its number of documents.

    Pairs have (a, b, count, best); ``best`` marks the highest count of an A id, ties included.
    """
    import sentencepiece

    spark, id_type = docs.sparkSession, dict(docs.dtypes)[id_col]
    b_size = sentencepiece.SentencePieceProcessor(model_file=(files or _default_files())[1]).get_piece_size()
    scratch = Scratch(spark, "alignment")
    stored = scratch.write(
        docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInPandas(_align(files), _LINKS),
        "links")
    blocks = stored.where("pairs is not null").select("block", "pairs", "docs").mapInPandas(
        _unfold(b_size), "block long, code int, a int, b int, docs long")
    by_a = Window.partitionBy("a")
    pairs = scratch.write(
        blocks.groupBy("a", "b").agg(F.sum("docs").alias("count"))
        .withColumn("best", F.col("count") == F.max("count").over(by_a)), "pairs")
    known = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "count", "best")
    counts = blocks.join(known, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("block", "code", "count", "best")
    figures = stored.where("pairs is null").drop("pairs", "docs").groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(
        _settle, "_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return figures.withColumn("_id", F.col("_id").cast(id_type)).withColumnRenamed("_id", id_col), pairs


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus-wide pair counts of two public tokenizers over all documents."""
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]
