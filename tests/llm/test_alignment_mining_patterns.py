"""Tokenizer alignment, hard negatives and pattern packing against plain Python."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import hard_negatives as hn
from panelcast.llm import pattern_packing as pp
from panelcast.llm import tokenizer_alignment as ta
from tests.llm.test_operators import SCHEMA, docs, none, rows  # noqa: F401

public_tokenizers = pytest.importorskip("public_tokenizers")


# --- alignment -----------------------------------------------------------------------------------------------------

MORE = ["a<|endoftext|>b <s> </s>", "under▁score", "tabs\tand  spaces\n\n", "İstanbul naïve ﬁ", "日本語の文", "x" * 3000, " lead", " nbsp  "]


def plain_tokens(texts):
    """Per text: [(id, begin, end)] of both sides, or two empty lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = ta._byte_of_character()
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        whole = (" " + text).encode()
        sides = []
        for tokens in (
            [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
            [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
             for i in b.encode(text)],
        ):
            at, spans = 0, []
            for i, raw in tokens:
                spans.append((i, at, at + len(raw)))
                at += len(raw)
            sides.append((b"".join(raw for _, raw in tokens), spans))
        ok = sides[0][0] == whole == sides[1][0]
        out.append((sides[0][1], sides[1][1]) if ok else ([], []))
    return out


def plain_alignment(texts):
    found, pair_docs = [], collections.Counter()
    for a, b in plain_tokens(texts):
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = i, j
            while i < len(a) and a[i][2] <= c:
                i += 1
            while j < len(b) and b[j][2] <= c:
                j += 1
            groups.append(",".join(str(t[0]) for t in a[x:i]) + "|" + ",".join(str(t[0]) for t in b[y:j]))
        links = [(s[0], t[0]) for s in a for t in b if s[1] < t[2] and t[1] < s[2]] if len(a) < 1200 else None
        if links is None:  # the same by two pointers, where all pairs are too many
            links, j = [], 0
            for s in a:
                while b[j][2] <= s[1]:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < s[2]:
                    links.append((s[0], b[k][0]))
                    k += 1
        pair_docs.update(set(links))
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = collections.defaultdict(int)
    for (x, _), n in pair_docs.items():
        top[x] = max(top[x], n)
    return [(na, nb, ng, len(links), sum(pair_docs[p] == top[p[0]] for p in links), sum(pair_docs[p] for p in links), sha)
            for na, nb, ng, links, sha in found]


def test_alignment(spark, docs):  # noqa: F811
    whole = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(900 + i, t) for i, t in enumerate(MORE)], "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in whole.collect()]
    want = sorted(zip(map(str, [t[0] for t in texts]), plain_alignment([t[1] for t in texts])))
    figures, pairs = ta.align_tokenizers(whole)
    got = sorted((str(r.doc_id), (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in figures.collect())
    assert got == want
    assert pairs.groupBy("a").agg(F.max(F.col("best").cast("int")).alias("m")).where("m = 0").isEmpty()
    assert figures.schema["doc_id"].dataType.simpleString() == "bigint"


def test_alignment_of_nothing(spark, none):  # noqa: F811
    figures, pairs = ta.align_tokenizers(none)
    assert figures.count() == 0 and pairs.count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in ta.align_tokenizers(empty)[0].collect()] == [(0, 0, 0, 0, "", 0, 0)] * 2


@pytest.mark.parametrize("lane", [1, 2, 7, 1000])
def test_lockstep_places(lane):
    """Any number of places for a document gives the same links and cuts."""
    rng = np.random.default_rng(lane)
    ends_a, ends_b, first_a, first_b, want, at = [], [], [0], [0], [], 0
    for size in (1, 40, 0, 300, 5):
        inner = [np.sort(rng.choice(np.arange(1, size), size=int(size * s), replace=False)) if size > 1 else np.zeros(0, int) for s in (0.5, 0.6)]
        a, b = (np.append(x, size) if size else x for x in inner)
        for i, (s, e) in enumerate(zip(np.append(0, a[:-1]), a)) if size else ():
            for j, (u, v) in enumerate(zip(np.append(0, b[:-1]), b)):
                if s < v and u < e:
                    want.append((len(ends_a) + i, len(ends_b) + j, e == v))
        ends_a += list(a + at) if size else []
        ends_b += list(b + at) if size else []
        at += size
        first_a.append(len(ends_a))
        first_b.append(len(ends_b))
    got = ta.lockstep(*(np.array(x) for x in (ends_a, first_a, ends_b, first_b)), lane)
    assert list(zip(*(x.tolist() for x in got))) == want


# --- hard negatives ------------------------------------------------------------------------------------------------

def plain_negatives(table, every, positives=5, negatives=10):
    """``table`` has (id, label, vector) rows; the order of rows breaks last ties, so results are compared without row numbers."""
    held = [(i, lab, np.floor(256 * np.array(v, float)).astype(int)) for i, lab, v in table
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for *_, v in held), default=0)
    held = [(i, lab, np.pad(v, (0, dims - len(v)))) for i, lab, v in held]
    out = []
    for r, (i, lab, v) in enumerate(held):
        if i % every:
            continue
        scored = [(-int(v @ w), j, other) for s, (j, other, w) in enumerate(held) if s != r]
        near = sorted((s, j) for s, j, other in scored if other == lab)[:positives]
        for p, pid in near:
            far = sorted((s, j) for s, j, other in scored if other != lab and 30 * -p <= 100 * -s <= 90 * -p)[:negatives]
            out += [(i, pid, k + 1, j, -p, -s) for k, (s, j) in enumerate(far)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, row long, tile long, score double"


def mined(spark, table, every, label=None):
    df = spark.createDataFrame([(i, v, lab, 1, 2, 0.5) for i, lab, v in table], VECTORS).repartition(3)
    return sorted(tuple(r) for r in hn.HardNegatives(df, F.col("vec_id") % every == 0, label=label or "label").mine().collect())


def vectors(n, dims=6, labels=3, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    return [(i, i % labels, (centres[i % labels] + rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def test_hard_negatives_with_odd_rows(spark):
    table = vectors(300)
    table += [(400, 1, None), (401, None, table[0][2]), (None, 1, table[0][2]), (403, 1, [1.0, float("nan")]), (404, 1, [None, 1.0]),
              (405, 2, [float("inf")] * 6), (410, 1, [0.5, -0.25]), (420, 2, []), (430, 0, [0.0] * 6), (440, 99, table[5][2])]
    table += [(500, 1, table[7][2]), (500, 1, table[8][2]), (510, 2, table[7][2]), (510, 0, table[7][2])]  # repeated ids
    table += [(600 + i, i % 2, table[11][2]) for i in range(40)]  # copies: ties everywhere
    assert mined(spark, table, 10) == plain_negatives(table, 10)


def test_hard_negatives_over_many_tiles(spark, monkeypatch):
    """Tiles, parts of a hot tile, directory and query blocks of small size."""
    for name, value in (("TILE", 60), ("BLOCK", 7), ("DIRECTORY", 3), ("SAMPLE", 200)):
        monkeypatch.setattr(hn, name, value)
    table = vectors(500, 5, 4, 2) + [(1000 + i, 3, [0.5, 0.5, -0.25, 1.0, 0.0]) for i in range(250)]
    assert mined(spark, table, 25) == plain_negatives(table, 25)


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, 1, [1.0, 2.0])], 10) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])], 10) == [(0, 1, 1, 2, 65536, 32768)]
    negative = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5]), (3, 1, [0.0]), (4, 2, [0.0])]
    assert mined(spark, negative, 10) == plain_negatives(negative, 10) == [(0, 3, 1, 4, 0, 0)]
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(0, 1, [1e30]), (1, 1, [1e30])], 10)
    big = [(i, i % 2, [float(v * 6e4), float(i * 2e4)]) for i, v in enumerate([1, 2, 3, 5, 7, 6])]  # past exact doubles' products
    assert mined(spark, big, 2) == plain_negatives(big, 2)


@pytest.mark.parametrize("same", [True, False])
def test_tree_search_in_a_tile(same):
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, (900, 4)).astype(float)
    labels = np.sort(rng.integers(0, 4, 900))
    order = hn.str_order(np.concatenate([points, labels[:, None]], 1), [4, 0, 1, 2, 3], hn.LEAF)
    assert sorted(order) == list(range(900))
    tile = {"points": points[order], "labels": labels[order], "ids": (order * 7) % 400, "rows": order}
    q, own, mine = points[:20], np.arange(20), labels[:20]
    low = np.tile([[-(1 << 62), 100, 500, 9]], (20, 1))
    high = np.tile([[1 << 62, 2000, 400, 900]], (20, 1))  # the third window is empty
    query, slot, score, ids, row = hn.search_tile(q, own, mine, low, high, np.full((20, 4), -(1 << 62)), tile, 6, same)
    got = sorted(zip(query.tolist(), slot.tolist(), (-score).tolist(), ids.tolist(), row.tolist()))
    want = []
    for i in range(20):
        for w in range(4):
            s = points @ q[i]
            fit = [(-int(s[r]), (r * 7) % 400, r) for r in range(900)
                   if r != i and (labels[r] == mine[i]) == same and low[i, w] <= s[r] <= high[i, w]]
            want += [(i, w, *x) for x in sorted(fit)[:6]]
    assert got == sorted(want)
    least, most = hn.intervals(q, points.min(0)[None], points.max(0)[None])
    assert (least[:, 0] <= (points @ q.T).min(0)).all() and (most[:, 0] >= (points @ q.T).max(0)).all()


# --- pattern packing -----------------------------------------------------------------------------------------------

def check_packing(pieces, lengths, window):
    """Every token once, sequences full from 0 on without gaps, none longer than the window."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for doc, total in lengths.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at and (length == window or start + length == total)
            at += length
        assert at == total
    return len(by_sequence)


def test_pattern_packing(spark, docs):  # noqa: F811
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    whole = docs.where("doc_id is not null").select("doc_id", "text", "lang").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(
        [(900 + i, t, "") for i, t in enumerate([*MORE, "don't WON'T we'll ΣσΣ İIı ÅÅ", "\x1c\x85 a b"])], "doc_id long, text string, lang string"))
    got = pp.pattern_pack(whole, keep_ids=True).collect()
    want = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 0] for r in whole.collect()}
    for r in got:
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4"))
        assert np.frombuffer(r.ids, "<u2").tolist() == ids
    n = check_packing([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], {d: len(i) for d, i in want.items()}, 2048)
    assert n <= -(-sum(map(len, want.values())) // 2048) + 1


def test_pattern_packing_of_repeated_and_no_rows(spark, docs, none):  # noqa: F811
    assert pp.pattern_pack(none).count() == 0
    got = pp.pattern_pack(docs, window=64)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.where("piece = 0").count() == docs.count()
    spans = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"))
    assert spans.where("n <> top or n > 64").isEmpty()
    nulls = spark.createDataFrame([(None, None), (1, None), (1, "")], "doc_id long, text string")
    assert [(r.length, r.sequence_id) for r in pp.pattern_pack(nulls).collect()] == [(1, 0)] * 3


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece(seed):
    """Histograms of many shapes: all pieces placed, close to the fewest sequences."""
    rng = np.random.default_rng(seed)
    window = [64, 64, 100, 256, 256, 32][seed]
    kinds = [rng.integers(1, window + 1, 400), rng.integers(1, 9, 900), rng.geometric(0.1, 500).clip(1, window),
             np.full(333, window // 2 + 1), rng.choice([5, 60, 190, 256], 700), np.full(1000, 1)]
    lengths = kinds[seed]
    histogram = dict(collections.Counter(lengths.tolist()))
    plan = pp.packing_plan(histogram, window)
    pieces, doc = [], 0
    totals = {}
    for r in plan.itertuples():
        for i in range(r.count):
            pieces.append((doc, 0, r.length, r.sequence + i // r.each, r.offset + i % r.each * r.length))
            totals[doc] = r.length
            doc += 1
    assert collections.Counter(p[2] for p in pieces) == histogram
    for length, part in plan.groupby("length"):  # ranks of a length are used once, without gaps
        part = part.sort_values("first")
        assert (part["first"].to_numpy() == np.append(0, part["count"].cumsum()[:-1])).all()
    n = check_packing(pieces, totals, window)
    least = max(-(-sum(lengths.tolist()) // window), int((lengths * 2 > window).sum()))
    assert n <= least * 1.03 + 2


def test_the_fit_is_the_minimum():
    """No pattern left out would bring the squares down, and those inside are balanced."""
    rng = np.random.default_rng(3)
    histogram = np.append(0, rng.integers(0, 30, 48))
    rows = pp.patterns(np.flatnonzero(histogram), 48)
    assert (rows.sum(1) == 48).all() and len({tuple(r) for r in rows.tolist()}) == len(rows)
    x = pp.nonnegative_fit(rows, histogram)
    a = np.zeros((49, len(rows)))
    for k in range(3):
        np.add.at(a, (rows[:, k], np.arange(len(rows))), 1)
    a[0] = 0
    loss = lambda v: float(((a @ v - histogram) ** 2).sum())
    slope = a.T @ (histogram - a @ x)
    slow = np.zeros(len(rows))
    for _ in range(20_000):  # projected gradient
        slow = np.maximum(0, slow + 0.02 * (a.T @ (histogram - a @ slow)))
    assert (x >= 0).all() and loss(x) <= loss(slow) * 1.01 + 0.5 and slope.max() < 1.0
