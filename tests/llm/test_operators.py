"""Every training-data operator on a small table with all odd cases, against plain Python."""

import collections
import math
import pathlib
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from panelcast.llm import ann, bpe, common, line_quality, lm_score, mixture, near_dup, packing, sanitise
from panelcast.llm import token_attribution, toxicity, url_filter
from panelcast.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Extra columns carry names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, at int, `_text` string"


def rows():
    rng = np.random.default_rng(1)
    pool = [f"w{i}a" for i in range(300)]
    text = lambda n: " ".join(rng.choice(pool, n))
    base = text(120)
    out = [(i, f"{text(40)}\n{text(30)}.", "en", f"s{i % 3}") for i in range(30)]
    out += [(100 + i, base, "en", "hot") for i in range(6)]
    out += [(110 + i, base + f" tail{i}", "en", "hot") for i in range(5)]
    out += [(120, base, None, None), (120, base, None, None), (None, base, "en", "hot"), (None, None, None, None)]
    out += [(130, None, "en", "s1"), (131, "", "en", "s1"), (132, " \n\t ", "en", "s1"), (133, "one two", None, "s2")]
    out += [(134, "é ü\n\nmail a.b@c.example.com x_d@e.org\u3000日本 +1 (555) 123-4567, 4111 1111 1111 1111, 1.2.3.4 1.2.3.999", "de", None)]
    out += [(135, text(9000), "en", "s0"), (136, "x" * 30000, "en", "s0"), (137, "7 " * 4000, "en", "s0")]
    out += [(140 + i, f"{text(30)} call jo{i % 2}@mail.org zebra quagga {text(20)}", "en", "pii") for i in range(8)]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, 7, 1, "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(texts, percent):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, none, percent):
    got = sorted(near_dup.near_duplicates(docs, percent=percent).collect(), key=str)
    data = rows()
    group = groups([r[1] for r in data], percent)
    ids = collections.defaultdict(list)
    for r, g in zip(data, group):
        ids[g].append(r[0])
    want = collections.Counter(
        (r[0], len(shingles(r[1])), min((x for x in ids[g] if x is not None), default=None) if shingles(r[1]) else r[0])
        for r, g in zip(data, group))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert near_dup.near_duplicates(none).count() == 0


def test_near_duplicate_blocks_lose_no_link(spark, monkeypatch):
    """A family in which most links are not with a bucket's leader."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            w[at] = f"n{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(near_dup, "CHUNK", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()}
    group = groups(texts, 85)
    first = {}
    for i, g in enumerate(group):
        first[g] = min(first.get(g, i), i)
    assert got == {i: first[g] for i, g in enumerate(group)}


def test_estimate_and_registers():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 60, 2000, dtype=np.uint64))
    for similarity in (0.95, 0.9, 0.4):
        shared = int(2 * similarity / (1 + similarity) * len(a))
        b = np.unique(np.concatenate([a[:shared], rng.integers(0, 1 << 60, len(a) - shared, dtype=np.uint64)]))
        x, y = near_dup.registers(a), near_dup.registers(b)
        ok = near_dup.plausible(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(b)]), 0.85)
        assert ok[0] == (similarity > 0.5)
        assert (near_dup.registers(np.union1d(a, b)) == np.maximum(x, y)).all()


def test_line_quality(docs, none):
    def base(text):
        t, w = text or "", words(text)
        lines = [x for x in t.split("\n") if words(x)]
        seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed
    got = line_quality.quality(docs).collect()
    assert collections.Counter((r["doc_id"], *base_of(r)) for r in got) == collections.Counter(
        (r[0], *base(r[1])) for r in rows())
    assert all(r["kept"] == (not r["base_failed"]) for r in got if r["left_share"] == 1)
    assert line_quality.quality(none).count() == 0


def base_of(r):
    return tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_common_lines_deplete(spark):
    lines = [(i, "Same old line again\n" * 3 + (f"own{i} " * 40 if i % 2 else "x1 x2"), "h") for i in range(40)]
    got = {r["doc_id"]: r for r in line_quality.quality(spark.createDataFrame(lines, "doc_id long, text string, source string")).collect()}
    assert got[0]["left_share"] == pytest.approx(2 / 14)
    assert got[1]["left_share"] == pytest.approx(40 / 52)


def test_common_lines_are_removed(spark):
    data = [(i, f"Same old line {i}\n\nown{'ab'[i % 2] * (i + 1)} words\nsame  OLD line 7", "h") for i in range(40)] + [(50, None, "h"), (51, "same old line 1", None)]
    got = {r["doc_id"]: r["cleaned"] for r in line_quality.quality(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    # The number counts as zeros: lines with one digit are one line, lines with two digits another.
    assert all(got[i] == f"\nown{'ab'[i % 2] * (i + 1)} words" for i in range(40))
    assert got[50] is None and got[51] == "same old line 1"


def test_common_lines_of_a_hot_host(spark):
    text = F.expr("concat(translate(cast(id AS string), '0123456789', 'abcdefghij'), if(id < 120, '\\nsame line', ''))")
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("hot").alias("source"))
    got = line_quality.quality(df).where("doc_id < 120").collect()
    assert len(got) == 120 and all("\n" not in r["cleaned"] for r in got)


def test_packing_round_trip(docs, none):
    enc = bpe.Encoder(**bpe.public_files())
    pieces = packing.pack(docs, window=256, shard_tokens=4000).collect()
    assert sum(r["length"] for r in pieces) == sum(len(enc.encode(r[1])) + 1 for r in rows())
    by_sequence = collections.defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        total = 0
        for r in parts:
            assert r["offset"] == total
            total += r["length"]
        assert total == 256 or total & (total - 1) == 0
    for i, text in {r[0]: r[1] for r in rows() if 120 < (r[0] or 0)}.items():
        ids = [x for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == [*enc.full.encode(text or "", add_special_tokens=False).ids, 1]
    assert packing.pack(none).count() == 0


def test_packing_takes_neighbours():
    terms = [(np.array([1, 2, 3]), np.array([1, 1, 1])), (np.array([7, 8]), np.array([1, 1])), (np.array([2, 3]), np.array([1, 1]))]
    windows = packing.pack_rests(terms, np.array([60, 40, 40]), np.ones(10), 100, 3)
    assert windows[0] == [(0, 0, 60), (2, 0, 40)]


def test_packing_brings_neighbours_of_all_shards_together(spark):
    """48 topics of 6 documents over some 40 shards: dealt at random, the topics' documents would hardly meet."""
    rng = np.random.default_rng(9)
    pool = [[f"{a}{b}{c}" for a, b, c in rng.choice(["ba", "lo", "mi", "se", "ta", "ru", "ke", "no", "fi", "gu", "pe", "va", "zo", "du"], (25, 3))] for _ in range(48)]
    data = [(i, " ".join(rng.choice(pool[i % 48], 60))) for i in range(288)]
    pieces = packing.pack(spark.createDataFrame(data, "doc_id long, text string").repartition(4), window=512, shard_tokens=1024).collect()
    assert len({r["sequence_id"] >> 32 for r in pieces}) > 20
    shard_of = {r["doc_id"]: r["sequence_id"] >> 32 for r in pieces}
    pairs = [(i, j) for i in range(288) for j in range(i) if i % 48 == j % 48]
    assert sum(shard_of[i] == shard_of[j] for i, j in pairs) / len(pairs) >= 0.25


def test_encoder_matches_tokenizers():
    enc = bpe.Encoder(**bpe.public_files())
    odd = ["a  b", "a \n b", "\n\n x \n", "x ", "  ", "a\tb c\r\n d", "don't  stop", "é ü\u3000x", "日本 語 12.5", "a\x1cb c", "",
           "<|endoftext|> x", "a\x85b\xa0c"]
    for t in odd + [r[1] or "" for r in rows()]:
        assert enc.encode(t).tolist() == enc.full.encode(t, add_special_tokens=False).ids


def test_encoder_cuts_as_the_public_pattern():
    """Random runs of white space, quotes, digits and letters, whose cuts the quicker pattern must share."""
    enc = bpe.Encoder(**bpe.public_files())
    assert bpe.public_files()["pattern"] == bpe._PATTERN and enc.quick._pat_str == bpe._QUICK_PATTERN
    rng = np.random.default_rng(5)
    signs = [" ", "  ", "\n", "\t", "\r", "\xa0", "\x85", "\x1c", "'", "'s", "'ll", "'D", "a", "Zb", "é", "ª", "1", "²", "½", ".", "--", "\xad", "×"]
    for n in rng.integers(1, 30, 3000):
        text = "".join(rng.choice(signs, n))
        assert enc.encode(text).tolist() == enc.full.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_cuts_longer_white_space():
    """The quicker pattern has no look-ahead, so long runs are cut beforehand; ids and cuts are those of ``tokenizers``."""
    enc = bpe.Encoder(**bpe.public_files())
    assert "(?!" not in enc.quick._pat_str and enc.quick.special_tokens_set
    assert bpe._parts("a  b\n\n\tc \xa0\x85d £ e  ") == ["a ", " b\n\n", "\tc \xa0", "\x85d £ e  "]
    rng = np.random.default_rng(15)
    signs = [" ", " ", "\n", "\t", "\v", "\f", "\r\n", "\xa0", "\x85", "\x1c", "\x1f", "£", "é", "a", "1", ".", "'s", "<|endoftext|>"]
    for n in rng.integers(1, 40, 2000):
        text = "".join(rng.choice(signs, n))
        assert enc.encode(text).tolist() == enc.full.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_takes_less_time():
    """The former encoder searched for an empty special token at every character and matched with look-ahead: twice the time."""
    import tiktoken

    enc = bpe.Encoder(**bpe.public_files())
    former = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    slow = tiktoken.Encoding("former", pat_str=former, mergeable_ranks=enc.quick._mergeable_ranks, special_tokens={})
    rng = np.random.default_rng(16)
    text = " ".join("".join(rng.choice(list("etaoinshrd"), n)) for n in rng.integers(2, 9, 60_000))

    def least(encode):
        times = []
        for _ in range(5):
            start = time.thread_time()
            encode(text)
            times.append(time.thread_time() - start)
        return min(times)
    assert least(enc.encode) < 0.8 * least(lambda t: slow.encode_to_numpy(t, disallowed_special=()))


def test_term_counts():
    rng = np.random.default_rng(6)
    for n, kind in ((1, "<u2"), (2, "<u4"), (700, "<u2"), (5000, "<u4")):
        ids = rng.integers(0, 300, n).astype(kind)
        for got, want in zip(packing.term_counts(ids), np.unique(ids, return_counts=True)):
            assert got.tolist() == want.tolist()


def test_token_attribution(docs, none):
    enc = bpe.Encoder(**bpe.public_files())
    got = collections.defaultdict(list)
    for r in token_attribution.section_tokens(docs).collect():
        got[r["doc_id"]].append(r)
    for r in rows():
        if r[0] is None or r[0] == 120:
            continue
        text, parts = r[1] or "", sorted(got[r[0]], key=lambda x: x["section"])
        lines = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
        assert ["".join(lines[:i + 1]) for i in range(len(lines))] == [text[:p["stop"]] for p in parts]
        owner = [i for i, line in enumerate(lines) for _ in line.encode()]
        want, at = collections.Counter(), 0
        for token in enc.encode(text):
            size = bpe.byte_lengths(bpe.public_files()["path"])[token]
            votes = collections.Counter(owner[at:at + size])
            want[min(votes, key=lambda k: (-votes[k], k))] += 1
            at += size
        assert [p["n_tokens"] for p in parts] == [want[i] for i in range(len(lines))]
    spans = docs.where("doc_id = 133").withColumn("fields", F.expr("array(named_struct('start', 0, 'stop', 3))"))
    assert [(r["section"], r["n_tokens"]) for r in token_attribution.section_tokens(spans, sections_col="fields").collect()] == [(-1, 1), (0, 1)]
    assert token_attribution.section_tokens(none).count() == 0


def test_language_model(docs, none):
    fold = common.crc_fold(F.col("doc_id"), 5)
    got = lm_score.lm_scores(docs, fold != 1).collect()
    key = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = [[*words((r[1] or "").translate(LOWER)), None] for r in rows()]
    count = collections.Counter(w for r, t in zip(rows(), tokens) if key(r[0]) != 1 for w in t)
    n, z = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    want = collections.Counter(
        (r[0], key(r[0]) != 1, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / z) for w in t), 5))
        for r, t in zip(rows(), tokens))
    assert collections.Counter((
        r["_id"], r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    assert lm_score.lm_scores(none, F.lit(True)).count() == 0


def test_language_model_keeps_rare_pairs(spark):
    """A filter far too small for all n-grams gives the scores of one that holds them: the rest is looked up, none is dropped."""
    rng = np.random.default_rng(1)
    data = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 300) % 4000)) for i in range(400)]
    docs = spark.createDataFrame(data + data[:100], "doc_id long, text string").repartition(3)
    whole = sorted((r["_id"], r["score"]) for r in lm_score.lm_scores(docs, F.col("doc_id") % 5 != 1).collect())
    small = sorted((r["_id"], r["score"]) for r in lm_score.lm_scores(docs, F.col("doc_id") % 5 != 1, max_bytes=1 << 16).collect())
    assert [a for a, _ in whole] == [a for a, _ in small]
    # Both differ by wrong hits of the filter only.
    assert np.abs(np.array([b for _, b in whole]) / np.array([b for _, b in small]) - 1).max() < 0.02


def zipf_texts(n):
    rng = np.random.default_rng(1)
    return [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 300) % 4000)) for i in range(n)]


def test_language_model_matches_counting(spark):
    """Scores and base scores against plain counts, quantised as in the filter, at three sizes of its parts."""
    data = zipf_texts(150)
    levels = lambda c: lm_score._LEVEL_VALUE[lm_score.level_of(np.array([c]))[0]]
    tokens = {i: [*t.split(), None] for i, t in data}
    train = [t for i, t in tokens.items() if i % 5 != 1]
    count = collections.Counter(w for t in train for w in t) + collections.Counter(START=len(train))
    pair = collections.Counter(p for t in train for p in zip(["START", *t], t))
    kept = collections.Counter()
    for (h, _), c in pair.items():
        kept[h] += c - 1
    n, z = sum(len(t) for t in train), sum(len(t) for t in train) + 0.5 * len(count)
    want = {}
    for i, t in tokens.items():
        want[i] = 0.0
        for h, w in zip(["START", *t], t):
            c, k, p = max(levels(count[h]), 1), levels(kept[h]), (levels(count[w]) + 0.5) / z
            left = min(max(1 - k / c, 0.02), 1)
            seen = min(max((levels(pair[h, w]) if pair[h, w] > 1 else 0) - 1, 0) / c, 1)
            want[i] += math.log10(min(((1 - left) * min(seen * c / max(k, 1e-9), 1) if seen > 0 else 0) + left * p, 1))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for size in (1 << 26, 1 << 14, 1 << 12):
        got = lm_score.lm_scores(docs, F.col("doc_id") % 5 != 1, max_bytes=size).collect()
        assert {r["train_tokens"] for r in got} == {n} and len(got) == 150
        off = np.array([abs(r["score"] / want[r["_id"]] - 1) for r in got])  # wrong hits of the filter
        assert off.max() < 0.02 and off.mean() < 0.004
        for r in got:
            assert abs(r["base_score"] - sum(math.log10((count[w] + 0.5) / z) for w in tokens[r["_id"]])) < 1e-6


def test_language_model_stores_little(spark):
    """Little more than the compressed texts is stored on the way, also when the filter has many parts: no n-gram travels twice."""
    data = zipf_texts(1500)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    root = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.rglob("*.parquet"))
    lm_score.lm_scores(docs, F.col("doc_id") % 5 != 1, max_bytes=1 << 16).collect()
    stored = sum(f.stat().st_size for f in set(root.rglob("*.parquet")) - before if f.is_file())
    assert stored < 0.6 * sum(len(t) for _, t in data)


def test_language_model_blocks():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 64, 5000, np.uint64)
    assert (lm_score.unmix64(common.mix64(keys)) == keys).all()
    keys, counts = lm_score._summed(keys, rng.integers(0, 1 << 40, 5000))
    parts = list(lm_score._blocks(keys, counts, 7))
    assert [p[0] for p in parts] == list(range(7))
    frame = pd.DataFrame(parts, columns=["bucket", "n", "keys", "counts"])
    blocks, back, sums = lm_score._read_blocks(frame)
    assert (np.concatenate(blocks) == keys).all() and (back == keys).all() and (sums == counts).all()


def test_bloom_counts():
    counts = np.array([1, 2, 3, 5, 20, 1000])
    key = np.arange(1, 7, dtype=np.uint64) * np.uint64(7919)
    held = np.zeros(lm_score.SEGMENT_BITS, np.uint8)
    for k, level in zip(key, lm_score.level_of(counts)):
        for j in range(1, level + 1):
            held[lm_score.event_bits(np.array([1]), np.array([k]), np.array([j]), 1)[1].ravel()] = 1
    found = lm_score.Filter(np.packbits(held, bitorder="little"), 1)
    got = found.count(1, key)
    assert (got >= counts / lm_score.LEVEL_BASE).all() and (got <= counts * lm_score.LEVEL_BASE).all()
    assert (found.count(2, key) == 0).all()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(docs, none):
    got = sanitise.find(docs).collect()
    names = lambda base: tuple((sanitise.KINDS[m["k"]], m["s"], m["e"]) for m in base)
    assert collections.Counter((r["_id"], names(r["base"])) for r in got) == collections.Counter(
        (r[0], tuple(plain_spans(r[1]))) for r in rows())
    texts = {r[0]: r[1] for r in rows()}
    told = {texts[r["_id"]][t["s"]:t["e"]] for r in got for t in r["terms"]}
    assert told <= {w.strip(".") for i in range(140, 148) for w in words(texts[i])}
    clean = {r["doc_id"]: r for r in sanitise.sanitised(docs).collect()}
    assert clean[134]["text"].startswith("é ü\n\nmail <EMAIL> <EMAIL>\u3000日本 <PHONE>, <CARD>, <IP> 1.2.3.999")
    assert all(not plain_spans(r["text"]) for r in clean.values())
    assert clean[0]["text"] == texts[0] and clean[134]["n_chars"] == len(clean[134]["text"])
    assert sanitise.sanitised(docs).count() == len(rows()) and sanitise.sanitised(docs).columns == docs.columns
    assert sanitise.find(none).count() == 0


def plain_telling(texts):
    """Telling terms by counting over distinct texts: {term: removed}."""
    texts = sorted({t or "" for t in texts})
    events, terms = [], []
    for text in texts:
        spans, bare = plain_spans(text), list(text)
        for _, s, e in spans:
            bare[s:e] = " " * (e - s)
        terms.append({w.lower() for w in regex.findall(sanitise.TERM, "".join(bare))})
        found = set()
        for kind, s, e in spans:
            v = text[s:e]
            digits, address = re.sub("[^0-9]", "", v), v.translate(LOWER)
            found |= {"email": {address, "u" + address.split("@")[0], "h" + address.split("@")[-1]},
                      "ip": {v, "n" + ".".join(v.split(".")[:3])}, "card": {"c" + digits, "i" + digits[:6]},
                      "phone": {"p" + digits, "a" + digits[:6]}}[kind]
        events.append(found)
    n_e, n_t = (collections.Counter(x for group in groups for x in group) for groups in (events, terms))
    n_te = collections.Counter((t, e) for ts, es in zip(terms, events) for t in ts for e in es)
    out = {}
    for (t, e), n in n_te.items():
        p, m, z = n / n_t[t], n_t[t], sanitise.Z
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        if -math.log2(max(low, 1e-300)) <= sanitise.GENERALISE and math.log2(low * len(texts) / n_e[e]) >= sanitise.GAIN:
            out[t] = out.get(t, False) or -math.log2(low) <= sanitise.REMOVE
    return out


def told(spark, texts):
    """Treated words of each text, and what the counting by hand says."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["_id"]: [(texts[r["_id"]][t["s"]:t["e"]].lower(), t["removed"]) for t in r["terms"]] for r in sanitise.find(df).collect()}
    telling = plain_telling(texts)
    for i, text in enumerate(texts):
        bare = list(text or "")
        for _, s, e in plain_spans(text or ""):
            bare[s:e] = " " * (e - s)
        want = [(w.lower(), telling[w.lower()]) for w in regex.findall(sanitise.TERM, "".join(bare)) if w.lower() in telling]
        assert sorted(got[i]) == sorted(want)
    return telling


def test_terms_disclose(spark):
    """Counts and decisions equal those by hand: values, hosts and networks that repeat, and chance meetings."""
    rng = np.random.default_rng(4)
    pool = [f"{a}{b}" for a in "kmnprst" for b in ("ala", "oro", "imi", "ubu")]
    words_ = lambda n: " ".join(rng.choice(pool, n))
    data = [words_(12) for _ in range(900)]
    data += [f"{words_(6)} zebra {words_(3)} ann{i % 2}@mail.org {words_(2)}" for i in range(7)]
    data += [f"Zebra alone {words_(4)}"] * 3 + [f"{words_(5)} quagga x{i}@one.example.com" for i in range(2)]
    data += [f"{words_(5)} okapi y{i}@big.example.org {words_(3)}" for i in range(45)]
    data += [f"{words_(5)} tapir 10.1.7.{i} {words_(2)}" for i in range(6)] + [None, "", data[900], data[901]]
    telling = told(spark, data)
    assert telling["okapi"] and not telling["zebra"] and "tapir" in telling and "quagga" not in telling
    assert not set(telling) & set(pool)


def test_chance_meetings_are_left_alone(spark):
    """A rare word that met an address once says nothing about it: clean documents that hold it stay as they are."""
    data = [f"plain words here number{i % 700} thing" for i in range(1500)] + [
        f"plain number{i} quagga ann{i}@host{i}.org words here" for i in range(30)]
    assert told(spark, [f"{t} t{i}" for i, t in enumerate(data)]) in ({}, {"quagga": True}, {"quagga": False})


def test_terms_are_treated_in_whole_texts(spark):
    far = "plain words here " * 40
    data = [(i, f"{far}{i}") for i in range(500)] + [(5000 + i, f"Quagga {far}{i} ann@mail.org quagga") for i in range(10)]
    data += [(5100, "plain quagga here")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitised(df, length_col="none").collect()}
    assert clean[5000] == f"<TERM> {far}0 <EMAIL> <TERM>" and clean[5100] == "plain <TERM> here"
    assert all(clean[i] == data[i][1] for i in range(500))


def test_base_patterns_on_adjoining_matches(spark):
    text = "a@b.com_x@y.com +12345678 +1 2 3 4111111111111111-1 256.1.1.1 1.2.3.4.5.6.7.8 5 " + "9" * 40
    got = spark.createDataFrame([(text,)], "t string").select(sanitise.base_spans(F.col("t")).alias("b")).first()["b"]
    assert [(sanitise.KINDS[m["k"]], m["s"], m["e"]) for m in got] == plain_spans(text)


def test_mixture(docs, none):
    data = rows()
    got = mixture.mix(docs).collect()
    assert len(got) == len(data)
    size = collections.Counter()
    for r in data:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = mixture.targets([size[s] for s in order], mixture.WEIGHTS, 1.5, 2.0)
    assert sum(want) == pytest.approx(1.5 * sum(size.values()))
    taken = collections.Counter()
    for r in mixture.mix(docs, carry=["source"]).collect():
        assert r["taken"] <= 2 * r["size"]
        taken[r["c0"]] += r["taken"]
    for s, t in zip(order, want):
        assert abs(taken[s] - t) <= 2 * mixture.BLOCK
    again = collections.Counter((r["_id"], r["taken"]) for r in mixture.mix(docs.repartition(5)).collect())
    assert again == collections.Counter((r["_id"], r["taken"]) for r in got)
    texts = mixture.mixed_texts(docs)
    assert texts.columns == docs.columns
    assert sum(len(words(r["text"])) for r in texts.collect()) == sum(r["taken"] for r in got)
    assert mixture.mix(none).count() == 0


def test_apportionment_by_quotients():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        shares, caps = rng.integers(0, 50, n).astype(float).tolist(), rng.integers(0, 30, n).tolist()
        seats = int(rng.integers(0, 60))
        given = [0] * n
        for _ in range(seats):
            free = [i for i in range(n) if given[i] < caps[i] and shares[i] > 0]
            if not free:
                break
            given[min(free, key=lambda i: (-shares[i] / (2 * given[i] + 1), i))] += 1
        assert mixture.apportion(shares, caps, seats) == given


def test_toxicity(spark, docs, none):
    bad = ["grobble", "snarfik", "wuzzle"]
    rng = np.random.default_rng(2)
    pool = [f"{a}{b}" for a in ("ban", "lor", "mit", "sed", "tal") for b in ("e", "ing", "or", "us", "ana", "iro")]
    text = [" ".join(rng.choice(pool, 20)) for _ in range(300)]
    data = [(i, t + (f" {bad[i % 3]}." if i % 4 == 0 else ""), int(i % 4 == 0)) for i, t in enumerate(text)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(None, 1), (5, None), (9999, 1)], "_id long, toxic int").unionAll(
        df.where("doc_id < 200").select(F.col("doc_id").alias("_id"), "toxic"))
    model = toxicity.fit(df, labels)
    scored = {r["doc_id"]: r["score"] for r in model.scores(df.select("doc_id", F.col("text").alias("_text"))).collect()}
    assert all((scored[i] >= 0.5) == bool(y) for i, _, y in data if i >= 200)
    hidden = [(0, "so gr0bble"), (1, "g r o b b l e now"), (2, "snaaaarfik"), (3, "w-u-z-z-l-e"), (4, ""), (5, "bane lor1"), (6, "x" * 5000)]
    found = {r["i"]: r["score"] >= 0.5 for r in model.scores(spark.createDataFrame(hidden, "i long, _text string")).collect()}
    assert found == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert toxicity.fit(none, labels).scores(none.select(F.col("text").alias("_text"))).count() == 0
    kept = toxicity.reject_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_decoding_finds_the_best_path():
    decoder = toxicity.Decoder(toxicity.trigram_cells(["the cat sat on a mat", "gross slime oozes", "tell all trolls", None]))

    def paths(edges, at):
        if at == len(edges):
            yield 0.0, ()
            return
        for to, symbols, cost in edges[at]:
            for rest, tail in paths(edges, to):
                yield cost + rest, symbols + tail

    def worth(cost, symbols):
        x = y = toxicity.GAP
        for c in symbols:
            k = toxicity.GAP if c == " " else toxicity._code.get(c) or (toxicity.DIGIT if c.isdigit() else toxicity.OTHER)
            if k == toxicity.GAP and y == toxicity.GAP:
                continue
            cost += decoder.log_p[x][y][k]
            x, y = y, k
        return cost if y == toxicity.GAP else cost + decoder.log_p[x][y][toxicity.GAP]

    for word in ["c@t", "tr0ll", "t-r-o-l-l", "sl!!me", "gro$$", "cccat", "7e1l", "a.b", "###", "saaat0n", "te||"]:
        best = max(worth(*p) for p in paths(decoder.lattice(word), 0))
        # The decoded text, as some path of the lattice, is worth as much as the best of all paths.
        texts = {}
        for cost, symbols in paths(decoder.lattice(word), 0):
            text = "".join(c for i, c in enumerate(symbols) if c != " " or i and symbols[i - 1] != " ").lstrip(" ")
            texts[text] = max(texts.get(text, -1e9), worth(cost, symbols))
        assert abs(texts[decoder.decode(word)] - best) < 1e-9, word
    assert len(decoder.decode("a1b!" * 20_000)) >= 40_000  # one very long word


def test_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [
        (None, x[0].tolist()), (2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] + [1.0] * 11),
        (2004, [1.0]), (7, x[7].tolist()), (2005, x[3].tolist()), (2006, x[3].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids = np.array([*range(1500), 7, 2005, 2006])
    base = np.concatenate([x, x[7:8], x[3:4], x[3:4]]).astype(np.float64)
    hit = 0
    for q in range(0, 1500, 20):
        s = base @ base[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:10]].tolist()
        hit += sum((collections.Counter(best) & collections.Counter(v for v, _ in got[q])).values())
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert hit / (75 * 10) >= 0.9
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_of_repeated_ids(spark):
    """Rows that repeat an id are queries and candidates of their own."""
    data = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect())
    assert got == sorted([(20, 1, 3, 2.0), (20, 2, 3, 2.0), (20, 3, 20, 0.5), (20, 1, 3, 1.0), (20, 2, 3, 1.0), (20, 3, 20, 0.5)])


@pytest.mark.parametrize("kind", ["unlike", "outlier", "copies"])
def test_nearest_of_odd_rows(spark, kind):
    """Queries unlike all other rows, one row of huge norm, and many copies of a row (one list in parts): all neighbours are found."""
    rng = np.random.default_rng(3)
    n, d = 9_600, 16
    x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, d))
    if kind == "unlike":
        x[::20] = rng.normal(size=(n // 20, d))
    elif kind == "outlier":
        x[5] *= 1e6
    else:
        x[100:9_300] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 160 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    for q in range(0, n, 160):
        s = np.einsum("ij,j->i", x, x[q]).round(9)
        s[q] = -np.inf
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(n), -s))[:20].tolist()


@pytest.mark.parametrize("kind", ["clustered", "gaussian", "norms"])
def test_recall_over_many_lists(kind):
    """150 lists: the ratio selects them without a cap, vectors at a boundary lie in several, recall is at least 0.9."""
    rng = np.random.default_rng(0)
    n, lists = 24_000, 150
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = rng.normal(size=(300, 64))[rng.integers(0, 300, n)] + 0.4 * x
    if kind == "norms":
        x = x * np.exp(0.5 * rng.normal(size=(n, 1)))
    lifted = ann._lifted(x, (x**2).sum(1).max())
    centre = ann.fit_centroids(lifted, lists)
    graph = ann.neighbour_graph(centre, ann.DEGREE)

    class Held:
        value = (centre, graph)

    posted = pd.concat(ann._post(Held, (x**2).sum(1).max())([pd.DataFrame({"row": range(n), "vec_id": range(n), "v": list(x)})]))
    assert set(posted["row"]) == set(range(n)) and not posted.duplicated(["row", "list"]).any()
    if kind != "clustered":
        assert len(posted) > 1.5 * n
    queries = np.arange(0, n, 240)
    ratio = ann.fitted_ratio(x[:8000], lifted[:8000], centre, graph, 20)  # a third of the rows as the sample
    asked = pd.concat(ann._route(Held, ratio)([pd.DataFrame({"row": queries, "vec_id": queries, "v": list(x[queries])})]))
    where = posted.groupby("row")["list"].agg(set)
    read = asked.groupby("row")["list"].agg(set)
    hit = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hit += sum(bool(where[t] & read[q]) for t in np.argsort(-s)[:20])
    assert hit / (20 * len(queries)) >= 0.9
    flat = np.concatenate([x[queries], np.zeros((len(queries), 1))], 1)
    d = np.sqrt(((flat[:, None] - centre[None]) ** 2).sum(2))
    want = (d <= ratio * d.min(1, keepdims=True)).sum()
    assert abs(len(asked) - want) <= 0.03 * want  # the graph walk may miss the odd centroid
    assert asked["first"].sum() == len(queries)


def test_url_filter(spark):
    hosts = ["a.example.com", "www.example.com", "x.net", "b.org"]
    urls = [f"HTTP://{h.upper()}/{p}/{i}?q=1#t" for i in range(40) for h in hosts for p in ("en", "es")]
    data = [(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], None), (900, None, "h"), (901, "no scheme", "h"), (902, "x://net/es/", "h")]
    pages = spark.createDataFrame(data, "page_id long, url string, listed string").repartition(3)

    def key(u):
        tail = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", tail)[0]
        return host.translate(LOWER), re.match(r"[^?#]*", tail[len(host):])[0]
    listed = {"".join(key(u)) for u in urls[::7]} | {"elsewhere/"}
    frame = spark.createDataFrame([(k,) for k in listed] + [(None,)], "key string")

    def verdict(u):
        host, path = key(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        on = host + path in listed
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if on else "allow", on)
    want = collections.Counter((i, *verdict(u)) for i, u, _ in data)
    for limit in (url_filter.MAX_BYTES, 0):  # the cascade, and the join for lists beyond the bound
        assert collections.Counter(map(tuple, url_filter.judge(pages, frame, max_bytes=limit).collect())) == want
    assert url_filter.judge(pages.limit(0), frame).count() == 0
    assert url_filter.judge(pages, frame.limit(0)).where("listed").count() == 0


def few(step):
    """The step of a task, which fails if it is handed more than 1,024 rows at once."""
    def run(frames):
        def checked():
            for f in frames:
                if len(f) > 1024:
                    raise ValueError(f"{len(f)} rows at once")
                yield f
        yield from step(checked())
    return run


def test_python_takes_few_texts_at_once(spark, monkeypatch):
    """Spark hands over 10,000 rows by default; with long texts two such workers outgrow an executor."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    df = spark.range(0, 3000, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six "), (F.col("id") % 1500).cast("string")).alias("text"))
    monkeypatch.setattr(near_dup, "_sketch", few(near_dup._sketch))
    monkeypatch.setattr(near_dup, "_sets", few(near_dup._sets))
    monkeypatch.setattr(toxicity, "_count_trigrams", few(toxicity._count_trigrams))
    assert near_dup.near_duplicates(df).where("kept").count() == 1500
    toxicity.fit(df, df.select(F.col("doc_id").alias("_id"), F.lit(0).alias("toxic")))
    assert spark.conf.get(setting) == before


def test_toxicity_scores_few_texts_at_once():
    class Shared:
        def __init__(self, value):
            self.value = value

    cells = Shared(toxicity.trigram_cells(["some plain words", "an awful text"]))
    bounds = Shared({"=awful": 0.9})
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else "an awful text" if i % 7 == 2 else f"plain {i % 50}" for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "t": texts})
    for keep in (True, False):
        out = list(toxicity._score(cells, bounds, 0.5, "t", keep)(iter([batch, batch.slice(0, 0), batch.slice(5, 10)])))
        assert max(b.num_rows for b in out) <= 1024
        got = pa.Table.from_batches(out)
        assert got.column_names == (["id", "t", "score"] if keep else ["id", "score"])
        assert got["id"].to_pylist() == [*range(3000), *range(5, 15)]
        scores = got["score"].to_pylist()[:3000]
        assert all((s >= 0.5) == (t == "an awful text") and (t or s == 0) for s, t in zip(scores, texts))


def test_packing_takes_few_texts_at_once(spark, monkeypatch):
    steps = {name: getattr(packing, name) for name in ("_encode", "_frequencies", "_signatures")}
    for name, step in steps.items():
        monkeypatch.setattr(packing, name, lambda *a, step=step: few(step(*a)))
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    pieces = packing.pack(df, shard_tokens=4096, keep_ids=False)
    assert pieces.select("doc_id").distinct().count() == 3000


def test_packing_works_out_codes_once(spark):
    """The table with codes takes the place of the first one, and the last job only packs."""
    stored = lambda name: list(pathlib.Path(shared_dir(spark).replace("file:", "")).glob(f"panelcast/*/packing_{name}"))
    before = set(stored("tokens"))
    df = spark.range(0, 600, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    pieces = packing.pack(df, shard_tokens=512, keep_ids=False)
    assert len({r["sequence_id"] >> 32 for r in pieces.collect()}) > 4
    plan = pieces._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("MapInPandas") == 1
    assert set(stored("tokens")) == before and stored("coded")
    assert pieces.select("doc_id").distinct().count() == 600
