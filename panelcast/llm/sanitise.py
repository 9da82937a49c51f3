"""Personal data and the terms that give it away, in DataFrame functions only.

Base spans (email, ip, card, phone) come from patterns. The values found, and the parts of them that several values share
(user and host of an address, the network of an ip, the issuer of a card, the area of a phone), are the protected events.
Terms are the words of letters outside base spans. Over all distinct texts it is counted how many hold the event, n(e), how
many hold the term, n(t), and how many hold both, n(t, e). The probability of the event given the term, p(e | t), is taken at
the lower end of its confidence interval (Wilson, ``Z`` deviations), so that a term that met an event once by chance tells
nothing. A term discloses the event when two amounts of information say so: what is left unknown of the event once the term is
seen, -log2 p(e | t), is at most ``GENERALISE`` bits, and what the term adds, log2(p(e | t) N / n(e)), is at least
``GAIN`` bits. Such terms become a general word wherever they stand, also in documents without the event; where at most
``REMOVE`` bits stay unknown they are removed. Copies of a text count once.

One bit left means p >= 1/2, which takes at least four texts that hold both; fewer never give enough evidence, so rare chance
meetings, most of what a corpus holds, are left alone. What stands in fewer texts is protected by its base span.

Scale: no text is shuffled or stored. Events and terms in fewer than the least number of texts leave before pairs are made,
pairs exist only in texts that hold an event, and meet partial aggregates. Term counts and hits over the corpus are taken for
candidate terms alone: a Bloom bit array of at most ``MAX_BITS`` bits (a scalar subquery) drops other words before anything is
shuffled, and the exact join follows. Spans travel as (text hash, term, start, end).

Patterns start only where a match can start (look-behind) and use possessive runs, so long texts without white space take
linear time. Positions are code points; ends are exclusive.

Defined results: a NULL text is empty and has no spans. Repeated rows get the same spans. Rows with a NULL id are kept. An
empty table gives an empty table. Other columns are not read; ``sanitised`` returns them as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, lower_ascii, table
from panelcast.llm.url_filter import _bit_array, _passes, _positions

Z, GENERALISE, REMOVE, GAIN = 1.96, 1.0, 0.15, 3.0
LEAST_TEXTS = math.ceil(Z * Z / (2**GENERALISE - 1))  # fewer texts cannot reach the lower bound that GENERALISE asks for
MAX_BITS, BITS_PER_TERM = 1 << 27, 10
BROADCAST_DOCS = 100_000
KINDS = ["email", "ip", "card", "phone", "term"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}[\p{L}\p{M}'’-]*+"


def matches(text: Column, pattern: str, keep=None) -> Column:
    """Array of (s, e, v) of all matches, from the pieces between them and their lengths; ``keep`` tells by v which to list."""

    def spans(b: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(b["pieces"], i))
            e = s + F.length(F.get(b["found"], i))
            v = F.get(b["found"], i)
            more = F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), v.alias("v"))))
            return F.struct(e.alias("at"), (more if keep is None else F.when(keep(v), more).otherwise(acc["out"])).alias("out"))

        none = F.array().cast("array<struct<s:int,e:int,v:string>>")
        turns = F.when(F.size(b["found"]) > 0, F.sequence(F.lit(0), F.size(b["found"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda a: a["out"])

    both = F.struct(
        F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.transform(F.array(both), spans)[0]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return F.when(i % 2 == 1, doubled).otherwise(x)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (k, s, e, v) by kind, then start."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def found(kind: int, likely: Column, pattern: str, keep) -> Column:
        spans = F.when(likely, F.filter(matches(text, pattern), lambda m: keep(m["v"]))).otherwise(none)
        return F.transform(spans, lambda m: F.struct(F.lit(kind).alias("k"), m["s"].alias("s"), m["e"].alias("e"), m["v"].alias("v")))

    def card(v: Column) -> Column:
        n = F.length(_digits(v))
        return F.when(n.between(16, 19), luhn(_digits(v))).otherwise(F.lit(False))

    small = lambda v: F.forall(F.split(v, r"\."), lambda p: p.cast("double") <= 255)
    phone = lambda v: F.length(_digits(v)).between(8, 15)
    return F.concat(
        found(0, F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        found(1, text.rlike(r"[0-9]\.[0-9]"), IP, small),
        found(2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), CARD, card),
        found(3, text.rlike(r"\+[0-9]"), PHONE, phone))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"], m["e"])), ",")


def _replaced(text: Column, spans: Column, instead) -> Column:
    """``text`` with sorted spans replaced by ``instead(span, furthest end before it)``."""
    # Where spans overlap, the later one starts at the furthest end so far.
    ends = F.aggregate(spans, F.array(F.lit(0)), lambda a, m: F.concat(a, F.array(F.greatest(F.element_at(a, -1), m["e"]))))
    return F.transform(F.array(ends), lambda far: F.concat(
        F.array_join(F.transform(spans, lambda m, i: F.concat(
            F.substring(text, F.get(far, i) + 1, F.greatest(m["s"] - F.get(far, i), F.lit(0))), instead(m, F.get(far, i)))), ""),
        F.substring(text, F.element_at(far, -1) + 1, F.length(text))))[0]


def _blanked(text: Column, base: Column) -> Column:
    """``text`` with spaces in place of base spans, as long as before."""
    spans = F.array_sort(F.transform(base, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))))
    gap = lambda m, far: F.repeat(F.lit(" "), F.greatest(m["e"] - F.greatest(m["s"], far), F.lit(0)))
    return F.when(F.size(base) == 0, text).otherwise(_replaced(text, spans, gap))


def _terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda v: F.lower(v)))


def _marked(terms: DataFrame, scratch: Scratch, name: str) -> tuple[Column, int] | None:
    """Bloom bits of the terms as an array in the plan, and their number; None without terms."""
    n = terms.count()
    if not n:
        return None
    bits = min(MAX_BITS, max(64, math.ceil(n * BITS_PER_TERM / 64) * 64))
    marks = (
        terms.select(F.explode(F.array(*_positions(F.col("term"), 0, bits))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")))
    words = scratch.write(terms.sparkSession.range(0, bits // 64).join(marks, "id", "left").select(
        F.col("id").alias("word"), F.coalesce("bits", F.lit(0)).alias("bits")), name)
    return _bit_array(words), bits


def protected_events(m: Column) -> Column:
    """The value of a span and the parts of it that other values may share, each with its kind."""
    digits, address = _digits(m["v"]), lower_ascii(m["v"])
    parts = F.when(m["k"] == 0, F.array(
        F.concat(F.lit("0="), address), F.concat(F.lit("0u="), F.substring_index(address, "@", 1)),
        F.concat(F.lit("0h="), F.substring_index(address, "@", -1)))
    ).when(m["k"] == 1, F.array(F.concat(F.lit("1="), m["v"]), F.concat(F.lit("1n="), F.substring_index(m["v"], ".", 3)))
    ).when(m["k"] == 2, F.array(F.concat(F.lit("2="), digits), F.concat(F.lit("2i="), F.substring(digits, 1, 6)))
    ).otherwise(F.array(F.concat(F.lit("3="), digits), F.concat(F.lit("3a="), F.substring(digits, 1, 6))))
    return F.array_distinct(parts)


def certain(both: Column, n_t: Column) -> Column:
    """Lower end of the confidence interval of the share ``both / n_t`` (Wilson)."""
    p, z2 = both / n_t, Z * Z
    spread = F.sqrt(p * (1 - p) / n_t + F.lit(z2 / 4) / (n_t * n_t)) * F.lit(Z)
    return F.greatest((p + F.lit(z2 / 2) / n_t - spread) / (1 + F.lit(z2) / n_t), F.lit(1e-300))


def telling_terms(base: DataFrame, bare: DataFrame, scratch: Scratch) -> DataFrame:
    """Terms (term, removed) that disclose an event; ``base`` has (text_key, base), ``bare`` (text_key, bare, mentions)."""
    held = base.where(F.size("base") > 0).select("text_key", F.explode("base").alias("m")).select(
        "text_key", F.explode(protected_events(F.col("m"))).alias("event")).distinct()
    held = scratch.write(held, "held")
    n_e = held.groupBy("event").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= LEAST_TEXTS)
    held = scratch.write(held.join(n_e, "event"), "events")
    own = bare.where("mentions > 0").select("text_key", F.explode(_terms_of(F.col("bare"))).alias("term")).distinct()
    own = scratch.write(own.join(held.select("text_key").distinct(), "text_key", "left_semi"), "own")
    often = own.groupBy("term").agg(F.count("*").alias("n_own")).where(F.col("n_own") >= LEAST_TEXTS)
    # n(t) is at least the number of these texts that hold the term: pairs that fail with it fail with n(t), so common words
    # leave before the corpus is counted.
    pairs = scratch.write(own.join(often, "term").join(held, "text_key").groupBy("term", "event", "n_e", "n_own").agg(
        F.count("*").alias("n_te")).where(F.col("n_te") >= LEAST_TEXTS).where(
        -F.log2(certain(F.col("n_te"), F.col("n_own"))) <= GENERALISE).drop("n_own"), "pairs")
    terms = scratch.write(pairs.select("term").distinct(), "terms")
    marked = _marked(terms, scratch, "bits")
    if marked is None:
        return terms.select("term", F.lit(False).alias("removed")).where(F.lit(False))
    n_texts = float(base.select("text_key").distinct().count())
    n_t = bare.select("text_key", F.explode(_terms_of(F.col("bare"))).alias("term")).where(
        _passes(marked[0], F.col("term"), 0, 0, marked[1])).distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    p = certain(F.col("n_te"), F.col("n_t"))
    judged = pairs.join(n_t, "term").withColumns({"left": -F.log2(p), "gain": F.log2(p * F.lit(n_texts) / F.col("n_e"))})
    return scratch.write(judged.where((F.col("left") <= GENERALISE) & (F.col("gain") >= GAIN)).groupBy("term").agg(
        F.max(F.col("left") <= REMOVE).alias("removed")), "telling")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``text_key``, ``base`` (k, s, e, v) and ``terms`` (s, e, removed)."""
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    based = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("text_key")).withColumn(
        "base", base_spans(F.col("_text")))
    base = scratch.write(based.select("_id", "text_key", "base"), "base")
    # Worked out from the texts in each pass that needs it: storing it would double the texts.
    bare = based.select("text_key", _blanked(F.col("_text"), F.col("base")).alias("bare"), F.size("base").alias("mentions"))
    telling = telling_terms(base, bare, scratch)
    marked = _marked(telling.select("term"), scratch, "told")
    none = F.array().cast("array<struct<s:int,e:int,removed:boolean>>")
    spans = F.transform("base", lambda m: F.struct(m["k"].alias("k"), m["s"].alias("s"), m["e"].alias("e"))).alias("base")
    if marked is None:
        return base.select("_id", "text_key", spans, none.alias("terms"))
    likely = lambda v: _passes(F.col("_bits"), F.lower(v), 0, 0, marked[1])
    found = bare.withColumn("_bits", marked[0]).select(
        "text_key", F.explode(matches(F.col("bare"), TERM, likely)).alias("t")).select(
        "text_key", F.lower("t.v").alias("term"), "t.s", "t.e").distinct()
    added = scratch.write(found.join(telling, "term").groupBy("text_key").agg(
        F.sort_array(F.collect_list(F.struct("s", "e", "removed"))).alias("terms")), "added")
    return base.select("_id", "text_key", spans).join(added, "text_key", "left").select(
        "_id", "text_key", "base", F.coalesce("terms", none).alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with their own columns: base spans become ``<KIND>``, terms ``<TERM>`` or nothing."""
    found = find(docs, id_col, text_col).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["_id", "text_key"])
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    spans = F.array_sort(F.concat(
        F.transform("base", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.get(tags, m["k"]).alias("tag"))),
        F.transform("terms", lambda t: F.struct(
            t["s"].alias("s"), t["e"].alias("e"), F.when(t["removed"], "").otherwise("<TERM>").alias("tag")))))
    found = Scratch(docs.sparkSession, "pii").write(
        found.select(F.col("_id").alias("__id"), F.col("text_key").alias("__key"), spans.alias("__spans")), "spans")
    few = found.count() <= BROADCAST_DOCS
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(
        F.broadcast(found) if few else found,
        (F.xxhash64(text) == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")

    tag = lambda m, far: F.when(m["s"] >= far, m["tag"]).otherwise("")
    new = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(_replaced(text, F.col("__spans"), tag))
    types = dict(docs.dtypes)
    out = joined.withColumn("__new", new)
    return out.select(*[
        F.col("__new").alias(c) if c == text_col
        else F.when(F.col("__spans").isNull(), F.col(c)).otherwise(F.length("__new").cast(types[c])).alias(c) if c == length_col
        else F.col(c) for c in docs.columns])


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda m: m["k"] == k)).cast("long")
    terms = F.transform("terms", lambda t: F.struct(F.lit(4).alias("k"), t["s"].alias("s"), t["e"].alias("e")))
    return found.select(
        F.col("_id").alias("doc_id"), count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"),
        count(3).alias("n_phone"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", terms)).alias("spans"))
