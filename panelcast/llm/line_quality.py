"""Quality rules by cross-document line frequency, in DataFrame functions only.

A line is normalised (A-Z lower-cased, digits to 0, white space squeezed) and hashed. For every host the number of distinct
texts that hold a line is counted; copies of a whole text count once, so that copying a document does not condemn it. A
line found in at least ``min_docs`` distinct texts of its host and in more than ``max_share`` of them, or in more than
``max_docs`` whatever the host's size, is boilerplate and is removed. A document of which less than ``min_left`` of the words is left is rejected.

Counting takes one shuffle of (host, line hash, text hash) with partial aggregation; the counts come back by an equality
join on (host, line), where adaptive execution splits a host's very common line. Only lines of one document meet in a row; they
are dropped from its text there, and the share left follows from the cleaned text.

Repeated words inside a document are found without a shuffle: hashes of 8-word windows are sorted within the row, equal
neighbours mark repeated windows, and the union of their spans is counted. Equality of windows and lines is by 64-bit hash.

Defined results: a NULL or empty text has no words, fails the base rules and is not kept. A NULL host is a host of its own.
Rows with the same id, host and text are judged alike. A text
without boilerplate is returned as it is (NULL stays NULL), otherwise its other lines joined by line feeds. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import SPACE, Scratch, table, words

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
MIN_DOCS, MAX_SHARE, MAX_DOCS, MIN_LEFT = 10, 0.005, 100, 0.3


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(word_array: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or more in the same array."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, j: F.when(j == 0, F.lit(0)).otherwise(
            F.least(F.lit(window), s - F.get(starts, j - 1))))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(window), lambda a, g: a + g))

    def starts_of(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, j: (p["h"] == F.get(pairs, j - 1)["h"]) | (p["h"] == F.get(pairs, j + 1)["h"]))
        return _bind(F.array_sort(F.transform(same, lambda p: p["i"])), covered)

    def repeats(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bind(pairs, starts_of))

    def windows(h: Column) -> Column:
        span = F.transform(
            F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return F.when(F.size(h) < window, F.lit(0)).otherwise(_bind(span, repeats))

    return _bind(F.transform(word_array, lambda w: F.xxhash64(w)), windows)


def normal_line(line: Column) -> Column:
    lowered = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.trim(F.regexp_replace(lowered, SPACE, " "))


def base_counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of the base rules; one narrow pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select(*keep, text.alias("_t"), words(F.col(text_col)).alias("_w"), lines.alias("_l"))
    return read.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"))


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT,
    max_docs: int = MAX_DOCS,
) -> DataFrame:
    """One row per document: id, base counts, ``base_failed``, ``kept``, ``left_share`` of its words, ``cleaned`` text."""
    key = ["_id", "_host", "_text_hash"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(
        F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.xxhash64(text).alias("_text_hash"),
        F.col(text_col).alias("_text"))
    counts = base_counts(named, "_text", [*key, "_text"]).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT))

    lines = Scratch(docs.sparkSession, "quality").write(
        named.select("_host", "_text_hash", F.explode(F.split(F.coalesce("_text", F.lit("")), "\n")).alias("line"))
        .where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
        .select("_host", "_text_hash", F.xxhash64(normal_line(F.col("line"))).alias("line")).distinct(), "lines")
    held = lines.groupBy("_host", "line").agg(F.count("*").alias("n"))
    hosts = named.select("_host", "_text_hash").distinct().groupBy("_host").agg(F.count("*").alias("host_texts"))
    common = (
        held.where(F.col("n") >= min_docs).alias("c").join(hosts.alias("h"), F.col("c._host").eqNullSafe(F.col("h._host")))
        .where(F.col("n") > F.least(F.col("host_texts") * max_share, F.lit(float(max_docs))))
        .select(F.col("c._host").alias("common_host"), F.col("line").alias("common_line"), F.lit(True).alias("common")))
    marks = lines.join(
        common, (F.col("line") == F.col("common_line")) & F.col("_host").eqNullSafe(F.col("common_host"))).groupBy(
        "_host", "_text_hash").agg(F.collect_set("line").alias("common_lines"))

    a, b = counts.alias("a"), marks.alias("b")
    joined = a.join(b, (F.col("a._text_hash") == F.col("b._text_hash")) & F.col("a._host").eqNullSafe(F.col("b._host")), "left")
    own = F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("common_lines", F.xxhash64(normal_line(x))))
    cleaned = F.when(F.col("common_lines").isNull(), F.col("_text")).otherwise(F.array_join(own, "\n"))
    share = F.when(F.col("n_words") == 0, 0.0).when(F.col("common_lines").isNull(), 1.0).otherwise(
        F.size(words(F.col("cleaned"))) / F.col("n_words"))
    return joined.withColumn("cleaned", cleaned).withColumn("left_share", share).select(
        F.col("a._id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("left_share") >= min_left)).alias("kept"), "left_share", "cleaned")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
