"""URL filter: rules first, then a Bloom filter cascade that answers list membership exactly.

Level 1 encodes the listed keys. Level 2 encodes the keys of the universe that pass level 1 without being listed, level 3
the listed keys that pass level 2, and so on until a level has no false positive. As the universe is complete, the number
of levels that a key passes in a row decides its membership without error: odd means listed. The levels are one array of
64-bit words, given to the plan as a scalar subquery, so judging a table needs no join and no shuffle.

Size: level 1 takes ``bits`` bits a listed key and the later ones shrink by a constant factor, so the array is bounded by
about ``2 * bits`` bits a listed key. The build checks it against ``max_bytes``; a longer list is answered by a left
join with the keys instead, with the same rows.

Defined results: a NULL url, or one without ``://``, has an empty host and path and fits no rule; its key is empty and is
judged like any other. Repeated rows are judged alike. An empty list or table allows what no rule blocks. Columns of the
input other than ``id_col`` and ``url_col`` are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, table

# (verdict, host, path)
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
BITS, PROBES = 8, 4
MAX_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as host and path, and its verdict; NULL where none fits."""
    name = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """Bit positions of a key in a level, one per probe."""
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def _bit_array(words: DataFrame) -> Column:
    """The stored words (word, bits) as one array in the plan, by a scalar subquery."""
    return words.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("b")).scalar()


def _passes(array: Column, key: Column, level: int, first: int, bits: int) -> Column:
    """Whether all bits of a key are set in a level that begins at array position ``first``."""
    out = F.lit(True)
    for p in _positions(key, level, bits):
        word = F.get(array, (F.shiftright(p, 6) + first).cast("int"))
        out = out & (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


@dataclass(frozen=True)
class Cascade:
    """``words`` is a stored table (word, bits); ``levels`` gives each level's first word and number of bits."""

    words: DataFrame
    levels: tuple[tuple[int, int], ...]

    def contains(self, key: Column) -> Column:
        """True for the keys that were listed; exact for every key of the universe."""
        if not self.levels:
            return F.lit(False)
        array = _bit_array(self.words)
        inside = None
        # From the last level inwards: pass level 1, and not (pass level 2, and not (...)).
        for level in reversed(range(len(self.levels))):
            passed = _passes(array, key, level, *self.levels[level])
            inside = passed if inside is None else passed & ~inside
        return inside


def build_cascade(keys: DataFrame, scratch: Scratch, bits_per_key: int = BITS, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """Cascade over a frame (key, listed) with one row per key; None when it would pass ``max_bytes``.

    Every level is two narrow passes over what is left: set the bits of the level's keys, then keep the other side's false
    positives. Bits meet by bit_or with partial aggregation, so a word never has more rows than there are tasks.
    """
    spark = keys.sparkSession
    encode, other = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
    left = encode.count()
    levels, parts, first = [], [], 0
    while left:
        level, bits = len(levels), max(64, math.ceil(left * bits_per_key / 64) * 64)
        if (first * 64 + bits) / 8 > max_bytes:
            return None
        set_bits = (
            encode.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("id"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")))
        # Every word is present, so that a position is an array index.
        part = scratch.write(spark.range(0, bits // 64).join(set_bits, "id", "left").select(
            F.col("id").alias("word"), F.coalesce("bits", F.lit(0)).alias("bits")), f"level{level}")
        wrong = scratch.write(other.where(_passes(_bit_array(part), F.col("key"), level, 0, bits)), f"wrong{level}")
        levels.append((first, bits))
        parts.append(part.select((F.col("word") + first).alias("word"), "bits"))
        first += bits // 64
        encode, other, left = wrong, encode, wrong.count()
    if not parts:
        return Cascade(spark.range(0).select(F.col("id").alias("word"), F.col("id").alias("bits")), ())
    words = parts[0]
    for part in parts[1:]:
        words = words.unionAll(part)
    return Cascade(words, tuple(levels))


def judge(
    pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
    bits_per_key: int = BITS, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict and ``listed``. ``listed`` has a column ``key`` (host + path)."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    marks = split.select(key.alias("key"), F.lit(False).alias("listed")).unionAll(
        listed.select("key", F.lit(True).alias("listed")).where("key IS NOT NULL"))
    keys = scratch.write(marks.groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    cascade = build_cascade(keys, scratch, bits_per_key, max_bytes)
    if cascade is None:
        judged = split.withColumn("key", key).join(keys.where("listed"), "key", "left").withColumn(
            "on_list", F.coalesce("listed", F.lit(False)))
    else:
        judged = split.withColumn("on_list", cascade.contains(key))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select(
        id_col, "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("on_list"), "block").otherwise("allow")).alias("verdict"),
        F.col("on_list").alias("listed"))


# Pages with runs of symbols are the list: every spelling of their address (scheme, query, fragment) is blocked.
JUNK = r"(###|\*\*\*|%%%|&&&|\$\$\$)"


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = host_and_path(F.col("url"))
    listed = pages.where(F.col("html").rlike(JUNK)).select(F.concat(host, path).alias("key")).distinct()
    return judge(pages, listed)


ORACLE_SQL = r"""
WITH t AS (
  SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), s AS (
  SELECT page_id, html, translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM t
), listed AS (
  SELECT DISTINCT host || path AS key FROM s WHERE regexp_matches(html, '(###|\*\*\*|%%%|&&&|\$\$\$)')
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    host || path IN (SELECT key FROM listed) AS listed FROM s
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
