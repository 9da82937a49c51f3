"""A corpus pipeline over ``documents``: drop toxic documents, keep one of each near-duplicate group, sanitise personal data,
mix sources to target weights, pack into sequences. Every stage works on all rows that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, table
from panelcast.llm.mixture import mixed_texts
from panelcast.llm.near_dup import near_duplicates
from panelcast.llm.packing import pack
from panelcast.llm.sanitise import sanitised
from panelcast.llm.toxicity import reject_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model learns from ``labels``."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more: the one with the smallest id.

    Rows that repeat the chosen id and text are one document; the one with the smallest hash of its other columns stays.
    """
    found = near_duplicates(docs, percent=80).where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    kept = Scratch(spark, "pipeline").write(
        found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("times").alias("__times")), "kept")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(kept, (key == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    once = joined.where("__times = 1").select(docs.columns)
    again = joined.where("__times > 1").groupBy("__id", "__key").agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(again)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitised(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes of each document; a document may come twice."""
    return mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("mixture", mixed),
    ("packing", packed),
]

# Not expressible in SQL: the learned toxicity model, the seeded mixture and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
