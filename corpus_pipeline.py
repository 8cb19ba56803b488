"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Written
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.packing import pack
from tidemark.llm.suffixes import without_repeats
from tidemark.llm.toxicity import fit, learnable, score_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3; labels that may be learned from are those of the operator's query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, fit(docs, learnable(labels))).where("score < 0.3").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest id; a row without an id stays only if no row of its group has one, and of rows that
    are level one stays. Texts without words are in no group and all stay."""
    keep = Written(spark)
    rows = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), keep).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = rows.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    first = keep(first.select("first._row"), "first")
    keep.only("rows", "first")
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of 200 bytes or more; the first copy stays."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, the last turn of a source's budget cut to its words."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences, with their token ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("packing", packing)]
#: The toxicity model and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep, docs = Written(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


