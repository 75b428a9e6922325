"""Corpus pipeline: documents -> quality rules -> near copies -> repeated passages -> benchmark leaks -> token ids.

Each stage gets what the one before it kept, written as Parquet and read again. All but the last return the columns of documents. A stage's
function takes (spark, docs, sf_dir). Rows without a doc_id pass like others, as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.llm import bpe, decontaminate, jaccard_join, quality_rules, shared, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that all quality rules pass."""
    return quality_rules.passing(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; those that lose their whole text go. A character that a cut splits goes whole."""
    columns = docs.columns
    cut = suffix_dedup.remove_repeats(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text"))).alias("_row")), extra=("_row",), characters=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes"))).withColumn("text", F.col("kept").cast("string"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    return left.select(*(changed.alias(c) if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`") for c in columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digest of the text that the ids decode to."""
    return bpe.encode_checked(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", benchmark_leaks), ("byte-level BPE", token_ids)]

#: SQL has no BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents. A stage's own tables go when it is written, and its result when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with shared.scope(spark) as kept:
            out = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(out)
        if k:
            shared.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
