"""The operators as queries over whole tables: name -> (spark, directory of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.llm import chat_format, divergence, filter_audit, mixing, quality_rules, sharding, url_filter, warc
from auditmill.llm.bpe import encode_digests
from auditmill.llm.decontaminate import find_leaks
from auditmill.llm.jaccard_join import jaccard_components
from auditmill.llm.oracles import LANGUAGE, ORACLES
from auditmill.llm.suffix_dedup import remove_repeats
from auditmill.llm.token_counts import document_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(table(spark, sf_dir, "documents"))


#: A conversation whose texts are made of the template's control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(made)
    return chat_format.digests(chat_format.format_chats(turns))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by their own content: bad if the html declares another language than English. Rules are mined from LABELLED of them at most."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    said = F.nullif(F.regexp_extract("html", LANGUAGE, 1), F.lit(""))
    return url_filter.judge(pages, url_filter.sample(pages.select("url", (~F.lower(said).startswith("en")).alias("bad"))))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), F.size("positions").alias("copies"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_hash_tree_sharding, op2_separator_scan, op3_chat_format, op4_byte_bpe, op5_ngram_jaccard_join, op6_suffix_dedup, op7_quality_rules, op8_decontamination, op9_url_filter, op10_warc, op11_source_divergence, op12_curriculum_mix, op13_filter_interactions)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
