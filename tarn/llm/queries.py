"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import ann, bpe, hard_negatives, jaccard_join, lexical, minhash, mixing, pii, quality_model, quality_rules, sharding, token_files, toxicity
from tarn.llm.common import table

WORD_TOKENIZER, BYTE_TOKENIZER, END_ID = "word_bpe_49k.json", "byte_bpe_50k.json", 2


def tokenizer_json(name: str) -> str:
    """The vocabulary file's content, read on the driver and sent along."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("_probability", 6).alias("probability"), F.col("_drawn").alias("drawn"))


def op1_mixing_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.repeated(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("_expected", 6).alias("expected"), F.col("_copies").alias("copies"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), tokenizer_json(WORD_TOKENIZER), END_ID)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_json(BYTE_TOKENIZER))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op1_mixing_repeated": op1_mixing_repeated,
    "op2_token_files": op2_token_files,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_quality_model": op6_quality_model,
    "op7_sharding": op7_sharding,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_ann": op10_ann,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.oracle(), "op11_jaccard_join": jaccard_join.oracle(), "op12_hard_negatives": hard_negatives.oracle(), "op13_lexical_search": lexical.oracle()}
