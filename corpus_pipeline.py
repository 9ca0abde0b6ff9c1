"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, minhash, mixing, pii, quality_rules
from tarn.llm.common import checked_broadcast, table, written
from tarn.llm.queries import BYTE_TOKENIZER, tokenizer_json


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or the compression bands reject go."""
    return quality_rules.kept_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document of smallest doc_id stays.

    Repeated rows of one doc_id are one document, whose row of the smallest text stays; rows without a doc_id are
    nobody's copies. Only doc_ids are shuffled: those that go, and those that repeat, are few beside the texts and
    broadcast after a count, beyond it joined by shuffle.
    """
    found = written(minhash.near_duplicates(docs).select("doc_id", "kept").where("doc_id is not null"), "found")
    dropped = written(found.where("not kept").select("doc_id").distinct(), "dropped")
    repeated = written(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = docs.join(checked_broadcast(dropped), "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    repeated = checked_broadcast(repeated)
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redacted_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample toward the target weights of sources, languages and topics; cells with too few documents fall short."""
    return mixing.drawn_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text decoded from them."""
    return bpe.encoded(docs, tokenizer_json(BYTE_TOKENIZER), with_ids=True)


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]
#: zstandard, MinHash and BPE are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
