"""The corpus pipeline: quality, near duplicates, benchmark passages, private values, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe.llm import bpe, decontaminate, near_duplicates, pseudonyms, quality
from speechframe.llm.common import shared_dir, table

def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good: of high quality and not toxic."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id; of rows that are equal in id and text, one."""
    return near_duplicates.representatives(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def replace_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of private values."""
    replaced = pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark))
    return replaced.withColumn("n_chars", F.when(F.size("private_kinds") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).drop("private_kinds")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and token_ids (little-endian unsigned 32-bit) of every document, and whether decoding returns its text."""
    coded = bpe.encode(docs, check=True)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", same.alias("same_text"))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_passages),
    ("PII", replace_private_values),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier and the transducer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/speechframe-stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
