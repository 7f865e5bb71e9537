"""Corpus pipeline: language ID, quality, exact dedup, near-dedup, packing. Each stage works on all its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, for the documents they keep; the last returns one row a piece.

Defined cases: rows are told apart by doc_id and text, so of two different texts under one doc_id, or under none, each is
judged on its own; null text counts as empty and is rejected by the language stage (called alone, the stages behind it keep
one empty document, and all of those without words as far as near copies go); an empty table gives no rows; other columns
are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, near_dedup, packing, quality
from tidemark.llm.common import ascii_lower, documents, ship, stash

#: A document is rejected by the language stage if its prediction is `und` or surer of no language than this.
LEAST_LANGUAGE = 0.4
#: Similarity in percent from which documents count as near copies.
NEAR = 80


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    langs, net = language_id.learn(docs)
    got = language_id.identify(docs, langs, net, "__")
    return got.where((F.col("__lang_pred") != "und") & (F.col("__score") >= LEAST_LANGUAGE)).select(*docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, "__").where(F.col("__score") >= quality.REJECT).select(*docs.columns)


def pair(text_key) -> Column:
    """Names a row by its doc_id, if any, and its text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text_key.cast("string"))


def keep_one_exact_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of equal texts; of rows that repeat both, one."""
    found = exact_dedup.exact_dedup(docs).groupBy(pair(F.col("text_sha256")).alias("__pair")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    odd = stash(found.where(~F.col("__kept") | (F.col("__rows") > 1)), "exact")
    own = docs.withColumn("__pair", pair(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)))
    judged = own.join(odd.hint("merge"), "__pair", "left")  # grows with the input: the same plan at every size
    again = judged.where(F.col("__kept") & (F.col("__rows") > 1)).dropDuplicates(["__pair"])
    return judged.where(F.col("__kept").isNull()).unionByName(again).select(*docs.columns)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies."""
    dropped = near_dedup.near_dedup(docs, percent=NEAR).where(~F.col("kept")).select(pair(F.col("text_id")).alias("__pair")).hint("merge")
    return docs.withColumn("__pair", pair(near_dedup.text_id(F.col("text")))).join(dropped, "__pair", "left_anti").select(*docs.columns)


def pack_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language", keep_known_language),
    ("quality", keep_good_quality),
    ("exact_dedup", keep_one_exact_copy),
    ("near_dedup", keep_one_near_copy),
    ("packing", pack_into_sequences),
]

#: Trained networks and the packing search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs
