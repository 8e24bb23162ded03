"""From raw documents to tokens: language ID, line dedup, near dedup, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcorpus.llm import langid, line_dedup, minhash, mixing, sentence_pieces
from sqlcorpus.llm.queries import held_out, piece_model
from sqlcorpus.session import staging_root


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those in no language that the model knows, go."""
    model = langid.train(docs, F.col("doc_id").isNotNull() & ~held_out())
    judged = langid.predict(docs.select(F.struct("*").alias("doc"), "text"), model)
    return judged.where(~F.col("rejected")).select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; ``n_chars`` follows the text."""
    cut = line_dedup.dedup_lines(docs.select(F.struct("*").alias("doc"), "doc_id", "text"))
    return cut.select(F.col("doc").withField("text", F.col("text")).withField("n_chars", F.length("text").cast("long")).alias("doc")).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with 80 per cent of their shingles in common or more, stays."""
    return minhash.drop_near_duplicates(docs, least=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their texts, the byte spans of each, and as text what the ids decode to."""
    return sentence_pieces.encode(docs, piece_model(), ("decoded",)).drop("text").withColumnRenamed("decoded", "text")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix),
    ("sentence_pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{staging_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# training, the draw and near-duplicate groups cannot be said in SQL; tests hold the stages against brute force
ORACLE_SQL = None
