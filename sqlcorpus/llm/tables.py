"""Staged tables, row identity and column names shared by the operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlcorpus.session import staging_root

WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here, on files every executor sees.

    Spark drops the shuffle files behind a frame once the driver has let go of it, so the driver
    is asked to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts stay small where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def text_key(column: str = "text") -> Column:
    """Tells apart rows that share an id; rows alike in id and text are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")), F.col(column).isNull())


ID = ["no_id", "doc_id", "key"]


def identified(docs: DataFrame) -> DataFrame:
    """``no_id``, ``doc_id`` (0 where null, so that it stays an integer in pandas), ``key``, ``text``."""
    return docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
                       text_key().alias("key"), F.col("text").alias("text"))


def given_id(no_id: str = "no_id", doc_id: str = "doc_id") -> Column:
    return F.when(~F.col(no_id), F.col(doc_id)).alias(doc_id)


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns whose names the operator does not use itself (its own columns win)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
