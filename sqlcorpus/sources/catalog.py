"""JSON documents that describe sources, tests, answers and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sqlcorpus.schemas import GOLDEN_TESTS, MODELS, PREDICTIONS, PROVIDER


def read_manifest(spark: SparkSession, path: str, provider: str = "huggingface-datasets") -> DataFrame:
    """One row with the ``provider`` entry of a source manifest."""
    schema = T.StructType([T.StructField(provider, PROVIDER)])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.col(f"`{provider}`").alias("provider"))


def parse_provider(text: Column) -> Column:
    """A manifest entry held as JSON text."""
    return F.from_json(text, PROVIDER)


def source_catalog(manifests: DataFrame) -> DataFrame:
    """One row per file to fetch: where it is and the name it is kept under."""
    sets = manifests.select("provider.base_url", F.explode("provider.datasets").alias("d"))
    files = sets.select("base_url", F.col("d.name").alias("name"), F.explode("d.files").alias("file"))
    # the kept name uses the second part of the file's path, if it has one
    parts = F.split("file", "/")
    short = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.col("file"))
    return files.select(
        "name", "file",
        F.concat("base_url", F.lit("/"), "name", F.lit("/resolve/main/"), "file", F.lit("?download=true")).alias("url"),
        F.concat(F.substring_index("name", "/", -1), F.lit("-"), short).alias("local_name"),
    )


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def golden_tests(documents: DataFrame, json: str = "value") -> DataFrame:
    """Test id, question, table definitions and right answers from ``{id: {...}}`` documents."""
    tests = documents.select(F.explode(F.from_json(json, GOLDEN_TESTS)).alias("test_id", "t"))
    return tests.select("test_id", "t.input", "t.context", "t.expected", "t.accepted")


def predictions(documents: DataFrame, json: str = "value") -> DataFrame:
    """Model, test id and statement from ``{model: {id: sql}}`` documents."""
    models = documents.select(F.explode(F.from_json(json, PREDICTIONS)).alias("model", "answers"))
    return models.select("model", F.explode("answers").alias("test_id", "sql"))


def models(documents: DataFrame, json: str = "value") -> DataFrame:
    """Registered models from an array of records."""
    return documents.select(F.inline(F.from_json(json, MODELS)))


def read_golden_tests(spark: SparkSession, path: str) -> DataFrame:
    return golden_tests(_documents(spark, path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return predictions(_documents(spark, path))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return models(_documents(spark, path))
