"""Stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sqlcorpus.schemas import DATASET_PREFIX, DISPLAY_NAMES


def table_in(database: str | None, name: str) -> str:
    return f"{database}.{name}" if database else name


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def key_by_key(stored: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The rows of a table with buckets by the first of ``keys``, those of equal keys next to each other.

    Each bucket is read and sorted by one task, nothing is shuffled. Spark reads by buckets only below an operator that
    asks for the rows of a key in one task; a sort does not, their places in ``order`` do.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return stored.withColumn("_place", place).filter("_place > 0").drop("_place")


def list_datasets(spark: SparkSession, prefix: str = DATASET_PREFIX, database: str | None = None) -> list[str]:
    """Names of the tables and views that hold datasets; a view that hides a table counts once.

    With ``database`` those stored in it, and no temporary views.
    """
    found = spark.catalog.listTables(database, pattern=prefix + "*")
    return sorted({t.name for t in found if t.name.startswith(prefix) and not (database and t.isTemporary)})


def load_dataset_by_name(spark: SparkSession, display_name: str, database: str | None = None) -> DataFrame:
    """A dataset by the name people know it by."""
    if display_name not in DISPLAY_NAMES:
        raise KeyError(f"{display_name!r} is none of {sorted(DISPLAY_NAMES)}")
    return spark.table(table_in(database, DATASET_PREFIX + DISPLAY_NAMES[display_name]))
