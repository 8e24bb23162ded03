"""Table sinks. A table's name may have a database in front of it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from sqlcorpus.sinks.files import write_rows
from sqlcorpus.sources.tables import list_datasets, table_in


def open_store(spark: SparkSession, database: str, folder: str) -> str:
    """A database whose tables lie below ``folder``, made if it is not there; its name."""
    place = folder.replace("'", "\\'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{place}'")
    return database


def stored_name(name: str) -> str:
    """A name that a catalogue takes: other characters than letters, digits and underscores as ``_x20_``."""
    return re.sub(r"[^0-9A-Za-z_]", lambda m: f"_x{ord(m[0]):x}_", name.replace("_x", "_x5f_x"))


def replace_table(df: DataFrame, name: str) -> None:
    """Store a table, replacing an older one once the new one is written: a write that fails leaves the older one."""
    spark, aside = df.sparkSession, f"{name}__{uuid.uuid4().hex}"
    df.write.saveAsTable(aside)
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")


def create_table(df: DataFrame, name: str, overwrite: bool = False) -> None:
    """Store a new table; an existing one is an error unless overwriting is asked for."""
    if overwrite:
        replace_table(df, name)
    else:
        df.write.mode("errorifexists").saveAsTable(name)


def export_tables(
    spark: SparkSession, path: str, save: str = "jsonl", mode: str = "errorifexists", database: str | None = None
) -> list[str]:
    """Every stored dataset table as files below ``path``; returns the names."""
    names = list_datasets(spark, database=database)
    for name in names:
        write_rows(spark.table(table_in(database, name)), f"{path}/{name}", save, mode)
    return names
