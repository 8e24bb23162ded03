"""Readers for the four file formats. Text formats are read as text, so values keep their spelling.

Paths are names, not patterns.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sqlcorpus.operators.normalize import column
from sqlcorpus.schemas import CSV_NA_TOKENS, shielded
from sqlcorpus.sources.json_arrays import array_elements, stage_as_lines
from sqlcorpus.sources.paths import check_all_read, decoded, literal, literals
from sqlcorpus.sources.place import PROVENANCE, with_provenance


def _finish(df: DataFrame, provenance: bool) -> DataFrame:
    return with_provenance(df) if provenance else df


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    na_values: tuple[str, ...] = CSV_NA_TOKENS,
    multi_line: bool = True,
    provenance: bool = False,
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """CSV files that share one header, ``columns`` if it is known. Cells holding an NA token are null.

    ``multi_line`` allows line ends in quoted cells but makes a file one task; for
    very large files see ``large_csv``, or turn it off if there are no such cells.
    """
    if columns is None:
        columns = _only(csv_headers(spark, paths).values())
    raw = (
        spark.read.schema(text_schema(list(columns))).option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').csv(literals(paths))
    )
    df = _finish(raw, provenance)
    absent = ("", *na_values)
    names = [shielded(name) for name in columns] if provenance else columns
    cells = [F.when(~column(name).isin(*absent), column(name)).alias(name) for name in names]
    return df.select(*cells, *(PROVENANCE if provenance else ()))


def _only(found: Iterable[tuple[str, ...]]) -> tuple[str, ...]:
    """The columns that all files have in common, in order."""
    different = set(found)
    if len(different) != 1:
        raise ValueError(f"files of one scan must share their columns, found {sorted(different)}")
    return different.pop()


@contextmanager
def _one_file_a_task(spark: SparkSession) -> Iterator[None]:
    """Within it, a scan does not put several files into one task."""
    cost, most = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, spark.conf.get(most))
    try:
        yield
    finally:
        spark.conf.set(cost, before)


def _first_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path and first record (lines until its quotes are closed) of the file whose start the task reads."""
    path, lines = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"]:
                return
            path = row["path"]
            if lines or row["value"].strip("\r"):
                lines.append(row["value"])
            if lines and sum(line.count('"') for line in lines) % 2 == 0:
                yield pa.RecordBatch.from_pydict({"path": [path], "header": ["\n".join(lines)]})
                return
    if lines:
        raise ValueError(f"the header of {path} has an open quote")


def csv_headers(spark: SparkSession, paths: str | list[str]) -> dict[str, tuple[str, ...]]:
    """Column names of every CSV file, by one job that reads the first lines of each. Files without any are left out."""
    lines = spark.read.option("lineSep", "\n").text(literals(paths)).select(
        "value", decoded("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    with _one_file_a_task(spark):
        rows = lines.mapInArrow(_first_record, "path string, header string").collect()
    return {row["path"]: _names(row["header"]) for row in rows}


def _names(header: str) -> tuple[str, ...]:
    """The cells of a header; blank and repeated ones get their place as a name, or as its end."""
    (cells,) = csv.reader([header.rstrip("\r").removeprefix("﻿").replace("\r\n", "\n").replace("\n", "\0")], strict=False)
    cells = [cell.replace("\0", "\n") for cell in cells]
    folded = [cell.lower() for cell in cells]
    return tuple(
        f"_c{i}" if not cell else f"{cell}{i}" if folded.count(cell.lower()) > 1 else cell for i, cell in enumerate(cells))


def _json_records(spark: SparkSession, paths: str | list[str], fmt: str) -> DataFrame:
    """One JSON object text per row, with its place in the file set."""
    if fmt == "json":
        return array_elements(spark, paths)
    return with_provenance(spark.read.text(literals(paths)))


def json_columns(spark: SparkSession, paths: str | list[str], fmt: str) -> dict[str, tuple[str, ...]]:
    """Column names of each JSON file in the order its keys first occur.

    Spark's own inference sorts names, which would break every rule that goes by
    place. Only the first place of each key, one row per file and key, leaves the
    executors.
    """
    keys = _json_records(spark, paths, fmt).select(
        "_path", "_block", "_row", F.posexplode(F.json_object_keys("value")).alias("_at", "_key"))
    first = keys.groupBy("_path", "_key").agg(F.min(F.struct("_block", "_row", "_at")).alias("_first"))
    ordered = first.groupBy("_path").agg(F.sort_array(F.collect_list(F.struct("_first", "_key"))).alias("_keys"))
    rows = ordered.select("_path", F.col("_keys._key").alias("names")).collect()
    return {row["_path"]: tuple(row["names"]) for row in rows}


def read_json(
    spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, provenance: bool = False
) -> DataFrame:
    """Files holding one JSON array of records each, split between tasks; columns in document order.

    The records are first written as lines, see ``stage_as_lines``.
    """
    columns = list(_only(json_columns(spark, paths, "json").values()) if columns is None else columns)
    place = T.StructType.fromDDL("_path string, _file string, _block long, _row long, _lane int")
    schema = T.StructType([T.StructField("value", text_schema(columns)), *place])
    rows = spark.read.schema(schema).json(literal(stage_as_lines(spark, paths)), mode="FAILFAST")
    cells = [F.col("value")[name].alias(shielded(name) if provenance else name) for name in columns]
    return rows.select(*cells, *(PROVENANCE if provenance else ()))


def read_jsonl(
    spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, provenance: bool = False
) -> DataFrame:
    """Files of one JSON record per line; columns in the order keys first occur."""
    columns = list(_only(json_columns(spark, paths, "jsonl").values()) if columns is None else columns)
    df = spark.read.schema(text_schema(columns)).json(literals(paths), mode="FAILFAST")
    return _finish(df, provenance)


def parquet_columns(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(spark.read.parquet(*literals(path)).columns)


def read_parquet(spark: SparkSession, paths: str | list[str], provenance: bool = False) -> DataFrame:
    return _finish(spark.read.parquet(*literals(paths)), provenance)


__all__ = [
    "PROVENANCE", "check_all_read", "csv_headers", "decoded", "json_columns", "parquet_columns", "read_csv", "read_json",
    "read_jsonl", "read_parquet", "text_schema", "with_provenance",
]
