"""Exports of training runs: loss curves, run records, score sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sqlcorpus.functions import run_label, table_name
from sqlcorpus.schemas import CRITERIA, LOSS_SUFFIX
from sqlcorpus.sources.files import csv_headers, text_schema
from sqlcorpus.sources.paths import decoded, literals

RUN_RECORD = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("eval/loss", T.DoubleType()),
    T.StructField("train/learning_rate", T.DoubleType()),
    T.StructField("_step", T.LongType()),
    T.StructField("_runtime", T.DoubleType()),
])


def curve_source(spark: SparkSession, paths: list[str], skip: tuple[str, ...] = ("summary.csv",)) -> DataFrame:
    """Long curves (run, step, loss) of wide sheets, one project per file; runs are labelled with the file's stem.

    Sheets have headers of their own. All headers come from one job and all cells from one scan, by place;
    a row meets the header of its file, and each of its cells becomes a row.
    """
    sheets = [path for path in paths if path.endswith(".csv") and path.rsplit("/", 1)[-1] not in skip]
    headers = csv_headers(spark, sheets) if sheets else {}
    if not headers:
        return spark.createDataFrame([], "run string, step long, loss double")
    lacking = [path for path, names in headers.items() if "Step" not in names]
    if lacking:
        raise ValueError(f"no column Step in {sorted(lacking)}")
    width = max(map(len, headers.values()))
    raw = spark.read.schema(text_schema([f"c{i}" for i in range(width)])).option("header", True).option("quote", '"').option(
        "escape", '"').csv(literals(sheets))
    cells = raw.select(
        F.array(*raw.columns).alias("cells"), decoded("_metadata.file_path").alias("path"),
        table_name(decoded("_metadata.file_name")).alias("project"))
    # one row per sheet
    names = spark.createDataFrame(list(headers.items()), "path string, names array<string>")
    placed = cells.join(names, "path").select(
        F.get("cells", (F.array_position("names", F.lit("Step")) - 1).cast("int")).cast("long").alias("step"), "project",
        F.explode(F.arrays_zip("names", "cells")).alias("c"))
    losses = placed.filter(F.col("c.names").endswith(LOSS_SUFFIX) & F.col("c.cells").isNotNull())
    return losses.select(run_label(F.col("c.names"), F.col("project")).alias("run"), "step", F.col("c.cells").cast("double").alias("loss"))


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """Exported run summaries, one JSON object per line."""
    return spark.read.schema(RUN_RECORD).json(path)


def score_sheets(spark: SparkSession, paths: str | list[str], criteria: dict[str, str] | None = None) -> DataFrame:
    """(criterion, model, score) from one sheet per criterion, named by the file's stem."""
    pairs = [F.lit(part) for item in (criteria or CRITERIA).items() for part in item]
    sheets = spark.read.schema("_c0 INT, Model STRING, Score INT").csv(paths, header=True)
    stem = table_name(decoded("_metadata.file_name"))
    return sheets.select(
        F.coalesce(F.try_element_at(F.create_map(*pairs), stem), stem).alias("criterion"),
        F.col("Model").alias("model"), F.col("Score").alias("score"),
    )
