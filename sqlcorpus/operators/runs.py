"""Run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sqlcorpus.functions import duration_text, run_label, scale_step
from sqlcorpus.operators.normalize import column

SUMMARY_COLUMNS = ("name", "eval/loss", "train/learning_rate", "_step")


def label_runs(records: DataFrame) -> DataFrame:
    """Add ``name``: the run with its project."""
    return records.withColumn("name", run_label(F.col("run"), F.col("project")))


def allowed_only(records: DataFrame, allowed: DataFrame, key: str = "name") -> DataFrame:
    """Records whose ``key`` is on the allow-list."""
    return records.join(allowed.select(key), key, "left_semi")


def drop_null_loss(records: DataFrame, loss: str = "eval/loss") -> DataFrame:
    return records.filter(column(loss).isNotNull())


def run_summary(
    records: DataFrame, allowed: DataFrame | None = None, key: str = "name"
) -> DataFrame:
    """Name, last loss, learning rate, scaled step and running time of the finished runs."""
    if allowed is not None:
        records = allowed_only(records, allowed, key)
    return drop_null_loss(records).select(
        "name", column("eval/loss"), column("train/learning_rate"),
        scale_step(F.col("_step")).alias("_step"),
        duration_text(F.col("_runtime")).alias("runtime_hms"),
    )
