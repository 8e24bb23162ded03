"""Comparing answers with golden ones, and scores with losses."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus.functions import sql_text
from sqlcorpus.operators.normalize import column
from sqlcorpus.operators.ordering import descending_rank


def score_prediction(expected: Column, accepted: Column, predicted: Column, fold_case: bool) -> Column:
    """Whether the prediction is the expected or the other accepted statement."""
    answer = sql_text(predicted, fold_case)
    hit = (answer == sql_text(expected, fold_case)) | F.coalesce(
        answer == sql_text(accepted, fold_case), F.lit(False)
    )
    return F.coalesce(hit, F.lit(False))


def prediction_match(golden: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per model: answers, strict and case-folded matches, and their shares of all tests.

    A test that a model did not answer is one it missed.
    """
    tests = golden.agg(F.count_distinct("test_id")).scalar()
    judged = predictions.join(golden, "test_id").select(
        "model",
        *(
            score_prediction(F.col("expected"), F.col("accepted"), F.col("sql"), fold).cast("long").alias(name)
            for name, fold in (("strict", False), ("folded", True))
        ),
    )
    return judged.groupBy("model").agg(
        F.count(F.lit(1)).alias("answers"),
        F.sum("strict").alias("strict"), F.sum("folded").alias("folded"),
    ).select("*", *((F.col(name) / tests).alias(f"{name}_rate") for name in ("strict", "folded")))


def resultset_diff(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Rows the two results do not share, as multisets, columns matched by place.

    One signed count per distinct row replaces two set differences: one shuffle,
    and repeated rows collapse before it. Empty output means equal results.
    """
    if len(expected.columns) != len(got.columns):
        raise ValueError("results of different width")
    names = expected.columns
    signed = expected.withColumn("_copies", F.lit(1).cast("long")).union(
        got.toDF(*names).withColumn("_copies", F.lit(-1).cast("long"))
    )
    left = signed.groupBy(*map(column, names)).agg(F.sum("_copies").alias("_copies"))
    return left.filter("_copies <> 0").select(
        *map(column, names),
        F.greatest(F.col("_copies"), F.lit(0)).alias("missing"),
        F.greatest(-F.col("_copies"), F.lit(0)).alias("surplus"),
    )


def same_result(expected: DataFrame, got: DataFrame) -> bool:
    return resultset_diff(expected, got).isEmpty()


def score_totals(scores: DataFrame, criteria: list[str]) -> DataFrame:
    """One row per model: a column per criterion and their total."""
    wide = scores.groupBy("model").pivot("criterion", criteria).agg(F.sum("score"))
    points = [F.coalesce(column(c), F.lit(0)) for c in criteria]
    return wide.withColumn("total", reduce(add, points))


def leaderboard(scores: DataFrame, criteria: list[str]) -> DataFrame:
    """The totals with each model's place."""
    return descending_rank(score_totals(scores, criteria), "total", "place").select(
        "model", *map(column, criteria), "total", "place"
    )


def score_vs_loss(totals: DataFrame, summary: DataFrame) -> DataFrame:
    """Totals beside losses; a model that was never trained here has no loss."""
    runs = summary.select(F.col("name").alias("model"), column("eval/loss").alias("loss"))
    return totals.select("model", "total").join(runs, "model", "left")


def registry_names(models: DataFrame) -> DataFrame:
    """Registered models by the short name the score sheets use (owner prefix dropped)."""
    return models.withColumn("model", F.substring_index("name", "/", -1))
