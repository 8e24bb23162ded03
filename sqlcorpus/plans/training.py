"""What a training run starts from: a stored dataset, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqlcorpus.operators.split import EVAL_CAP, TEST, TEST_SHARE, eval_rows, train_test_split
from sqlcorpus.plans.templates import ROW_KEY
from sqlcorpus.sources.tables import load_dataset_by_name


def _stored(spark: SparkSession, display_name: str, database: str | None) -> DataFrame:
    df = load_dataset_by_name(spark, display_name, database)
    if ROW_KEY not in df.columns:
        raise ValueError(f"{display_name!r} is stored without {ROW_KEY}, see create_datasets(keyed=True)")
    return df


def split_stored_dataset(
    spark: SparkSession, display_name: str, seed: int = 0, share: float = TEST_SHARE, database: str | None = None
) -> DataFrame:
    """A stored dataset with the side of each row. The border is searched over the stored keys alone."""
    return train_test_split(_stored(spark, display_name, database), ROW_KEY, seed, share)


def training_sets(
    spark: SparkSession, display_name: str, seed: int = 0, share: float = TEST_SHARE, cap: int = EVAL_CAP, database: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The training rows, and at most ``cap`` rows of the test side to evaluate on."""
    df = _stored(spark, display_name, database)
    sides = train_test_split(df, ROW_KEY, seed, share, "_side")
    return sides.filter(sides["_side"] != TEST).drop("_side"), eval_rows(df, ROW_KEY, seed, share, cap)
