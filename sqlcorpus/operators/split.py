"""Exact, repeatable train/test split in hash order.

Rows are ordered by the md5 of their key and a seed. The test side is the first
``ceil(share * n)`` rows of that order. The order is never built: counts by the first four digits of
the md5 tell in which of 65,536 buckets the border lies, counts by the next four in which part of that
bucket, and what is left, one of four billion parts, is a handful of keys. Each row is then compared
with the border where it stands. The wide rows are never shuffled, and neither search reads more than keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TEST_SHARE = 0.3
EVAL_CAP = 1000
TRAIN, TEST = "train", "test"
DIGITS = 4  # hexadecimal digits of a bucket


def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key, F.lit(f"#{seed}")))


def _bucket(digest: str, level: int) -> Column:
    return F.substring(digest, level * DIGITS + 1, DIGITS)


def _border(keys: DataFrame, seed: int, wanted: Callable[[Column], Column]) -> Column:
    """Greatest ``(digest, key)`` among the first ``wanted(n)`` rows, as a scalar struct. ``keys`` has the column ``_key``."""
    keys = keys.select(F.col("_key").cast("string").alias("_key")).withColumn("_digest", _digest(F.col("_key"), seed))
    sizes = keys.groupBy(_bucket("_digest", 0).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per bucket
    counted = sizes.select(
        "_bucket", "_n", F.sum("_n").over(W.orderBy("_bucket")).alias("_upto"), F.sum("_n").over(W.partitionBy()).alias("_all"),
    ).withColumn("_wanted", wanted(F.col("_all")))
    nth = F.col("_wanted") - (F.col("_upto") - F.col("_n"))
    edge = counted.filter("_wanted > _upto - _n AND _wanted <= _upto").select(
        F.struct("_bucket", nth.alias("_nth")).alias("edge")
    ).scalar()
    inside = keys.filter(_bucket("_digest", 0) == edge.getField("_bucket"))
    parts = inside.groupBy(_bucket("_digest", 1).alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("_digest", "_key"))).alias("_rows"))
    placed = parts.select("_rows", F.sum("_n").over(W.orderBy("_part")).alias("_upto"), "_n")
    left = edge.getField("_nth") - (F.col("_upto") - F.col("_n"))
    found = placed.filter((left > 0) & (left <= F.col("_n")))
    return found.select(F.get("_rows", (left - 1).cast("int")).alias("border")).scalar()


def _up_to_border(df: DataFrame, key: str, seed: int, wanted: Callable[[Column], Column], keys: DataFrame | None) -> Column:
    known = df.select(F.col(key).alias("_key")) if keys is None else keys.select(F.col(keys.columns[0]).alias("_key"))
    here = F.struct(_digest(F.col(key), seed).alias("_digest"), F.col(key).alias("_key"))
    return F.coalesce(here <= _border(known, seed, wanted), F.lit(False))


def _test_rows(share: float) -> Callable[[Column], Column]:
    return lambda n: F.ceil(F.lit(share) * n)


def train_test_split(
    df: DataFrame, key: str, seed: int = 0, share: float = TEST_SHARE, name: str = "side", keys: DataFrame | None = None
) -> DataFrame:
    """Add the side of every row; ``key`` is a unique, non-null text.

    ``keys`` may name the same keys by a cheaper plan, one column: the border is then searched there.
    """
    in_test = _up_to_border(df, key, seed, _test_rows(share), keys)
    return df.withColumn(name, F.when(in_test, TEST).otherwise(TRAIN))


def eval_rows(
    df: DataFrame, key: str, seed: int = 0, share: float = TEST_SHARE, cap: int = EVAL_CAP, keys: DataFrame | None = None
) -> DataFrame:
    """The first ``min(cap, test size)`` rows of the test side."""
    def capped(n: Column) -> Column:
        return F.least(F.lit(cap).cast("long"), _test_rows(share)(n))

    return df.filter(_up_to_border(df, key, seed, capped, keys))


def split_counts(sides: DataFrame, name: str = "side") -> DataFrame:
    return sides.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"))
