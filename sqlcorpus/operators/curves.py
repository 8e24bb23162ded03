"""Evaluation-loss curves: wide to long, axis, statistics, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sqlcorpus.functions import run_label, scale_step
from sqlcorpus.operators.normalize import column
from sqlcorpus.operators.ordering import CUTS, before, position_in_many, sliced
from sqlcorpus.schemas import LOSS_BANDS, LOSS_SUFFIX

QUARTILES = (0.25, 0.5, 0.75)


def unpivot_curves(
    wide: DataFrame, keys: list[str], project: Column | None = None, suffix: str = LOSS_SUFFIX
) -> DataFrame:
    """One row per run and step from a sheet with one column per run.

    Only columns whose name ends with ``suffix`` are curves. With ``project`` the
    run is labelled; ``keys`` are carried along. Empty cells are dropped.
    """
    curves = [name for name in wide.columns if name.endswith(suffix)]
    long = wide.unpivot([column(k) for k in keys], [column(c) for c in curves], "run", "loss")
    long = long.filter(F.col("loss").isNotNull())
    if project is not None:
        return long.withColumn("run", run_label(F.col("run"), project))
    return long.withColumn("run", F.replace(F.col("run"), F.lit(suffix), F.lit("")))


def pivot_curves(curves: DataFrame, keys: list[str], runs: list[str]) -> DataFrame:
    """Wide form for the given runs; naming them keeps the width under control."""
    return curves.groupBy(*keys).pivot("run", runs).agg(F.first("loss"))


def curve_axis(curves: DataFrame, order: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """Add ``x``: the row's place in its run (from 1) times the evaluation interval."""
    place_key = F.col("step") if key is None else key
    placed = position_in_many(curves, ["run"], place_key, order or ["step"], "_at")
    return placed.withColumn("x", scale_step(F.col("_at") + 1)).drop("_at")


def describe_runs(curves: DataFrame, cuts: int = CUTS) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max of each run's losses.

    The losses are folded to one row per run and loss, with its count, and all else comes from these rows
    (whose shuffle Spark uses again). Quartiles are looked up in the slices that hold them, so that no run is sorted as a whole.
    """
    losses = curves.select("run", "loss").filter(F.col("loss").isNotNull())
    folded = losses.groupBy("run", "loss").agg(F.count(F.lit(1)).alias("_same"))
    sums = folded.groupBy("run").agg(
        F.sum("_same").alias("n"), (F.sum(F.col("loss") * F.col("_same")) / F.sum("_same")).alias("mean"),
        F.min("loss").alias("min"), F.max("loss").alias("max"))
    # from the mean, as the difference of two large sums would be inexact
    away = folded.join(sums.select("run", "mean"), "run").groupBy("run").agg(
        F.sum(F.pow(F.col("loss") - F.col("mean"), 2) * F.col("_same")).alias("_squares"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_squares") / (F.col("n") - 1)))
    return sums.join(away, "run").join(_quartiles(folded, cuts), "run").select(
        "run", "n", "mean", std.alias("std"), "min", *(_quartile_name(q) for q in QUARTILES), "max")


def _quartile_name(q: float) -> str:
    return f"q{int(q * 100)}"


def _quartiles(folded: DataFrame, cuts: int) -> DataFrame:
    """Values at the ranks q * (n - 1), between two places by their distance."""
    cut = sliced(folded, F.col("loss"), cuts=cuts)
    pieces = cut.groupBy("run", "_slice").agg(F.sum("_same").alias("_rows"))
    placed = pieces.select(
        "run", "_slice", "_rows", before("_rows", ["run"], "_slice").alias("_start"), F.sum("_rows").over(W.partitionBy("run")).alias("_n"))

    def rank(q: float) -> Column:
        return F.lit(q) * (F.col("_n") - 1)

    ranks = F.array_distinct(F.array(*(side(rank(q)).cast("long") for q in QUARTILES for side in (F.floor, F.ceil))))
    here = F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_rows")))
    # at most six slices of a run
    wanted = placed.withColumn("_ranks", ranks).withColumn("_ranks", here).filter(F.size("_ranks") > 0)
    inside = cut.join(wanted, ["run", "_slice"]).withColumn("_at", F.col("_start") + before("_same", ["run", "_slice"], "loss"))
    own = F.filter("_ranks", lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_same")))
    found = inside.select("run", "_n", "loss", F.explode(own).alias("_rank"))

    def value(q: float) -> Column:
        low, high = (F.max(F.when(F.col("_rank") == side(rank(q)), F.col("loss"))) for side in (F.floor, F.ceil))
        return low + (high - low) * (rank(q) - F.floor(rank(q)))

    return found.groupBy("run", "_n").agg(*(value(q).alias(_quartile_name(q)) for q in QUARTILES)).drop("_n")


def runs_by_min(described: DataFrame) -> DataFrame:
    """Worst runs first."""
    return described.orderBy(F.col("min").desc(), "run")


def in_band(least: Column, bands: tuple = LOSS_BANDS) -> Column:
    """Bands a run's least loss belongs to, as an array; a border belongs to both sides."""
    members = []
    for band, low, high, closed in bands:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (least >= low)
        if high is not None:
            inside = inside & ((least <= high) if closed else (least < high))
        members.append(F.when(inside, F.lit(band)))
    return F.array_compact(F.array(*members))


def loss_bands(curves: DataFrame, bands: tuple = LOSS_BANDS) -> DataFrame:
    """One row per run and band by the run's least loss."""
    least = curves.groupBy("run").agg(F.min("loss").alias("min"))
    return least.select(F.explode(in_band(F.col("min"), bands)).alias("band"), "run", "min")


def band_curves(curves: DataFrame, band: int | None = None, bands: tuple = LOSS_BANDS) -> DataFrame:
    """The curves of the runs of one band, or of every band."""
    members = loss_bands(curves, bands).select("band", "run")
    if band is not None:
        members = members.filter(F.col("band") == band)
    return curves.join(members, "run")
