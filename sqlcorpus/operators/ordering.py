"""Exact positions and running totals that never put one whole group in one task.

A window over a hot group (or over the whole table) would sort all of it in a single task. Here the order
is first cut into slices of about equal numbers of rows. Keys are counted in cells that get wider
with the key, so that a far key takes no room from the others. The counts say how many rows lie before a
cell, and its own least and greatest key how far into it a row lies: that is about the row's place, and so its slice.
All counts are folded before they are shuffled; running totals over slices touch a bounded number of rows per group; and the rows themselves are only
ever sorted inside one slice. Where groups are many and mostly small, only those above ``HOT_ROWS``
are cut. Slices decide the spread of work, never the result. Everything is a pure
function of the data, so a lost executor's tasks give the same positions when run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CUTS = 1 << 16  # slices, at most
SLICE_ROWS = 1 << 12  # rows of a slice where there are not as many
HOT_ROWS = 1_000_000
# Cells: of each octave of the key's size, up to 2**64, so many. Hence no more than CELLS_PER_OCTAVE * 130.
CELLS_PER_OCTAVE = 1 << 10
OCTAVES = 64


def _cell(x: Column) -> Column:
    """Number of a key's cell; does not decrease with the key. Infinite keys and NaN (the greatest) have cells of their own."""
    size = F.least(F.log1p(F.abs(x)) / F.lit(0.6931471805599453), F.lit(float(OCTAVES)))
    number = (F.signum(x) * F.floor(size * CELLS_PER_OCTAVE)).cast("int")
    end = OCTAVES * CELLS_PER_OCTAVE
    return (F.when(F.isnan(x), end + 2).when(x == float("inf"), end + 1).when(x == float("-inf"), -end - 1).otherwise(number))


def sliced(df: DataFrame, key: Column, name: str = "_slice", cuts: int = CUTS, least: int = SLICE_ROWS, rounds: int = 1) -> DataFrame:
    """Add the number of each row's slice, which does not decrease with the numeric ``key``.

    One round counts cells. Each further one counts the parts into which slices cut the cells, for keys
    that crowd inside of a cell.
    """
    x = F.col("_x")
    rows = df.withColumn("_x", key.cast("double")).withColumn("_cell", _cell(x)).withColumn(name, F.lit(0))
    for _ in range(rounds):
        counts = rows.groupBy("_cell", name).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        limit = F.greatest(F.sum("_n").over(W.partitionBy()) / cuts, F.lit(float(least)))
        # a row per cell, of which there is a fixed number, and per slice
        table = counts.select(
            F.col("_cell").alias("_c"), F.col(name).alias("_s"), "_lo", (F.col("_hi") - F.col("_lo")).alias("_width"), "_n",
            before("_n", [], "_cell", name).alias("_before"), limit.alias("_limit"))
        share = F.coalesce((x - F.col("_lo")) / F.when(F.col("_width") > 0, F.col("_width")), F.lit(0.0))
        place = F.col("_before") + F.least(share * F.col("_n"), F.col("_n") - 1)
        rows = rows.join(F.broadcast(table), (F.col("_cell") == F.col("_c")) & (rows[name] == F.col("_s"))).select(
            *[F.col(c) for c in df.columns], "_x", "_cell", F.floor(place / F.col("_limit")).cast("int").alias(name))
    return rows.drop("_x", "_cell")


def before(total: str, groups: list[str], *order: str) -> Column:
    """Sum of ``total`` over the earlier rows of the group."""
    earlier = W.partitionBy(*groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(earlier), F.lit(0))


def _starts(rows: DataFrame, groups: list[str], slice_: str, total: Column) -> DataFrame:
    """Sum of ``total`` over the earlier slices of the group: one row per slice."""
    totals = rows.groupBy(*groups, slice_).agg(total.alias("_total"))
    starts = totals.select(*groups, slice_, before("_total", groups, slice_).alias("_start"))
    # without groups there is one row per slice
    return starts if groups else F.broadcast(starts)


def running_total(
    df: DataFrame, groups: list[str], key: str, weight: str, name: str, cuts: int = CUTS
) -> DataFrame:
    """Add the sum of ``weight`` over the rows with a smaller ``key`` in the group.

    ``key`` is numeric, not null and unique in its group.
    """
    cut = sliced(df, F.col(key), cuts=cuts)
    inside = cut.select("*", before(weight, [*groups, "_slice"], key).alias("_inside"))
    return (
        inside.join(_starts(cut, groups, "_slice", F.sum(weight)), [*groups, "_slice"])
        .select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))
    )


def _mark_hot(df: DataFrame, groups: list[str], hot_rows: int) -> DataFrame:
    """The rows with ``_hot`` set for those of groups above ``hot_rows``."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    # at most (all rows / hot_rows) groups can be hot
    hot = sizes.filter(F.col("_n") > hot_rows).select(*groups, F.lit(True).alias("_hot"))
    return df.join(hot, groups, "left").select(*df.columns, F.coalesce("_hot", F.lit(False)).alias("_hot"))


def _hot_sliced(df: DataFrame, groups: list[str], key: Column, hot_rows: int, cuts: int, name: str = "_slice") -> DataFrame:
    """Rows with ``_hot`` and, where it is set, their slice (0 elsewhere)."""
    cut = sliced(_mark_hot(df, groups, hot_rows), key, name, cuts)
    return cut.withColumn(name, F.when(F.col("_hot"), F.col(name)).otherwise(0))


def position(
    df: DataFrame,
    groups: list[str],
    key: Column,
    order: list[str],
    name: str,
    base: DataFrame | None = None,
    cuts: int = CUTS,
) -> DataFrame:
    """Add the 0-based position of each row of its group in ``order``; for few, big groups.

    ``key`` is numeric and does not decrease along ``order``; ``order`` is unique
    in a group. ``base`` (the group columns and ``base``) is added to the result.
    """
    cut = sliced(df, key, cuts=cuts)
    starts = _starts(cut, groups, "_slice", F.count(F.lit(1)))
    return _place(df, cut, starts, groups, ["_slice"], order, name, base)


def position_in_many(
    df: DataFrame, groups: list[str], key: Column, order: list[str], name: str,
    hot_rows: int = HOT_ROWS, cuts: int = CUTS,
) -> DataFrame:
    """The same for many groups of any size: only the hot ones are cut."""
    cut = _hot_sliced(df, groups, key, hot_rows, cuts)
    starts = _starts(cut.filter("_hot"), groups, "_slice", F.count(F.lit(1)))
    return _place(df, cut, starts, groups, ["_slice"], order, name, None, "left")


def nested_totals(
    df: DataFrame, major: str, minor: str, weight: str, totals: dict[str, list[str]], following: str | None = None,
    hot_rows: int = HOT_ROWS, cuts: int = CUTS,
) -> DataFrame:
    """Running totals along ``major, minor`` (unique, numeric), and the next greater minor of the major, in one go.

    ``totals`` maps the name of a new column to the columns of its groups; it gets the sum of ``weight`` over the
    group's earlier rows. Majors are told apart by all group columns. ``following`` names a column for the
    next minor. One major may hold any share of the rows: a hot one is cut along ``minor``. Pieces, one
    per major that is not, get their starts from totals over slices of majors.
    """
    grouped = sorted({g for groups in totals.values() for g in groups} - {major})
    cut = _hot_sliced(df, [*grouped, major], F.col(minor), hot_rows, cuts, "_fine")
    piece = [*grouped, major, "_fine"]
    if totals:
        cut, piece = sliced(cut, F.col(major), "_coarse", cuts), ["_coarse", *piece]
    pieces = cut.groupBy(*piece).agg(F.sum(weight).alias("_weight"), F.min(minor).alias("_least"))
    starts = pieces.select(*piece, F.lead("_least").over(W.partitionBy(*grouped, major).orderBy("_fine")).alias("_next"), *(
        before("_weight", [*groups, "_coarse"], major, *(g for g in grouped if g not in groups), "_fine").alias(name)
        for name, groups in totals.items()))
    for name, groups in totals.items():
        coarse = pieces.groupBy("_coarse", *groups).agg(F.sum("_weight").alias("_weight"))
        coarse = coarse.select("_coarse", *groups, before("_weight", groups, "_coarse").alias("_earlier"))
        starts = starts.join(coarse if groups else F.broadcast(coarse), ["_coarse", *groups]).withColumn(
            name, F.col(name) + F.col("_earlier")).drop("_earlier")
    inside = W.partitionBy(*piece).orderBy(minor)
    rows = cut.select("*", before(weight, piece, minor).alias("_inside"), F.lead(minor).over(inside).alias("_follows"))
    rows = rows.join(starts, piece)
    more = [F.coalesce("_follows", "_next").alias(following)] if following else []
    return rows.select(*df.columns, *((F.col(name) + F.col("_inside")).alias(name) for name in totals), *more)


def nested_position(
    df: DataFrame, groups: list[str], major: str, minor: str, name: str,
    hot_rows: int = HOT_ROWS, cuts: int = CUTS,
) -> DataFrame:
    """Position of each row of its group in the order ``major, minor`` (unique, numeric); see ``nested_totals``."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return nested_totals(ones, major, minor, "_one", {name: groups}, None, hot_rows, cuts).drop("_one")


def _place(
    df: DataFrame, cut: DataFrame, starts: DataFrame, groups: list[str], piece: list[str],
    order: list[str], name: str, base: DataFrame | None, how: str = "inner",
) -> DataFrame:
    """Start of the row's piece plus its place in the piece."""
    keys = list(dict.fromkeys([*groups, *piece]))
    if base is not None:
        starts = starts.join(base, groups).select(*keys, (F.col("_start") + F.col("base")).alias("_start"))
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return (
        cut.select("*", inside.alias("_inside")).join(starts, keys, how)
        .select(*df.columns, (F.coalesce("_start", F.lit(0)) + F.col("_inside")).alias(name))
    )


def group_bases(sizes: DataFrame, group: str) -> DataFrame:
    """First index of each group when groups are laid end to end in name order.

    Takes ``(group, n)`` with one row per group, such as a source file; data rows
    never reach the one task that adds up the sizes.
    """
    return sizes.select(group, before("n", [], group).alias("base"))


def descending_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """Competition rank (ties share a rank), greatest ``score`` first.

    Ranks the distinct scores, not the rows, so no task sees the whole table.
    """
    tally = df.groupBy(score).agg(F.count(F.lit(1)).alias("_rows")).select(
        score, "_rows", (-F.col(score)).alias("_down")
    )
    ranks = running_total(tally, [], "_down", "_rows", "_above").select(
        score, (F.col("_above") + 1).cast("int").alias(name)
    )
    return df.join(ranks, score)
