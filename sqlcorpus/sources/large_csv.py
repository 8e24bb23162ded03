"""CSV files too big for one task, quoted line ends included.

Spark can split a CSV file only if no cell holds a line end. Here the file is read as lines, which split
anywhere. What a line does depends on its past only by whether it starts inside a quoted cell, so it
is a function from {outside, inside} to the same: it keeps the state, swaps it, or sets it. Functions of lines, and of
whole pieces, are composed in a row: the state is what the last setting one left, swapped by each
swapping one since. Only the lines of records that span several lines are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sqlcorpus.operators.normalize import column
from sqlcorpus.operators.ordering import before
from sqlcorpus.schemas import shielded
from sqlcorpus.sources.paths import literals
from sqlcorpus.sources.place import PIECE, PROVENANCE, with_provenance

# State of the reader: at the start of a cell, in one without quotes, in a quoted one, after a quote in a quoted one.
START, BARE, QUOTED, CLOSING = range(4)


def _after_quote(state: Column) -> Column:
    return F.when(state == START, QUOTED).when(state == QUOTED, CLOSING).when(state == CLOSING, QUOTED).otherwise(BARE)


def _after_text(state: Column, text: Column) -> Column:
    """State after a stretch without quotes. A quoted cell that goes on behind its quote has become a bare one."""
    outside = F.when(text.contains(","), F.when(text.endswith(","), START).otherwise(BARE)).when(text == "", state).otherwise(BARE)
    return F.when(state == QUOTED, QUOTED).otherwise(outside)


def _ends_inside(line: Column, start: int) -> Column:
    """1 if a line that starts in this state ends in a quoted cell."""
    parts = F.split(line, '"', -1)
    first = _after_text(F.lit(start), F.get(parts, F.lit(0)))
    state = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), first.cast("int"),
        lambda s, text: _after_text(_after_quote(s), text).cast("int"))
    return (state == QUOTED).cast("int")


def _composed(df: DataFrame, groups: list[str], order: list[str], out: Column, inside: Column, start: Column, name: str) -> DataFrame:
    """Add the state before each row, given what each row makes of outside and of inside, and the state of the group's start."""
    earlier = W.partitionBy(*groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_swap", (out > inside).cast("long")).withColumn("_set", F.when(out == inside, out))
    df = df.withColumn("_swaps", F.coalesce(F.sum("_swap").over(earlier), F.lit(0)))
    left = F.last(F.when(F.col("_set").isNotNull(), F.struct("_set", "_swaps")), ignorenulls=True).over(earlier)
    df = df.withColumn("_left", left)
    since = F.coalesce(F.col("_left._set"), start) + F.col("_swaps") - F.coalesce(F.col("_left._swaps"), F.lit(0))
    return df.withColumn(name, (since % 2).cast("int")).drop("_swap", "_set", "_swaps", "_left")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with what they make of either state, and the state before them for either state of their piece's start."""
    lines = with_provenance(spark.read.option("lineSep", "\n").text(literals(paths)))
    bare = F.regexp_replace("value", "\r$", "")
    lines = lines.select("*", _ends_inside(bare, START).alias("_out"), _ends_inside(bare, QUOTED).alias("_in"))
    for start in (0, 1):
        lines = _composed(lines, PIECE, ["_row"], F.col("_out"), F.col("_in"), F.lit(start), f"_at{start}")
    return lines


def _starts(state: Column, windows: Column) -> Column:
    """1 where a record starts. Empty lines are none."""
    empty = (F.col("value") == "") | windows & (F.col("value") == "\r")
    return ((state == 0) & ~empty).cast("long")


def _pieces(lines: DataFrame) -> DataFrame:
    """Each piece with its state at the start, the records that start before it, its file's number and kind of line ends."""
    def end(start: int) -> Column:
        after = F.when(F.col(f"_at{start}") == 0, F.col("_out")).otherwise(F.col("_in"))
        return F.max_by(after, "_row").alias(f"_end{start}")

    counts = [F.sum(_starts(F.col(f"_at{s}"), F.lit(w))).alias(f"_n{s}{int(w)}") for s in (0, 1) for w in (False, True)]
    pieces = lines.groupBy(*PIECE).agg(end(0), end(1), F.min_by(F.col("value").endswith("\r"), "_row").alias("_cr"), *counts)
    file = W.partitionBy("_path")
    pieces = pieces.withColumn("_windows", F.min_by("_cr", "_block").over(file))
    pieces = _composed(pieces, ["_path"], ["_block"], F.col("_end0"), F.col("_end1"), F.lit(0), "_open")
    ends = F.when(F.col("_open") == 0, F.col("_end0")).otherwise(F.col("_end1"))
    began = F.when(F.col("_windows"), F.when(F.col("_open") == 0, F.col("_n01")).otherwise(F.col("_n11"))).otherwise(
        F.when(F.col("_open") == 0, F.col("_n00")).otherwise(F.col("_n10")))
    pieces = pieces.withColumn("_begun", began).withColumn("_last", F.max_by(ends, "_block").over(file))
    records = F.when(F.col("_last") == 0, before("_begun", ["_path"], "_block")).otherwise(
        F.raise_error(F.concat(F.lit("a quoted cell is not closed in "), "_path")))
    return pieces.select(
        *PIECE, "_open", "_windows", records.alias("_records"), (F.dense_rank().over(W.orderBy("_path")) - 1).cast("int").alias("_number"))


def _records(lines: DataFrame) -> DataFrame:
    """Lines with the number of their record in the file, and whether they are all of it."""
    placed = lines.join(_pieces(lines), PIECE)
    placed = placed.withColumn("_state", F.when(F.col("_open") == 0, F.col("_at0")).otherwise(F.col("_at1")))
    placed = placed.withColumn("_ends", F.when(F.col("_state") == 0, F.col("_out")).otherwise(F.col("_in")))
    starts = _starts(F.col("_state"), F.col("_windows"))
    so_far = F.sum(starts).over(W.partitionBy(*PIECE).orderBy("_row").rowsBetween(W.unboundedPreceding, 0))
    return placed.select(
        "_path", "_file", "_block", "_row", "_number", "_windows", "value", (F.col("_records") + so_far - 1).alias("_record"),
        (F.col("_state") == 0).alias("_outside"), (F.col("_ends") == 0).alias("_closed"), (starts == 1).alias("_begins"))


def read_large_csv(
    spark: SparkSession, paths: list[str], header: tuple[str, ...], na_values: tuple[str, ...], provenance: bool = False
) -> DataFrame:
    """Same rows as a multi-line read of files with this header, by as many tasks as the files have pieces.

    Lines end with LF, or with CRLF throughout a file; CR alone is no line end here. A quoted cell that
    is never closed is an error.
    """
    records = _records(_lines(spark, paths))
    whole = records.filter("_begins AND _closed")
    parts = records.filter("NOT (_outside AND _closed)")
    # the lines of one record, not of a file
    in_order = F.sort_array(F.collect_list(F.struct("_block", "_row", "value")))
    joined = parts.groupBy("_path", "_file", "_number", "_windows", "_record").agg(
        F.array_join(F.transform(in_order, lambda line: line["value"]), "\n").alias("value")
    )
    columns = ["_path", "_file", "_number", "_windows", "_record", "value"]
    texts = whole.select(*columns).unionByName(joined).filter("_record > 0")
    plain = F.replace(F.concat("value", F.lit("\n")), F.lit("\r\n"), F.lit("\n"))
    text = F.when(F.col("_windows"), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(F.col("value"))
    cells = F.from_csv(text, ", ".join(f"c{i} STRING" for i in range(len(header))), {"quote": '"', "escape": '"'})
    absent = ("", *na_values)
    names = [shielded(name) if provenance else name for name in header]
    rows = texts.select("*", cells.alias("_cells")).select(
        *(
            F.when(~F.col(f"_cells.c{i}").isin(*absent), F.col(f"_cells.c{i}")).alias(name)
            for i, name in enumerate(names)
        ),
        # records are numbered through the file, so the file is one piece
        "_path", "_file", F.lit(0).cast("long").alias("_block"), (F.col("_record") - 1).alias("_row"), F.col("_number").alias("_lane"),
    )
    return rows if provenance else rows.select(*map(column, names))
