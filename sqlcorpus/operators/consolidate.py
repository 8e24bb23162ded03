"""Provenance, unions by name and the dense index of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus.operators.normalize import column
from sqlcorpus.operators.ordering import before
from sqlcorpus.schemas import TAKEN, unshielded
from sqlcorpus.sources.paths import decoded


def tag_source(df: DataFrame, name: str = "source") -> DataFrame:
    """Add the file name, extension included, of a freshly scanned file source."""
    return df.withColumn(name, decoded("_metadata.file_name"))


def unite(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is null."""
    return reduce(lambda up, down: up.unionByName(down, allowMissingColumns=True), frames)


def of_class(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.col("class") == kind)


def from_source(rows: DataFrame, *sources: str) -> DataFrame:
    """Rows of the named sources."""
    return rows.filter(source_in(*sources))


def source_in(*sources: str) -> Column:
    source = F.col("source")
    return source == sources[0] if len(sources) == 1 else source.isin(*sources)


def _slots(table: DataFrame, groups: list[str], key: str, value: str) -> DataFrame:
    """The values of each group as an array with the place ``key``; places without a row are null."""
    keys = table.groupBy(*groups).agg(F.max(key).alias("_most")).select(
        *groups, F.explode(F.sequence(F.lit(0), F.col("_most"))).alias(key))
    in_order = F.sort_array(F.collect_list(F.struct(key, value)))
    return keys.join(table, [*groups, key], "left").groupBy(*groups).agg(F.transform(in_order, lambda s: s[value]).alias(value))


def index_in_file_order(staged: DataFrame, name: str = "index") -> DataFrame:
    """Add a dense 0-based index in (source, path, place in the file) order.

    A piece is what one task read of one file, its rows numbered without gaps at the scan. So a row
    only lacks the number of rows in earlier pieces. These sums, one number a piece, are one value
    that every task looks up by scan and lane, which are small numbers given at staging: the rows are
    neither sorted, joined nor shuffled. A piece with missing rows is an error.
    """
    piece = ["source", "_path", "_block"]
    sizes = staged.groupBy("_scan", "_lane", *piece).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), F.max("_row").alias("_last")
    )
    whole = F.col("_last") - F.col("_first") + 1 == F.col("_n")
    # one row per piece in one task, never a data row
    starts = sizes.withColumn("_start", before("_n", [], *piece)).select(
        "_scan", "_lane", "_first",
        F.when(whole, F.col("_start") - F.col("_first"))
        .otherwise(F.raise_error(F.concat(F.lit("rows missing inside "), "_path"))).alias("_shift"),
    )
    # a lane holds few pieces: what one task read, or one file
    lanes = starts.groupBy("_scan", "_lane").agg(F.sort_array(F.collect_list(F.struct("_first", "_shift"))).alias("_pieces"))
    table = _slots(_slots(lanes, ["_scan"], "_lane", "_pieces"), [], "_scan", "_pieces").scalar()
    found = staged.withColumn("_own", F.get(F.get(table, F.col("_scan")), F.col("_lane")))
    own = F.element_at(F.filter("_own", lambda p: p["_first"] <= F.col("_row")), -1)
    return found.select((own["_shift"] + F.col("_row")).alias(name), *map(column, staged.columns))


def data_columns(staged: DataFrame) -> list[Column]:
    """The columns of the sources under their own names, without those that the store added."""
    return [column(c).alias(unshielded(c)) for c in staged.columns if c.lower() not in TAKEN]
