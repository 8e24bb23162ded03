"""Where a row came from: enough to restore the order of files, and to number rows without sorting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sqlcorpus.operators.normalize import column
from sqlcorpus.schemas import shielded
from sqlcorpus.sources.paths import decoded

# A piece of a file is a path and a block. Its rows are numbered without gaps by ``_row``; pieces in
# one lane of a scan do not overlap in their numbers.
PROVENANCE = ("_path", "_file", "_block", "_row", "_lane")
PIECE = ["_path", "_block"]


def with_provenance(df: DataFrame) -> DataFrame:
    """Add path, file name, split start, a number that grows along the split, and the lane it is unique in.

    Must be applied right at the scan: row numbers follow the order in the task. Columns of the data whose
    names are taken are renamed, see ``shielded``.
    """
    return df.select(
        *(column(name).alias(shielded(name)) for name in df.columns),
        decoded("_metadata.file_path").alias("_path"),
        decoded("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_lane", F.shiftright("_row", 33).cast("int"))
