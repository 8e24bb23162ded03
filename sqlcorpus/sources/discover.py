"""Finding source files and telling their shapes apart."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlcorpus.sources.files import csv_headers, json_columns, parquet_columns
from sqlcorpus.sources.paths import bare, literal


def discover_sources(
    spark: SparkSession, root: str, exclude: tuple[str, ...] = (), skip_extensions: tuple[str, ...] = ("sqlite",)
) -> DataFrame:
    """One row per file below ``root``: path, length, dir, folder, file, ext. Contents are not read.

    Files lying directly in a folder named in ``exclude`` are left out; ``dir``
    (not the folder's bare name) identifies a folder. As in all of Spark, files and folders
    whose names start with a dot or an underscore are not seen.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(literal(root))
        .select("path", "length")
    )
    files = found.select(
        "path", "length",
        F.regexp_replace("path", r"/[^/]*$", "").alias("dir"),
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
    ).withColumn("ext", F.substring_index("file", ".", -1))
    return files.filter(~F.col("folder").isin(*exclude) & ~F.col("ext").isin(*skip_extensions))


def files_by_folder(sources: DataFrame) -> DataFrame:
    """File names per folder."""
    return sources.groupBy("dir", "folder").agg(F.sort_array(F.collect_list("file")).alias("files"))


@dataclass(frozen=True)
class Shape:
    """What files have to share to be read by one scan."""

    fmt: str
    columns: tuple[str, ...]
    large: bool = False  # too big for a reader that takes a file as a whole


def group_by_shape(spark: SparkSession, sources: DataFrame, large_from: int | None = None) -> dict[Shape, list[str]]:
    """The paths of each shape, so that the number of scans is that of shapes, not of files.

    Works on file names and headers. Files of unknown format have no columns. One reader takes CSV
    files of every size, unless the caller names a size from which on they are split between tasks;
    that reader wants LF or CRLF line ends. Headers of CSV files, and keys of JSON files, come from one
    job each, footers of Parquet files one by one.
    """
    sizes: dict[str, dict[str, int]] = {}
    for row in sources.select("path", "ext", "length").orderBy("path").collect():
        sizes.setdefault(row["ext"], {})[row["path"]] = row["length"]
    shapes: dict[Shape, list[str]] = {}
    for ext, files in sizes.items():
        for path, columns in _columns(spark, ext, list(files)).items():
            large = ext == "csv" and large_from is not None and files[path] >= large_from
            shapes.setdefault(Shape(ext, columns, large), []).append(path)
    return shapes


def _columns(spark: SparkSession, ext: str, paths: list[str]) -> dict[str, tuple[str, ...]]:
    if ext == "parquet":
        # each is a tiny job that reads one footer
        with ThreadPoolExecutor(8) as pool:
            return dict(zip(paths, pool.map(lambda path: parquet_columns(spark, path), paths)))
    if ext == "csv":
        found = csv_headers(spark, paths)
    elif ext in ("json", "jsonl"):
        found = json_columns(spark, paths, ext)
    else:
        return dict.fromkeys(paths, ())
    by_name = {bare(path): names for path, names in found.items()}
    return {path: by_name.get(bare(path), ()) for path in paths}
