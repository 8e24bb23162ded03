"""File sinks. Every writer is one job and writes in parallel; nothing is coalesced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

# Rows per output file: keeps files of long texts readable and restartable.
MAX_RECORDS = 5_000_000
# Level of gzip: on prompts a third of the default's time, for 4 % more bytes.
GZIP_LEVEL = "FOUR"
DATASET_COLUMN = "dataset"
ROUTE = ("class", "folder", "source")
# Bytes of rows in a bucket, on average: one task sorts them in memory.
BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 1 << 16


@dataclass(frozen=True)
class Buckets:
    """A table over the files of one write, in which ``count`` buckets hold the rows by ``key``."""

    table: str
    key: str
    count: int


def bucket_count(size: int) -> int:
    """Buckets for so many bytes of rows."""
    return min(1 + size // BUCKET_BYTES, MOST_BUCKETS)


def _writer(df: DataFrame, mode: str, partitions: tuple[str, ...], compression: str | None = None):
    """``mode`` is Spark's, or ``routes``: replace only the partitions that ``df`` has rows of."""
    own = {"partitionOverwriteMode": "dynamic"} if mode == "routes" else {"partitionOverwriteMode": "static"}
    writer = df.write.mode("overwrite" if mode == "routes" else mode).options(**own).option("maxRecordsPerFile", MAX_RECORDS)
    if compression:
        writer = writer.options(**{"compression": compression, "zlib.compress.level": GZIP_LEVEL})
    return writer.partitionBy(*partitions) if partitions else writer


def _save(writer: DataFrameWriter, path: str, buckets: Buckets | None) -> None:
    """Spark keeps buckets for tables only, here for one over files at ``path``."""
    if buckets:
        writer.bucketBy(buckets.count, buckets.key).option("path", path).saveAsTable(buckets.table)
    else:
        writer.save(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", partitions: tuple[str, ...] = (),
              compression: str | None = None, buckets: Buckets | None = None) -> None:
    """CSV with a header row."""
    _save(
        _writer(df, mode, partitions, compression).option("header", True)
        .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).format("csv"), path, buckets
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", partitions: tuple[str, ...] = (),
                compression: str | None = None, buckets: Buckets | None = None) -> None:
    """One record per line; an absent value is written as an explicit null."""
    _save(_writer(df, mode, partitions, compression).option("ignoreNullFields", False).format("json"), path, buckets)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partitions: tuple[str, ...] = ()) -> None:
    _writer(df, mode, partitions).parquet(path)


def write_json_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Files that hold one JSON array of records each, one per task; nulls are explicit.

    ``df`` must give the same rows in the same tasks when it is read twice, as a plain scan does.
    """
    placed = df.select(F.struct("*").alias("_record")).withColumn("_at", F.monotonically_increasing_id())
    # the last row of each task: one row per task
    last = placed.groupBy(F.shiftright("_at", 33)).agg(F.max("_at").alias("_at")).select("_at", F.lit("]").alias("_end"))
    text = F.to_json("_record", {"ignoreNullFields": "false"})
    head = F.when(F.col("_at").bitwiseAND((1 << 33) - 1) == 0, "[").otherwise(",")
    lines = placed.join(F.broadcast(last), "_at", "left").select(F.concat(head, text, F.coalesce("_end", F.lit(""))))
    lines.write.mode(mode).text(path)


FORMATS = {"csv": write_csv, "jsonl": write_jsonl}


def write_rows(df: DataFrame, path: str, save: str, mode: str = "errorifexists",
               partitions: tuple[str, ...] = (), compression: str | None = None, buckets: Buckets | None = None) -> None:
    if save not in FORMATS:
        raise ValueError(f"{save!r} is none of {sorted(FORMATS)}")
    FORMATS[save](df, path, mode, partitions, compression, buckets)


def write_routed(df: DataFrame, path: str, mode: str = "errorifexists", save: str = "parquet") -> None:
    """Normalised rows by class, folder and source file.

    Parquet and ``jsonl`` keep the missing-value text apart from null, ``csv`` does not. A source of any size is
    written by as many tasks as read it. With the mode ``routes`` only the sources that ``df`` has rows of are
    replaced; whatever else lies below ``path`` stays.
    """
    if save == "parquet":
        write_parquet(df, path, mode, ROUTE)
    else:
        write_rows(df, path, save, mode, ROUTE)


def export_datasets(long: DataFrame, path: str, save: str = "jsonl", mode: str = "errorifexists",
                    compression: str | None = None, buckets: Buckets | None = None) -> None:
    """Every dataset of a (dataset, …) table in a single job, one folder per dataset.

    The export holds each text once per prompt that quotes it. ``compression`` is Spark's name of a codec for the
    lines (``gzip``, which other programs read too); without one they are written as they are. With ``buckets`` the
    files are also a table, from which one task can read the prompts of a key in all folders. The key should be one
    of which a task has few, as ``part`` is: each task writes a file for every bucket and dataset that it has rows of.
    """
    write_rows(long, path, save, mode, (DATASET_COLUMN,), compression, buckets)


def name_files(spark: SparkSession, written: str, folder: str, name: str) -> list[str]:
    """Move what one write has left in ``written`` to ``folder`` as ``name``, or ``stem-00000.ext`` and on if it is several files.

    Spark names files itself; other programs, and the rules of this library, go by names. Only names
    change, no data passes through the driver.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(written), hadoop.Path(folder)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    parts = sorted(p for s in files.listStatus(source) if (p := s.getPath().getName()).startswith("part-"))
    stem, _, extension = name.rpartition(".")
    names = [name] if len(parts) == 1 else [f"{stem}-{k:05d}.{extension}" for k in range(len(parts))]
    for part, new in zip(parts, names):
        if not files.rename(hadoop.Path(source, part), hadoop.Path(target, new)):
            raise OSError(f"cannot rename {written}/{part} to {folder}/{new}")
    return names
