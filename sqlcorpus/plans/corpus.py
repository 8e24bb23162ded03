"""From raw files to exported datasets."""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sqlcorpus.functions import processed_name, table_name
from sqlcorpus.operators.consolidate import data_columns, from_source, index_in_file_order, of_class, unite
from sqlcorpus.operators.normalize import column, normalize, with_kind
from sqlcorpus.plans.templates import NAMED_SOURCES, SYSTEM_PROMPT, CorpusTables, dataset, datasets_long
from sqlcorpus.schemas import (
    ALL_TABLE, CSV_NA_TOKENS, DATASET_PREFIX, GENERATION, GENERATION_COLUMNS, GENERATION_TABLE, INSTRUCT,
    INSTRUCT_COLUMNS, INSTRUCT_TABLE,
)
from sqlcorpus.sinks.files import export_datasets, write_routed
from sqlcorpus.sinks.tables import create_table, replace_table, stored_name
from sqlcorpus.sources.discover import Shape, discover_sources, group_by_shape
from sqlcorpus.sources.files import PROVENANCE, read_csv, read_json, read_jsonl, read_parquet
from sqlcorpus.sources.large_csv import read_large_csv
from sqlcorpus.sources.paths import check_all_read, literals
from sqlcorpus.sources.tables import table_in

STORED = ("class", "folder", "source")
KNOWN = ("csv", "json", "jsonl", "parquet")
PLACE = ("_path", "_block", "_row", "_lane", "_scan")


def _read(spark: SparkSession, shape: Shape, paths: list[str]) -> DataFrame:
    if shape.fmt == "json":
        check_all_read(spark.read.text(literals(paths)), paths)  # the records are read from a copy
        return read_json(spark, paths, list(shape.columns), provenance=True)
    if shape.large:
        df = read_large_csv(spark, paths, shape.columns, CSV_NA_TOKENS, provenance=True)
    elif shape.fmt == "csv":
        df = read_csv(spark, paths, provenance=True, columns=shape.columns)
    elif shape.fmt == "parquet":
        df = read_parquet(spark, paths, provenance=True)
    else:
        df = read_jsonl(spark, paths, list(shape.columns), provenance=True)
    return check_all_read(df, paths)


def _origin(save: str) -> list[Column]:
    folder = F.element_at(F.split("_path", "/"), -2)
    return [folder.alias("folder"), processed_name(F.col("_file"), save).alias("source")]


def normalize_sources(
    spark: SparkSession, root: str, exclude: tuple[str, ...] = ("raw",), save: str = "jsonl",
    large_from: int | None = None,
) -> DataFrame:
    """Canonical rows of every file below ``root``, one scan per file shape.

    The files that the scans read are held against those found; a difference is an error. Columns of the
    data that are named like the store's own are kept under a longer name, see ``shielded``.
    """
    frames = []
    for shape, paths in group_by_shape(spark, discover_sources(spark, root, exclude), large_from).items():
        if not shape.columns and shape.fmt in KNOWN:
            raise ValueError(f"no columns found in {paths}: empty, or not of format {shape.fmt!r}")
        if not shape.columns:
            warnings.warn(f"skipped {len(paths)} file(s) of format {shape.fmt!r}", stacklevel=2)
            continue
        result = normalize(_read(spark, shape, paths), shape.fmt, PROVENANCE)
        # the source of a row is its file, whatever the file says
        data = [c for c in result.rows.columns if c not in PROVENANCE and c.lower() != "source"]
        frames.append(with_kind(result).withColumn("_scan", F.lit(len(frames))).select(
            *(column(c).cast("string").alias(c) for c in data), "class", *_origin(save), *PLACE
        ))
    if not frames:
        raise FileNotFoundError(f"no readable source below {root}")
    return unite(frames)


def stage_sources(spark: SparkSession, raw: str, staged: str, save: str = "jsonl", mode: str = "errorifexists",
                  exclude: tuple[str, ...] = ("raw",)) -> DataFrame:
    """Normalise everything once and keep it; later steps read the pruned store."""
    write_routed(normalize_sources(spark, raw, exclude, save), staged, mode)
    return read_staged(spark, staged)


def read_staged(spark: SparkSession, staged: str) -> DataFrame:
    """The staged rows. Partition values are names, not numbers or dates."""
    found = spark.read.parquet(staged).schema
    schema = T.StructType([
        T.StructField(f.name, T.StringType() if f.name in STORED else f.dataType)
        for f in found
    ])
    return spark.read.schema(schema).parquet(staged)


def corpus_tables(staged: DataFrame, sources: dict[str, tuple[str, ...]] | None = None) -> CorpusTables:
    """The consolidated tables, each with its own dense index."""
    sources = {**NAMED_SOURCES, **(sources or {})}

    def table(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        lacking = [c for c in columns if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in lacking}) if lacking else rows
        return rows.select(*data_columns(rows))

    name = index_name(staged)
    indexed = {kind: index_in_file_order(of_class(staged, kind), name) for kind in (GENERATION, INSTRUCT)}
    return CorpusTables(
        generation=table(indexed[GENERATION], GENERATION_COLUMNS),
        instruct=table(indexed[INSTRUCT], INSTRUCT_COLUMNS),
        # its index, as a key; the prompts are rendered without it
        system_prompt=table(from_source(indexed[INSTRUCT], *sources[SYSTEM_PROMPT]), INSTRUCT_COLUMNS),
        sources=sources,
        index=name,
    )


def index_name(staged: DataFrame) -> str:
    """``index``, unless the sources have a column of that name."""
    return "level_0" if "index" in {c.lower() for c in staged.columns} else "index"


def store_tables(staged: DataFrame, tables: CorpusTables, database: str | None = None) -> None:
    """The three union tables of the consolidated corpus."""
    replace_table(tables.generation, table_in(database, GENERATION_TABLE))
    replace_table(tables.instruct, table_in(database, INSTRUCT_TABLE))
    everything = index_in_file_order(staged, index_name(staged))
    replace_table(everything.select(*data_columns(everything)), table_in(database, ALL_TABLE))


def source_table(staged: DataFrame, name: str) -> DataFrame:
    """The rows of one file by its table name, with an index of their own (partition pruning leaves only its files)."""
    rows = staged.filter(table_name(F.col("source")) == name)
    indexed = index_in_file_order(rows, index_name(staged))
    return indexed.select(*data_columns(indexed))


def store_source_tables(staged: DataFrame, database: str | None = None) -> dict[str, str]:
    """A stored table for every file, replacing older ones; files of one name share a table.

    Answers with the table of each name: catalogues take fewer characters than files do, and no
    two names that differ in case only, which is an error.
    """
    rows = staged.select(table_name(F.col("source")).alias("name")).distinct().orderBy("name").collect()  # one per file
    names = {row["name"]: stored_name(row["name"]) for row in rows}
    if len({stored.lower() for stored in names.values()}) < len(names):
        raise ValueError(f"names of files that differ in case only: {sorted(names)}")

    def store(name: str) -> None:
        replace_table(source_table(staged, name), table_in(database, names[name]))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(store, names))
    return names


def create_datasets(
    tables: CorpusTables, names: list[str], overwrite: bool = False, keyed: bool = False, database: str | None = None
) -> None:
    """One stored table per dataset; ``keyed`` tables can be split."""
    for name in names:
        create_table(dataset(name, tables, keyed), table_in(database, DATASET_PREFIX + name), overwrite)


def build_corpus(
    spark: SparkSession, raw: str, staged: str, out: str, save: str = "jsonl",
    mode: str = "errorifexists", sources: dict[str, tuple[str, ...]] | None = None, keyed: bool = False,
    compression: str | None = None,
) -> None:
    """Raw files → staged rows → all datasets, exported in one job."""
    tables = corpus_tables(stage_sources(spark, raw, staged, save, mode), sources)
    export_datasets(datasets_long(tables, keyed).drop("source"), out, save, mode, compression)
