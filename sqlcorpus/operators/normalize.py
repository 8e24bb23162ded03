"""Rules that turn a file of any known shape into canonical rows.

A rule looks at the file format and the column names only, in file order, and
answers with one expression per output column; it never looks at rows.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus.functions import join_present, tagged_sections
from sqlcorpus.schemas import GENERATION, GENERATION_COLUMNS, INSTRUCT, MISSING


@dataclass(frozen=True)
class Normalized:
    rows: DataFrame
    kind: str


def column(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _by_position(columns: list[str], roles: tuple[str, str, str], tail: bool = True) -> dict[str, Column]:
    fields = {role: column(name) for role, name in zip(roles, columns)}
    rest = [column(name) for name in columns[3:]]
    fields["extra"] = join_present(rest) if tail and rest else F.lit(MISSING)
    return fields


def _csv(columns: list[str]) -> dict[str, Column] | None:
    if len(columns) >= 3:
        return _by_position(columns, ("question", "context", "answer"))
    if "combined_text" not in columns:
        return None
    text = column("combined_text")
    return {**tagged_sections(text), "extra": text}


def _json(columns: list[str]) -> dict[str, Column] | None:
    if len(columns) < 3:
        raise ValueError(f"a JSON source needs three columns, found {columns}")
    fields = _by_position(columns, ("question", "context", "answer"), tail=False)
    fields.update((name, column(name)) for name in columns[3:] if name not in fields)
    return fields


def _jsonl(columns: list[str]) -> dict[str, Column] | None:
    missing = F.lit(MISSING)
    if len(columns) >= 3:
        if len(columns) == 3 and "source" in columns:
            return {"question": missing, "context": column(columns[0]),
                    "answer": column(columns[1]), "extra": missing}
        return _by_position(columns, ("question", "context", "answer"))
    if "Questions" not in columns:
        return None
    if len(columns) != 2 or columns[1] == "Questions":
        raise ValueError(f"Questions must be followed by an answer column, found {columns}")
    return {"question": column("Questions"), "context": missing,
            "answer": column(columns[1]), "extra": missing}


def _parquet(columns: list[str]) -> dict[str, Column] | None:
    if len(columns) < 3:
        return None
    return _by_position(columns, ("question", "answer", "context"))


RULES = {"csv": _csv, "json": _json, "jsonl": _jsonl, "parquet": _parquet}


def normalize(df: DataFrame, fmt: str, keep: tuple[str, ...] = ()) -> Normalized | None:
    """Canonical rows of ``df``; None, with a warning, for an unknown format.

    ``keep`` names provenance columns, which are passed on and never counted as data.
    """
    if fmt not in RULES:
        warnings.warn(f"unknown format {fmt!r}: skipped", stacklevel=2)
        return None
    columns = [name for name in df.columns if name not in keep]
    kept = [column(name) for name in keep]
    fields = RULES[fmt](columns)
    if fields is None:
        return Normalized(df.select(*map(column, columns), *kept), INSTRUCT)
    order = [*GENERATION_COLUMNS, *(name for name in fields if name not in GENERATION_COLUMNS)]
    rows = df.select(*(fields[name].cast("string").alias(name) for name in order), *kept)
    return Normalized(rows, GENERATION)


def with_kind(normalized: Normalized) -> DataFrame:
    """The rows with their class as a column, as the stores keep it."""
    return normalized.rows.withColumn("class", F.lit(normalized.kind))
