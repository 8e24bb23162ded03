"""Names of files as they are: no patterns, nothing read twice, nothing left out."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: characters by which Spark tells a pattern from a name.
PATTERN = re.compile(r"([\\{}\[\]*?])")


def literal(path: str) -> str:
    """A path that Spark's readers take as a name, whatever characters it holds."""
    return PATTERN.sub(r"\\\1", path)


def literals(paths: str | list[str]) -> list[str]:
    """Each path once."""
    return [literal(path) for path in dict.fromkeys([paths] if isinstance(paths, str) else paths)]


def decoded(name: str) -> Column:
    """A path or file name of a scan as it is in the folder; scans give it percent-encoded."""
    return F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B")))


def bare(path: str) -> str:
    """Paths come with no scheme, or one or three slashes after it."""
    return re.sub(r"^file:/*", "/", path)


def check_all_read(df: DataFrame, paths: list[str]) -> DataFrame:
    """``df``, if its scans read the named files and no others; no job runs."""
    read = {bare(unquote(uri)) for uri in df.inputFiles()}
    wanted = {bare(path) for path in paths}
    if read != wanted:
        raise OSError(f"files found but not read: {sorted(wanted - read)}; read but not found: {sorted(read - wanted)}")
    return df
