"""Column functions; every one is a built-in expression that stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sqlcorpus.schemas import LOSS_SUFFIX, STEPS_FACTOR

# Fixed value: layout of a row that carries all three fields in one text. The
# dot spans lines, and a single closing newline is not part of the context.
SECTIONS = r"(?sd)###question:(.*?)###answer:(.*?)###context:(.*?)$"


def requote(text: Column) -> Column:
    """Double quotes become single quotes."""
    return F.replace(text, F.lit('"'), F.lit("'"))


def prompt(*parts: Column | str) -> Column:
    """Concatenation in which one NULL makes the whole prompt NULL."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def join_present(columns: list[Column]) -> Column:
    """Non-null values separated by one blank; empty text if all are null."""
    return F.concat_ws(" ", *(c.cast("string") for c in columns))


def tagged_sections(text: Column) -> dict[str, Column]:
    """Question, answer and context of a tagged text; all null if it has no such layout."""
    fits = text.rlike(SECTIONS)
    return {
        name: F.when(fits, F.regexp_extract(text, SECTIONS, group))
        for group, name in enumerate(("question", "answer", "context"), start=1)
    }


def duration_text(seconds: Column) -> Column:
    """Seconds as ``1h 2m 3s``, rounded down at each unit."""
    def whole(amount: Column) -> Column:
        return F.floor(amount).cast("long").cast("string")

    return F.concat(
        whole(seconds / 3600), F.lit("h "),
        whole((seconds % 3600) / 60), F.lit("m "),
        whole(seconds % 60), F.lit("s"),
    )


def scale_step(step: Column) -> Column:
    return step * STEPS_FACTOR


def run_label(run: Column, project: Column) -> Column:
    """``<run> - (<project>)``, with the logged-loss suffix taken off the run name."""
    return F.concat(F.replace(run, F.lit(LOSS_SUFFIX), F.lit("")), F.lit(" - ("), project, F.lit(")"))


def _extension(file: Column) -> Column:
    return F.substring_index(file, ".", -1)


def table_name(file: Column) -> Column:
    """File name without its extension, wherever the extension occurs in the name."""
    return F.replace(file, F.concat(F.lit("."), _extension(file)), F.lit(""))


def processed_name(file: Column, save: str = "jsonl") -> Column:
    """Name under which a normalised file is known: its extension is that of the saved form."""
    return F.replace(file, F.concat(F.lit("."), _extension(file)), F.lit("." + save))


def sql_text(sql: Column, fold_case: bool = False) -> Column:
    """A statement with blanks collapsed and the closing semicolon dropped."""
    text = F.regexp_replace(F.trim(F.regexp_replace(sql, r"\s+", " ")), r"[ ;]+$", "")
    return F.lower(text) if fold_case else text
