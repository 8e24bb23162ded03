"""Prompt datasets as data: each template is a list of literals and fields.

All prompts of one class of rows are built by a single scan: a row is exploded
into one (dataset, text) pair per template that wants it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus.functions import prompt, requote
from sqlcorpus.operators.consolidate import source_in, unite
from sqlcorpus.schemas import DISPLAY_NAMES, GENERATION, INSTRUCT


@dataclass(frozen=True)
class Field:
    name: str
    requoted: bool = False

    def column(self) -> Column:
        return requote(F.col(self.name)) if self.requoted else F.col(self.name)


@dataclass(frozen=True)
class Template:
    dataset: str
    rows: str
    parts: tuple[str | Field, ...]
    sources: str | None = None  # name of the group of sources it reads, None for all

    def text(self) -> Column:
        return prompt(*(p.column() if isinstance(p, Field) else p for p in self.parts))


QUESTION = Field("question")
CONTEXT, ANSWER = Field("context", True), Field("answer", True)
TEXT, INPUT, OUTPUT = Field("text"), Field("input"), Field("output")
SYSTEM_PROMPT = "system prompt"

# The literals and their order are the format the models expect.
TEMPLATES = (
    Template("text_generation", GENERATION,
             (QUESTION, " ", Field("context"), " ", Field("answer"))),
    Template("text_completition", GENERATION,
             ("### Instruction: ", QUESTION, " ### Input: ", CONTEXT, " ### Response: ", ANSWER)),
    Template("text_completition", INSTRUCT, (INPUT, OUTPUT), "completion"),
    Template("chatbot", GENERATION,
             ("### Human: ", QUESTION, " ", CONTEXT, "### Assistant: ", ANSWER)),
    Template("chatbot_instruct", GENERATION,
             ("<|system|> You are a chatbot who can help making SQL queries!</s> <|user|> ",
              QUESTION, " ", CONTEXT, "</s> <|assistant|>", ANSWER)),
    Template("text_instruct", GENERATION,
             ("<s> [INST] ", QUESTION, " The context is: ", CONTEXT, " [/INST] ", ANSWER, "</s>")),
    Template("text_instruct", INSTRUCT, (TEXT,), "finished"),
    Template("text_instruct", INSTRUCT, ("<s> ", INPUT, " ", OUTPUT, "</s>"), "paired"),
    Template("text_instruct", INSTRUCT, ("<s> ", TEXT, "</s>"), "bare"),
    Template("translation", GENERATION,
             ("Translate to SQL: ", QUESTION, " ", CONTEXT, " SQL: ", ANSWER)),
    Template("sys_prompt", SYSTEM_PROMPT, (TEXT,)),
)

# The normalised files each group reads.
NAMED_SOURCES = {
    "completion": (
        "Llama-2-SQL-Dataset-eval-00000-of-00001-6907aec719559d7d.jsonl",
        "Llama-2-SQL-Dataset-train-00000-of-00001-922416e34c5bc71c.jsonl",
        "Llama-2-SQL-Dataset-val-00000-of-00001-98c87bd893ed1bdb.jsonl",
    ),
    "finished": ("llama2-sql-instruct-train.jsonl",),
    "paired": (
        "spider_text_to_sql-train-00000-of-00001-36a24700f19484dc.jsonl",
        "spider_text_to_sql-validation-00000-of-00001-fa01d04c056ac579.jsonl",
    ),
    "bare": ("sql-create-context-instruction-train-00000-of-00001-ea1a61c2db38e8fc.jsonl",),
    SYSTEM_PROMPT: ("llama2-sql-instruct-sys-prompt-train.jsonl",),
}

# Classes of rows, and whether their rows carry an index.
ROW_KINDS = {GENERATION: True, INSTRUCT: True, SYSTEM_PROMPT: False}

DATASETS = tuple(sorted(DISPLAY_NAMES.values()))

# Name of a rendered row's key: class of rows, number of the template in its dataset, index of the row.
ROW_KEY = "row_key"
# Name of the number that the prompts of a row share with those of some more rows of its task, at most two to the power of PART_BITS.
PART = "part"
PART_BITS = 11


class RenderSource(Protocol):
    """What the datasets are rendered from."""

    sources: dict[str, tuple[str, ...]]
    index: str

    def rows(self, kind: str) -> DataFrame: ...


@dataclass(frozen=True)
class CorpusTables:
    """The consolidated tables."""

    generation: DataFrame
    instruct: DataFrame
    system_prompt: DataFrame
    sources: dict[str, tuple[str, ...]]
    index: str = "index"

    def rows(self, kind: str) -> DataFrame:
        return {GENERATION: self.generation, INSTRUCT: self.instruct, SYSTEM_PROMPT: self.system_prompt}[kind]


def _row_key(template: Template, kind: str, index: str) -> Column:
    """Unique in a dataset, where the index repeats between classes and templates."""
    number = [t for t in TEMPLATES if t.dataset == template.dataset].index(template)
    return F.concat(F.lit(f"{kind}:{number}:"), F.col(index))


def dataset(name: str, tables: RenderSource, keyed: bool = False) -> DataFrame:
    """One dataset: ``index`` and ``text``, or ``text`` alone for the system prompts; ``keyed`` puts ``row_key`` in front."""
    branches = []
    for kind, index in ROW_KINDS.items():
        templates = [t for t in TEMPLATES if t.dataset == name and t.rows == kind]
        if templates:
            keep = [tables.index] if index else []
            branches.append(_render(tables.rows(kind), templates, tables, kind, keep, keyed, False).drop("dataset"))
    if not branches:
        raise KeyError(f"no dataset named {name!r}")
    return unite(branches)


def _render(
    rows: DataFrame, templates: list[Template], tables: RenderSource, kind: str, keep: list[str], keyed: bool, parted: bool
) -> DataFrame:
    """Every given template over one scan of the class."""
    named = sorted({s for t in templates if t.sources for s in tables.sources[t.sources]})
    if named:
        rows = rows.filter(source_in(*named))
    if parted:
        rows, keep = rows.withColumn(PART, F.shiftright(F.monotonically_increasing_id(), PART_BITS)), [*keep, PART]

    def key(template: Template) -> list[Column]:
        return [_row_key(template, kind, tables.index).alias(ROW_KEY)] if keyed else []

    if len(templates) == 1:
        only = templates[0]
        return rows.select(F.lit(only.dataset).alias("dataset"), *key(only), *keep, only.text().alias("text"))
    pairs = []
    for template in templates:
        pair = F.struct(F.lit(template.dataset).alias("dataset"), *key(template), template.text().alias("text"))
        if template.sources:
            pair = F.when(source_in(*tables.sources[template.sources]), pair)
        pairs.append(pair)
    made = F.array_compact(F.array(*pairs)) if named else F.array(*pairs)
    keys = [f"_made.{ROW_KEY}"] if keyed else []
    return rows.select(*keep, F.explode(made).alias("_made")).select("_made.dataset", *keys, *keep, "_made.text")


def datasets_long(tables: RenderSource, keyed: bool = False, parted: bool = False) -> DataFrame:
    """All datasets as (dataset, index, source, text), each class scanned once; ``keyed`` adds ``row_key``, ``parted`` adds ``part``."""
    return unite([
        _render(tables.rows(kind), [t for t in TEMPLATES if t.rows == kind], tables, kind,
                [tables.index, "source"] if index else [], keyed, parted)
        for kind, index in ROW_KINDS.items()
    ])
