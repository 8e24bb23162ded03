"""Column layouts and fixed values shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

# A missing field is this four-letter text, not SQL NULL: NULL would erase the
# whole prompt when the pieces are concatenated.
MISSING = "NULL"

GENERATION = "generation"
INSTRUCT = "instruct"

GENERATION_COLUMNS = ("question", "context", "answer", "extra")
INSTRUCT_COLUMNS = ("text", "input", "output")

GENERATION_TABLE = "raw_text_generation"
INSTRUCT_TABLE = "raw_instructs"
ALL_TABLE = "all_datasets"
DATASET_PREFIX = "dataset_"

# Names that the store gives its own columns.
TAKEN = frozenset(("class", "folder", "_path", "_file", "_block", "_row", "_lane", "_scan"))


def shielded(name: str) -> str:
    """A data column's name in the store: one underscore longer if the name, or that with underscores, is taken."""
    return name + "_" if name.lower().rstrip("_") in TAKEN else name


def unshielded(name: str) -> str:
    return name[:-1] if name.endswith("_") and name.lower().rstrip("_") in TAKEN else name


# CSV cells that mean "missing" (the empty cell counts as well).
CSV_NA_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Display name of each dataset and the name it is stored under.
DISPLAY_NAMES = {
    "Chatbot dataset": "chatbot",
    "Chatbot instruct dataset": "chatbot_instruct",
    "System Prompt dataset": "sys_prompt",
    "Text completition dataset": "text_completition",
    "Text generation dataset": "text_generation",
    "Instruct dataset": "text_instruct",
    "Translation dataset": "translation",
}

# Fixed value: evaluation ran every 250 steps.
STEPS_FACTOR = 250

# Loss bands (band, least, greatest, greatest included). Both ends
# of neighbouring bands belong to both.
LOSS_BANDS = (
    (1, 3.2, None, False),
    (2, 1.0, 3.2, True),
    (3, 4e-4, 1.0, True),
    (4, None, 4e-4, False),
)

# How a logged loss column is named.
LOSS_SUFFIX = " - eval/loss"

# Score sheet file stem and the criterion it holds.
CRITERIA = {
    "consulta-sin-errores": "no_errors",
    "campos_recuperados_good": "right_fields",
    "tabla_correcta": "right_table",
    "similaridad-esperada": "similarity",
    "complejidad-extra": "extra_complexity",
}

GOLDEN_TEST = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("accepted", T.StringType()),
])
GOLDEN_TESTS = T.MapType(T.StringType(), GOLDEN_TEST)
PREDICTIONS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
MODELS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("isCausal", T.BooleanType()),
    T.StructField("isLocal", T.BooleanType()),
]))
PROVIDER = T.StructType([
    T.StructField("base_url", T.StringType()),
    T.StructField("datasets", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
    ]))),
])
