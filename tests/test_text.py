import pytest
from pyspark.sql import functions as F

from sqlcorpus.functions import (
    duration_text, join_present, processed_name, prompt, requote, run_label, scale_step, sql_text,
    table_name, tagged_sections,
)


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema or "x string").select(expression).first()[0]


def test_requote_touches_double_quotes_only(spark):
    assert one(spark, requote(F.col("x")), x="""a "b" 'c'""") == "a 'b' 'c'"


def test_prompt_is_null_if_a_part_is_null(spark):
    both = prompt("<", F.col("x"), "> ", F.col("y"))
    assert one(spark, both, x="a", y="b") == "<a> b"
    assert one(spark, both, x="a", y=None) is None


def test_join_present_skips_nulls(spark):
    assert one(spark, join_present([F.col("x"), F.col("y")]), x=None, y="b") == "b"
    assert one(spark, join_present([F.col("x"), F.col("y")]), x=None, y=None) == ""


@pytest.mark.parametrize("text, question, answer, context", [
    ("x###question:q1\nq###answer:a###context:c\n", "q1\nq", "a", "c"),
    ("###question:###answer:###context:", "", "", ""),
    ("###question:q###answer:a###context:c\n\n", "q", "a", "c\n"),
    ("###question:q###answer:a###context:c\r\n", "q", "a", "c\r"),
    ("###question:q###answer:a1###answer:a2###context:c1###context:c2", "q", "a1###answer:a2", "c1###context:c2"),
    ("nope", None, None, None),
    (None, None, None, None),
])
def test_tagged_sections(spark, text, question, answer, context):
    found = tagged_sections(F.col("x"))
    row = spark.createDataFrame([(text,)], "x string").select(*(found[k].alias(k) for k in found)).first()
    assert (row["question"], row["answer"], row["context"]) == (question, answer, context)


@pytest.mark.parametrize("seconds, text", [
    (0.0, "0h 0m 0s"), (59.9, "0h 0m 59s"), (3600.0, "1h 0m 0s"), (9464.2, "2h 37m 44s"), (523698.0, "145h 28m 18s"),
])
def test_duration_text(spark, seconds, text):
    assert one(spark, duration_text(F.col("s")), s=seconds) == text


def test_run_label_and_step(spark):
    assert one(spark, run_label(F.col("r"), F.col("p")), r="sky-1 - eval/loss", p="gpt2_X") == "sky-1 - (gpt2_X)"
    assert one(spark, scale_step(F.col("s")), s=4.0) == 1000.0


@pytest.mark.parametrize("file, table, stored", [
    ("train.csv", "train", "train.jsonl"),
    ("a.csv-b.csv", "a-b", "a.jsonl-b.jsonl"),
    ("x{ign}.json", "x{ign}", "x{ign}.jsonl"),
    ("A.CSV", "A", "A.jsonl"),
])
def test_names_from_files(spark, file, table, stored):
    assert one(spark, table_name(F.col("f")), f=file) == table
    assert one(spark, processed_name(F.col("f")), f=file) == stored


@pytest.mark.parametrize("sql, plain, folded", [
    (" SELECT  *\n FROM t ; ", "SELECT * FROM t", "select * from t"),
    ("SELECT ';' FROM t;;", "SELECT ';' FROM t", "select ';' from t"),
])
def test_sql_text(spark, sql, plain, folded):
    assert one(spark, sql_text(F.col("s")), s=sql) == plain
    assert one(spark, sql_text(F.col("s"), True), s=sql) == folded
