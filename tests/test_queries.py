"""Every registered query against its SQL, and what their plans must not contain."""

import os
import re

import pytest

import __spark_entry__ as contract
from sqlcorpus.plans import oracle, queries as library
from oracle_check import database, differs

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no given tables here")
NAMES = sorted(library.queries())


@pytest.fixture(scope="module")
def con(spark):
    yield database(SMALL)
    for found in spark.catalog.listDatabases("q_*"):  # in which queries store their tables
        spark.sql(f"DROP DATABASE `{found.name}` CASCADE")


def test_every_query_has_sql():
    assert set(oracle.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    views = spark.catalog.listTables()
    assert differs(spark, con, SMALL, name) is None
    assert spark.catalog.listTables() == views


def test_a_class_is_read_from_its_folders_alone(spark):
    text = plan(contract.queries()["filter_class"](spark, SMALL))
    assert "PartitionFilters: [isnotnull(class" in text and "generation" in text and "texts" in text


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plans_stay_on_the_jvm_and_cross_nothing(spark, name):
    text = plan(contract.queries()[name](spark, SMALL))
    for bad in ("PythonUDF", "EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct",
                "BroadcastNestedLoopJoin", "GlobalLimit 1000"):
        assert bad not in text


def scans(df):
    return re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name, pushed", [
    ("golden_filter_lt", "LessThan(c_acctbal,0.0)"),
    ("golden_string_eq", "EqualTo(c_mktsegment,BUILDING)"),
    ("golden_date_eq", "GreaterThanOrEqual(o_orderdate,1997-01-15T00:00)"),
    ("golden_like", "StringEndsWith(c_name,7)"),
    ("filter_source_in", "In(source, [src2,src3,src5])"),
    ("drop_null_loss", "EqualTo(role,assistant)"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    text = plan(contract.queries()[name](spark, SMALL))
    assert pushed in text


def test_only_needed_columns_are_read(spark):
    read = scans(contract.queries()["golden_revenue"](spark, SMALL))
    assert sorted(sum((re.findall(r"([a-z]_[a-z]+)#", columns) for columns, _ in read), [])) == [
        "l_partkey", "l_quantity", "p_partkey", "p_retailprice"]


def test_templates_of_a_class_share_one_scan_of_the_texts(spark):
    """Texts of documents are read once for all generation prompts and once for the instruct ones."""
    text = contract.queries()["datasets_long"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    wide = [s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", text) if "doc_id" in s and "text#" in s]
    assert len(wide) == 2

