import hashlib
import math

import pytest

from sqlcorpus.operators.split import eval_rows, split_counts, train_test_split


def keyed(spark, n):
    return spark.range(n).selectExpr("concat('src:', id) key", "id")


def by_hand(n, seed):
    keys = [f"src:{i}" for i in range(n)]
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}#{seed}".encode()).hexdigest(), k))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 333, 3000])
def test_split_is_exact(spark, n):
    sides = {r["key"]: r["side"] for r in train_test_split(keyed(spark, n), "key", 5).collect()}
    n_test = math.ceil(0.3 * n)
    order = by_hand(n, 5)
    assert {k for k, s in sides.items() if s == "test"} == set(order[:n_test])
    assert {k for k, s in sides.items() if s == "train"} == set(order[n_test:])


def test_split_does_not_depend_on_partitions_and_follows_the_seed(spark, rows):
    df = keyed(spark, 500)
    first = rows(train_test_split(df, "key", 1))
    assert first == rows(train_test_split(df.repartition(7), "key", 1))
    assert first != rows(train_test_split(df, "key", 2))


@pytest.mark.parametrize("n, expected", [(40, 12), (5000, 1000)])
def test_eval_cap(spark, n, expected):
    got = {r["key"] for r in eval_rows(keyed(spark, n), "key", 3).collect()}
    assert got == set(by_hand(n, 3)[:expected])


def test_counts(spark, rows):
    assert rows(split_counts(train_test_split(keyed(spark, 101), "key"))) == [("test", 31), ("train", 70)]
    assert split_counts(train_test_split(keyed(spark, 0), "key")).count() == 0


def test_rows_stay_where_they_are(spark):
    """The split itself adds no shuffle to the rows; only the border search has some."""
    plan = train_test_split(keyed(spark, 100), "key")._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
