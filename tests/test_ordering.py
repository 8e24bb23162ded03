import random

import pytest
from pyspark.sql import functions as F

from sqlcorpus.operators.ordering import (
    descending_rank, group_bases, nested_position, nested_totals, position, position_in_many, running_total, sliced,
)


def frame(spark, n=600, seed=1):
    """Rows with one hot group and one hot major, keys far from evenly spread."""
    rng = random.Random(seed)
    keys = rng.sample(range(-(10 ** 6), 10 ** 9), n)
    rows = [("hot" if i % 3 else f"g{i % 7}", 5 if i % 2 else i % 11, k, rng.randint(0, 4)) for i, k in enumerate(keys)]
    rows.append(("hot", 5, 2 ** 52, 1))  # an outlier leaves almost all rows in one slice
    return spark.createDataFrame(rows, "g string, major long, k long, w long")


@pytest.mark.parametrize("cuts", [1, 7, 1 << 16])
def test_position(spark, cuts):
    got = position(frame(spark), ["g"], F.col("k"), ["k"], "p", cuts=cuts).toPandas().sort_values(["g", "k"])
    assert (got["p"] == got.groupby("g").cumcount()).all() and len(got) == 601
    got = position(frame(spark), [], F.col("k"), ["k"], "p", cuts=cuts).toPandas().sort_values("k")
    assert list(got["p"]) == list(range(601))


@pytest.mark.parametrize("hot_rows", [0, 60, 10 ** 6])
def test_position_in_many(spark, hot_rows):
    got = position_in_many(frame(spark), ["g"], F.col("k"), ["k"], "p", hot_rows, 7).toPandas().sort_values(["g", "k"])
    assert (got["p"] == got.groupby("g").cumcount()).all() and len(got) == 601


@pytest.mark.parametrize("hot_rows", [0, 60, 10 ** 6])
@pytest.mark.parametrize("cuts", [1, 7, 1 << 16])
def test_nested_position(spark, cuts, hot_rows):
    got = nested_position(frame(spark), [], "major", "k", "p", hot_rows, cuts).toPandas().sort_values(["major", "k"])
    assert list(got["p"]) == list(range(601))
    got = nested_position(frame(spark), ["g"], "major", "k", "p", hot_rows, cuts).toPandas()
    got = got.sort_values(["g", "major", "k"])
    assert (got["p"] == got.groupby("g").cumcount()).all()


def test_bases_make_groups_lie_end_to_end(spark):
    df = frame(spark)
    bases = group_bases(df.groupBy("g").agg(F.count("*").alias("n")), "g")
    for made, order in (
        (position(df, ["g"], F.col("k"), ["k"], "p", base=bases), ["g", "k"]),
    ):
        assert list(made.toPandas().sort_values(order)["p"]) == list(range(601))


@pytest.mark.parametrize("cuts", [1, 7, 1 << 16])
def test_running_total(spark, cuts):
    got = running_total(frame(spark), ["g"], "k", "w", "t", cuts).toPandas().sort_values(["g", "k"])
    assert (got["t"] == got.groupby("g")["w"].cumsum() - got["w"]).all()
    got = running_total(frame(spark), [], "k", "w", "t", cuts).toPandas().sort_values("k")
    assert (got["t"] == got["w"].cumsum() - got["w"]).all()


@pytest.mark.parametrize("hot_rows", [0, 60, 10 ** 6])
@pytest.mark.parametrize("cuts", [7, 1 << 16])
def test_totals_and_followers_in_one_go(spark, hot_rows, cuts):
    df = frame(spark).withColumn("side", F.col("major") % 2)
    totals = {"all": [], "by_side": ["side"]}
    got = nested_totals(df, "major", "k", "w", totals, "next", hot_rows, cuts).toPandas().sort_values(["major", "k"])
    assert len(got) == 601
    assert (got["all"] == got["w"].cumsum() - got["w"]).all()
    assert (got["by_side"] == got.groupby("side")["w"].cumsum() - got["w"]).all()
    want = got.groupby("major")["k"].shift(-1)
    assert (got["next"].isna() == want.isna()).all() and (got["next"].dropna() == want.dropna()).all()
    alone = nested_totals(df, "major", "k", "w", {}, "next", hot_rows, cuts).toPandas().sort_values(["major", "k"])
    assert (alone["next"].fillna(-1).to_numpy() == want.fillna(-1).to_numpy()).all()


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("rounds, keys", [
    (1, [1e15, -1e300, NAN, INF, -INF, 0.0, -0.0] + list(range(20_000))),
    (3, [1e15, NAN] + [1.7e9 + i * i / 1e4 for i in range(20_000)]),
    (1, [-(1.001 ** i) for i in range(20_000)]),
    (2, [1e6 + i * 1e-6 for i in range(10_000)] + [1e6 + i / 10_000 for i in range(10_000)] + [5.0, 1e15]),
])
def test_slices_hold_about_equal_numbers_of_rows(spark, rounds, keys):
    """Far, infinite and crowded keys leave no slice with twice the mean; slices follow the keys."""
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(float(k),) for k in keys], "k double")
    got = sliced(df, F.col("k"), cuts=64, least=1, rounds=rounds)
    sizes = got.groupBy("_slice").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_slice").collect()
    assert sum(r["n"] for r in sizes) == len(keys) and len(sizes) >= 48
    assert max(r["n"] for r in sizes) < 2 * len(keys) / 64
    finite = [r for r in sizes if r["lo"] == r["lo"]]
    assert all(a["hi"] <= b["lo"] for a, b in zip(finite, finite[1:]) if a["hi"] == a["hi"])


def test_descending_rank_shares_ties(spark, rows):
    df = spark.createDataFrame([("a", 5), ("b", 7), ("c", 5), ("d", 1), ("e", 7)], "m string, s int")
    assert rows(descending_rank(df, "s", "r"), "m", "r") == [("a", 3), ("b", 1), ("c", 3), ("d", 5), ("e", 1)]


def test_single_row_and_nothing(spark):
    one = spark.createDataFrame([("g", 3, 1)], "g string, k long, w long")
    assert position(one, [], F.col("k"), ["k"], "p").first()["p"] == 0
    none = one.filter("w > 5")
    assert position(none, ["g"], F.col("k"), ["k"], "p").count() == 0
    assert running_total(none, [], "k", "w", "t").count() == 0
