import random

import pytest
from pyspark.sql import functions as F

from sqlcorpus.operators.ordering import sliced
from sqlcorpus.operators import curves

# Least loss of each run and the band it falls in.
LEAST = {
    "rosy-cherry-2": (4.960893154144287, 1), "warm-rain-3": (4.706320285797119, 1),
    "swift-music-1": (4.61225700378418, 1), "nagus-phage-1": (4.472071170806885, 1),
    "divine-tree-1": (4.354540824890137, 1), "trill-quark-1": (4.345139503479004, 1),
    "desert-forest-1": (4.237284660339356, 1), "lunar-lake-1": (4.165835380554199, 1),
    "radiant-star-2": (4.0665459632873535, 1), "daily-glitter-1": (4.0209503173828125, 1),
    "astral-jazz-1": (3.2983438968658447, 1), "nagus-dukat-12": (3.247270107269287, 1),
    "jolly-waterfall-1": (1.7599588632583618, 2), "lively-deluge-2": (1.7022006511688232, 2),
    "dauntless-pine-2": (1.5823713541030884, 2), "quiet-lion-1": (1.551786184310913, 2),
    "avid-cosmos-4": (0.5823996663093567, 3), "winter-bird-1": (0.5127319693565369, 3),
    "fancy-vortex-1": (0.4749443233013153, 3), "graceful-lake-6": (0.4631605148315429, 3),
    "generous-wood-3": (4.1026250983e-06, 4), "floral-wave-1": (5.72803912746167e-07, 4),
}


def long(spark, data):
    return spark.createDataFrame([(r, i + 1, v) for r, vs in data.items() for i, v in enumerate(vs)],
                                 "run string, step long, loss double")


def test_known_runs_fall_in_their_bands(spark):
    got = curves.loss_bands(long(spark, {r: [9.0, least, least + 1] for r, (least, _) in LEAST.items()}))
    assert {r["run"]: r["band"] for r in got.collect()} == {r: band for r, (_, band) in LEAST.items()}


def test_borders_belong_to_both_bands(spark, rows):
    df = long(spark, {"a": [3.2], "b": [1.0], "c": [4e-4], "d": [3e-4], "e": [None]})
    assert rows(curves.loss_bands(df), "run", "band") == [
        ("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3), ("d", 4)]
    assert len(rows(curves.loss_bands(df, ((9, None, None, False),)))) == 5  # a band without ends holds every run
    assert rows(curves.band_curves(df, 2), "run", "loss") == [("a", 3.2), ("b", 1.0)]


def test_unpivot_and_pivot(spark, rows):
    wide = spark.createDataFrame(
        [(2, 0.5, 0.4, 9.0), (6, 0.25, 0.2, None)],
        "Step int, `sky-1 - eval/loss` double, `sky-1 - eval/loss__MIN` double, `sea-2 - eval/loss` double")
    got = curves.unpivot_curves(wide, ["Step"])
    assert rows(got) == [(2, "sea-2", 9.0), (2, "sky-1", 0.5), (6, "sky-1", 0.25)]
    assert rows(curves.unpivot_curves(wide, ["Step"], F.lit("P")), "run").count(("sky-1 - (P)",)) == 2
    assert rows(curves.pivot_curves(got, ["Step"], ["sky-1", "sea-2"])) == [(2, 0.5, 9.0), (6, 0.25, None)]


def test_axis_counts_rows_not_steps(spark, rows):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 6, 2.0), ("a", 7, 3.0), ("b", 40, 4.0)],
                               "run string, step long, loss double")
    assert rows(curves.curve_axis(df), "run", "step", "x") == [
        ("a", 2, 250), ("a", 6, 500), ("a", 7, 750), ("b", 40, 250)]


@pytest.mark.parametrize("cuts, least", [(1, 1), (50, 1), (1 << 16, 1 << 12)])
def test_description_is_the_same_however_runs_are_cut(spark, monkeypatch, cuts, least):
    monkeypatch.setattr(curves, "sliced", lambda *a, **k: sliced(*a, **k, least=least))
    rng = random.Random(4)
    data = {"big": [rng.choice([rng.random(), 0.5]) for _ in range(1001)], "wide": [10 ** rng.uniform(-6, 6) for _ in range(400)],
            "same": [2.0] * 90, "one": [7.0], "two": [1.0, 2.0], "holes": [None, 3.0, None, 1.0]}
    got = curves.describe_runs(long(spark, data), cuts).toPandas().set_index("run")
    import pandas as pd
    for run, losses in data.items():
        want = pd.Series(losses, dtype="float64").describe()
        for mine, theirs in (("n", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                             ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            if theirs == "std" and len([x for x in losses if x is not None]) == 1:
                assert pd.isna(got.loc[run, mine])
            else:
                assert got.loc[run, mine] == pytest.approx(want[theirs], rel=1e-12)
    order = [r["run"] for r in curves.runs_by_min(curves.describe_runs(long(spark, data), cuts)).collect()]
    assert order[0] == "one" and order[1] == "same"
