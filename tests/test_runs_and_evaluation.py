import glob

import pytest

from sqlcorpus.operators import evaluate, runs
from sqlcorpus.schemas import CRITERIA
from sqlcorpus.sinks.files import write_csv


def test_run_summary(spark, rows):
    records = spark.createDataFrame(
        [("sky-1", "P", 0.5, 1e-4, 114, 9464.7), ("sea-2", "P", None, 1e-4, 3, 5.0), ("sun-3", "Q", 0.1, 2e-4, 1, 61.0)],
        "run string, project string, `eval/loss` double, `train/learning_rate` double, _step long, _runtime double")
    labelled = runs.label_runs(records)
    allowed = spark.createDataFrame([("sky-1 - (P)",), ("sea-2 - (P)",), ("no - (P)",)], "name string")
    assert rows(runs.run_summary(labelled, allowed)) == [("sky-1 - (P)", 0.5, 1e-4, 28500, "2h 37m 44s")]
    assert rows(runs.run_summary(labelled), "name") == [("sky-1 - (P)",), ("sun-3 - (Q)",)]
    assert runs.run_summary(labelled).columns == ["name", "eval/loss", "train/learning_rate", "_step", "runtime_hms"]


def test_summary_sink(spark, tmp_path):
    records = spark.createDataFrame(
        [("sky-1 - (P)", 0.5, 1e-4, 114, 9464.7)],
        "name string, `eval/loss` double, `train/learning_rate` double, _step long, _runtime double")
    write_csv(runs.run_summary(records), str(tmp_path / "summary"))
    lines = {line for f in glob.glob(str(tmp_path / "summary" / "*.csv")) for line in open(f).read().splitlines()}
    assert lines == {"name,eval/loss,train/learning_rate,_step,runtime_hms", "sky-1 - (P),0.5,1.0E-4,28500,2h 37m 44s"}


def test_leaderboard(spark, rows):
    criteria = list(CRITERIA.values())
    sheets = [(c, m, s) for m, scores in (("x", (10, 9, 9, 9, 2)), ("y", (10, 9, 10, 10, 2)), ("z", (10, 10, 10, 10, 1)))
              for c, s in zip(criteria, scores)] + [(criteria[0], "w", 3)]
    board = evaluate.leaderboard(spark.createDataFrame(sheets, "criterion string, model string, score int"), criteria)
    assert rows(board, "model", "total", "place") == [("w", 3, 4), ("x", 39, 3), ("y", 41, 1), ("z", 41, 1)]
    assert rows(board, "model", "no_errors", "extra_complexity")[0] == ("w", 3, None)

    summary = spark.createDataFrame([("x", 0.5)], "name string, `eval/loss` double")
    assert rows(evaluate.score_vs_loss(board, summary)) == [("w", 3, None), ("x", 39, 0.5), ("y", 41, None), ("z", 41, None)]


def test_prediction_match(spark):
    golden = spark.createDataFrame([
        ("0", "SELECT * FROM Users WHERE id < 5", None),
        ("2", "SELECT * FROM Orders WHERE DATE = DATE()", "SELECT * FROM Orders WHERE DATE = DATE('now')"),
        ("4", "SELECT 1 WHERE n = 'Books';", None),
    ], "test_id string, expected string, accepted string")
    answers = spark.createDataFrame([
        ("m1", "0", "select * from users where id < 5;"), ("m1", "2", "SELECT *  FROM Orders\nWHERE DATE = DATE('now');"),
        ("m3", "4", "SELECT 1 WHERE n = 'Books'"),  # the others it leaves out
        ("m1", "4", "select 1 where n = 'books'"), ("m2", "0", "SELECT * FROM Users"), ("m2", "2", None),
    ], "model string, test_id string, sql string")
    got = {r["model"]: tuple(r)[1:] for r in evaluate.prediction_match(golden, answers).collect()}
    assert got["m1"] == (3, 1, 3, pytest.approx(1 / 3), 1.0)
    assert got["m2"] == (2, 0, 0, 0.0, 0.0)
    assert got["m3"] == (1, 1, 1, pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_resultset_diff_counts_copies(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "a int, b string")
    b = spark.createDataFrame([("ignored", 1, "x"), ("i", 2, None), ("i", 2, None)], "i string, c int, d string").drop("i")
    assert rows(evaluate.resultset_diff(a, b)) == [(1, "x", 1, 0), (2, None, 0, 1), (3, "z", 1, 0)]
    assert evaluate.same_result(a, a.repartition(3).toDF("p", "q"))
    assert not evaluate.same_result(a, a.distinct())
    with pytest.raises(ValueError):
        evaluate.resultset_diff(a, b.select("c"))


def test_registry_names(spark, rows):
    models = spark.createDataFrame([("owner/sky-7b",), ("sky-1 - (P)",)], "name string")
    assert rows(evaluate.registry_names(models), "model") == [("sky-1 - (P)",), ("sky-7b",)]
