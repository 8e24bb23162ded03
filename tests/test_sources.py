import json
import random

import pytest

from sqlcorpus.schemas import CSV_NA_TOKENS
from sqlcorpus.sources import catalog
from sqlcorpus.sources.files import json_columns, read_csv, read_json, read_jsonl, read_parquet
from sqlcorpus.sources.large_csv import read_large_csv
from sqlcorpus.sources.runs import curve_source, read_run_records, score_sheets


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv_quotes_line_ends_and_spelling(spark, tmp_path):
    file = put(tmp_path / "a.csv", 'q,c,n\n"say ""hi"", ok","line1\nline2",1.50\n')
    assert tuple(read_csv(spark, file).first()) == ('say "hi", ok', "line1\nline2", "1.50")


def test_csv_na_tokens(spark, tmp_path):
    cells = ["", '""', *CSV_NA_TOKENS, "Null", "none", " NA"]
    file = put(tmp_path / "na.csv", "i,v\n" + "".join(f"{i},{c}\n" for i, c in enumerate(cells)))
    got = {int(r["i"]): r["v"] for r in read_csv(spark, file).collect()}
    assert len(got) == len(cells)
    assert [v for _, v in sorted(got.items())] == [None] * (2 + len(CSV_NA_TOKENS)) + ["Null", "none", " NA"]
    kept = read_csv(spark, file, na_values=()).filter("v = 'NULL'").count()
    assert kept == 1


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("piece", [64, 1000, 1 << 20])
def test_large_csv_equals_the_whole_file_read(spark, tmp_path, line_end, piece):
    rng = random.Random(9)
    cells = ["plain", "", "NA", 'say "hi"', "two\nlines", '"\n"', "a,b", "end\n", "  ", "x" * 70, '""\n\n""', "é\nü"]
    files = []
    for name in ("a", "b"):
        lines = ["q,c,a"]
        for _ in range(300):
            row = [rng.choice(cells) for _ in range(3)]
            lines.append(",".join('"' + v.replace('"', '""') + '"' if rng.random() < .5 or any(x in v for x in '",\n') else v
                                  for v in row))
            if rng.random() < .1:
                lines.append("")
        files.append(str(tmp_path / f"{name}.csv"))
        with open(files[-1], "w", newline="") as f:
            f.write(line_end.join(x.replace("\n", line_end) for x in lines) + (line_end if name == "a" else ""))
    limits = {"spark.sql.files.maxPartitionBytes": str(piece), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        cut = read_large_csv(spark, files, ("q", "c", "a"), CSV_NA_TOKENS, provenance=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = read_csv(spark, files, provenance=True).orderBy("_path", "_row").collect()
    cut.sort(key=lambda r: (r["_file"], r["_row"]))
    assert [(r["_file"], r["q"], r["c"], r["a"]) for r in cut] == [(r["_file"], r["q"], r["c"], r["a"]) for r in whole]
    assert [r["_row"] for r in cut] == [i for name in "ab" for i in range(sum(r["_file"] == f"{name}.csv" for r in whole))]


def test_json_columns_keep_document_order(spark, tmp_path):
    file = put(tmp_path / "a.json", '[{"z": 1, "b": true, "a": 1.0},\n {"b": null, "k": {"y": 1, "x": [2]}, "z": "t"}]')
    df = read_json(spark, file)
    assert df.columns == ["z", "b", "a", "k"]
    placed = read_json(spark, file, provenance=True).orderBy("_row").select(*df.columns)
    assert [tuple(r) for r in placed.collect()] == [("1", "true", "1.0", None), ("t", None, None, '{"y": 1, "x": [2]}')]


def test_jsonl_columns_come_from_first_sight_over_all_lines(spark, tmp_path):
    lines = [{"z": 1}] * 300 + [{"b": 2, "z": 1}, {"a": 3, "b": 2}]
    file = put(tmp_path / "a.jsonl", "".join(json.dumps(x) + "\n" for x in lines))
    df = read_jsonl(spark, file)
    assert df.columns == ["z", "b", "a"]
    assert df.count() == 302
    assert df.filter("a = '3' and z is null").count() == 1


def test_files_of_one_scan_must_agree(spark, tmp_path):
    one, two = put(tmp_path / "1.jsonl", '{"a": 1}\n'), put(tmp_path / "2.jsonl", '{"b": 1}\n')
    assert sorted(json_columns(spark, [one, two], "jsonl").values()) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        read_jsonl(spark, [one, two])
    assert read_jsonl(spark, [one, two], ["b", "a"]).columns == ["b", "a"]


def test_provenance_follows_the_file(spark, tmp_path):
    spark.range(0, 100, 1, 1).write.parquet(str(tmp_path / "p"))
    df = read_parquet(spark, str(tmp_path / "p"), provenance=True)
    assert [r["id"] for r in df.orderBy("_path", "_block", "_row").collect()] == list(range(100))


def test_manifest(spark, tmp_path, rows):
    manifest = {
        "huggingface-datasets": {"base_url": "https://host/datasets", "datasets": [
            {"name": "owner/repo", "files": ["train.csv", "data/x.parquet", "data/deep/y.parquet"]},
            {"name": "plain", "files": ["a.json"]},
        ]},
        "kaggle-datasets": {"base_url": "https://k", "datasets": ["a/b"]},
    }
    file = put(tmp_path / "m.json", json.dumps(manifest, indent=1))
    found = catalog.source_catalog(catalog.read_manifest(spark, file))
    assert rows(found, "url", "local_name") == sorted([
        ("https://host/datasets/owner/repo/resolve/main/train.csv?download=true", "repo-train.csv"),
        ("https://host/datasets/owner/repo/resolve/main/data/x.parquet?download=true", "repo-x.parquet"),
        ("https://host/datasets/owner/repo/resolve/main/data/deep/y.parquet?download=true", "repo-deep"),
        ("https://host/datasets/plain/resolve/main/a.json?download=true", "plain-a.json"),
    ])


def test_evaluation_documents(spark, tmp_path, rows):
    tests = put(tmp_path / "t.json", json.dumps({
        "0": {"input": "i", "context": "", "expected": "e"},
        "2": {"input": "j", "context": "c", "expected": "f", "accepted": "g"}}, indent=2))
    assert rows(catalog.read_golden_tests(spark, tests)) == [
        ("0", "i", "", "e", None), ("2", "j", "c", "f", "g")]
    answers = put(tmp_path / "r.json", json.dumps({"m1": {"0": "x", "2": "y"}, "m2": {"0": "z"}}))
    assert rows(catalog.read_predictions(spark, answers)) == [("m1", "0", "x"), ("m1", "2", "y"), ("m2", "0", "z")]
    registry = put(tmp_path / "m.json", json.dumps([{"name": "o/n", "isCausal": True, "isLocal": False}]))
    assert rows(catalog.read_models(spark, registry)) == [("o/n", True, False)]


def test_curve_sheets(spark, tmp_path, rows):
    one = put(tmp_path / "gpt_X.csv", '"Step","sky-1 - eval/loss","sky-1 - eval/loss__MIN","sea-2 - eval/loss"\n'
                                      '"2","0.5","0.4","9"\n"6","0.25","0.2",""\n')
    two = put(tmp_path / "t5_Y.csv", '"Step","sun-3 - eval/loss"\n"2","1e-5"\n')
    skipped = put(tmp_path / "summary.csv", "name\nx\n")
    assert rows(curve_source(spark, [one, two, skipped])) == [
        ("sea-2 - (gpt_X)", 2, 9.0), ("sky-1 - (gpt_X)", 2, 0.5), ("sky-1 - (gpt_X)", 6, 0.25),
        ("sun-3 - (t5_Y)", 2, 1e-5)]


def test_run_records_and_score_sheets(spark, tmp_path, rows):
    records = put(tmp_path / "runs.jsonl", '{"run": "sky-1", "project": "P", "eval/loss": 0.5, "_step": 3, "other": {}}\n')
    assert tuple(read_run_records(spark, records).first()) == ("sky-1", "P", 0.5, None, 3, None)
    put(tmp_path / "tabla_correcta.csv", ",Model,Score\n0,m1,9\n1,m2,10\n")
    put(tmp_path / "own.csv", ",Model,Score\n0,m1,2\n")
    found = score_sheets(spark, [str(tmp_path / "tabla_correcta.csv"), str(tmp_path / "own.csv")])
    assert rows(found) == [("own", "m1", 2), ("right_table", "m1", 9), ("right_table", "m2", 10)]


def test_names_are_kept_as_they_are(spark, tmp_path):
    from sqlcorpus.plans.corpus import normalize_sources

    (tmp_path / "f").mkdir()
    put(tmp_path / "f" / "a b.csv", "q,c,a\n1,2,3\n")
    put(tmp_path / "f" / "a%20b.jsonl", '{"question": "1", "context": "2", "answer": "3"}\n')
    put(tmp_path / "f" / "a#b+c.json", '[{"question": "1", "context": "2", "answer": "3"}]')
    found = normalize_sources(spark, str(tmp_path)).select("source", "folder").collect()
    assert sorted(map(tuple, found)) == [("a b.jsonl", "f"), ("a#b+c.jsonl", "f"), ("a%20b.jsonl", "f")]


def test_broken_lines_are_an_error(spark, tmp_path):
    broken = put(tmp_path / "x.jsonl", '{"question": "1"}\n{"question": \n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|alformed"):
        read_jsonl(spark, broken, ["question"]).collect()


def test_a_file_without_columns_is_an_error(spark, tmp_path):
    from sqlcorpus.plans.corpus import normalize_sources

    (tmp_path / "f").mkdir()
    put(tmp_path / "f" / "blank.jsonl", "\n")
    with pytest.raises(ValueError, match="no columns"):
        normalize_sources(spark, str(tmp_path))
