"""Names that look like patterns, headers, arrays and quotes cut anywhere, and columns named like the store's own."""

import json
import os
import random
import warnings
from contextlib import contextmanager

import pytest

from sqlcorpus.operators.consolidate import index_in_file_order
from sqlcorpus.plans import corpus
from sqlcorpus.schemas import CSV_NA_TOKENS, shielded, unshielded
from sqlcorpus.sinks.files import name_files, write_json_arrays, write_jsonl, write_routed
from sqlcorpus.sources.files import csv_headers, json_columns, read_csv, read_json
from sqlcorpus.sources.json_arrays import array_elements
from sqlcorpus.sources.large_csv import read_large_csv
from sqlcorpus.sources.paths import check_all_read, literals

NAMES = ["a[1].csv", "a1.csv", "b.csv", "a{b,c}.csv", "x*y.csv", "xzy.csv", "q?z.csv", "a b.csv", "a%20b.csv", "back\\slash.csv", "c,d.csv", "é.csv"]


@contextmanager
def pieces_of(spark, size):
    limits = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as file:
        file.write(text)
    return str(path)


def test_every_file_is_read_once_under_its_own_name(spark, tmp_path):
    for name in NAMES:
        put(tmp_path / "raw [x]" / "f{1}" / name, f"q,c,a\n\"{name}\",2,3\n")
    found = corpus.normalize_sources(spark, str(tmp_path / "raw [x]"), save="csv").select("source", "folder", "question").collect()
    assert sorted(map(tuple, found)) == sorted((n, "f{1}", n) for n in NAMES)


def test_files_found_but_not_read_are_an_error(spark, tmp_path):
    one, two = put(tmp_path / "1.txt", "x"), put(tmp_path / "2.txt", "y")
    both = spark.read.text(literals([one, two]))
    assert check_all_read(both, [one, two]).count() == 2
    with pytest.raises(OSError, match="2.txt"):
        check_all_read(spark.read.text(one), [one, two])
    with pytest.raises(OSError, match="not found: .*2.txt"):
        check_all_read(both, [one])


def test_headers_of_all_files_come_from_one_job(spark, tmp_path):
    texts = {
        "plain.csv": ("q,c,a\n1,2,3\n", ("q", "c", "a")), "crlf.csv": ("\r\n\r\nq,c\r\n1,2\r\n", ("q", "c")),
        "quoted.csv": ('"two\nlines","say ""x""",",",\n1,2,3,4\n', ("two\nlines", 'say "x"', ",", "_c3")),
        "twice.csv": ("A,a,b\n1,2,3\n", ("A0", "a1", "b")), "only.csv": ("text", ("text",)), "bom.csv": ("﻿q,c\n", ("q", "c")),
    }
    paths = {put(tmp_path / n, t): names for n, (t, names) in texts.items()}
    put(tmp_path / "empty.csv", "\n\n")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    found = csv_headers(spark, [*paths, str(tmp_path / "empty.csv")])
    assert len(jobs.getJobIdsForGroup("headers")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
    assert {k.removeprefix("file:").replace("///", "/"): v for k, v in found.items()} == paths
    for path, names in paths.items():  # as Spark itself would name them
        if "bom" not in path:
            assert tuple(spark.read.csv(path, header=True, multiLine=True, escape='"').columns) == names
    assert read_csv(spark, str(tmp_path / "quoted.csv")).collect() == [("1", "2", "3", "4")]


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_arrays_are_cut_anywhere(spark, tmp_path, piece):
    rng = random.Random(piece)
    values = ["plain", "", "{", "}", "[{\"", "\\", "\\\\\"", "}\\", "line\nend", "é}", None, 1, -1.5, 1e30, True, {}, [], {"y": [1, {"z": "}"}], "x": "{"}, [[{}], "]"], ", {"]
    files = {}
    for name in ("a.json", "b [1].json", "c.json"):
        records = [{k: rng.choice(values) for k in rng.sample(["p", "q", "r\"}", "s"], rng.randint(1, 4))} for _ in range(rng.choice([0, 1, 40]) or 25)]
        indent = rng.choice([None, 1])
        files[put(tmp_path / name, rng.choice(["", " \n"]) + json.dumps(records, indent=indent, ensure_ascii=False) + rng.choice(["", "\n"]))] = records
    files[put(tmp_path / "none.json", " [ \n]")] = []
    with pieces_of(spark, piece):
        rows = array_elements(spark, list(files)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["_path"], r["_row"])):
        got.setdefault("/" + r["_path"].removeprefix("file:").lstrip("/"), []).append((r["_row"], json.loads(r["value"])))
    assert got == {path: list(enumerate(records)) for path, records in files.items() if records}
    assert len({(r["_lane"], r["_path"]) for r in rows}) == len(got) == len({r["_lane"] for r in rows})


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}', '[{"a": 1}, 5]', '[[{"a": 1}]]', '[{"a": "1}]', "", "5", '[{"a": 1}]]', '{"a": 1}\n{"a": 2}\n'])
def test_what_is_not_one_array_of_objects_is_an_error(spark, tmp_path, text):
    file = put(tmp_path / "x.json", text)
    if not text:
        assert array_elements(spark, file).count() == 0
        return
    with pytest.raises(Exception, match="not one whole JSON array|more than objects"):
        array_elements(spark, file).collect()


def test_values_of_arrays_are_spelt_as_in_the_file(spark, tmp_path):
    file = put(tmp_path / "a.json", '[\n {"a": 1.10, "b": {"y": 1, "x": [ 2]}, "c": "t\\n\\u00e9"},\n {"c": 1e5, "a": null}\n]\n')
    assert json_columns(spark, file, "json") == {f"file:{file}": ("a", "b", "c")} or list(json_columns(spark, file, "json").values()) == [("a", "b", "c")]
    assert sorted(map(tuple, read_json(spark, file).collect()), key=str) == [("1.10", '{"y": 1, "x": [ 2]}', "t\né"), (None, None, "1e5")]


def test_array_files_as_written(spark, tmp_path):
    rows = spark.range(0, 50, 1, 4).selectExpr("id", "if(id % 7 = 0, null, concat('t\"}', id)) t")
    write_json_arrays(rows, str(tmp_path / "w"))
    names = name_files(spark, str(tmp_path / "w"), str(tmp_path / "raw" / "s"), "arr [x].json")
    assert names == [f"arr [x]-{k:05d}.json" for k in range(4)]
    for name in names:
        assert isinstance(json.loads((tmp_path / "raw" / "s" / name).read_text()), list)
    found = read_json(spark, [str(tmp_path / "raw" / "s" / n) for n in names])
    assert found.columns == ["id", "t"] and {(int(r["id"]), r["t"]) for r in found.collect()} == {tuple(r) for r in rows.collect()}


CELLS = ["plain", "", '5" pipe', 'a "b" c', '"q"', '"q,\nr"', '"say ""x"""', '""', '"" ""', '"x"y', '"x" "y"', '"a""', " \"s\"", "é", '"\n"', '"end\n\n"', "x" * 30, "NA"]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("piece", [5, 33, 1 << 20])
def test_quotes_wherever_they_stand(spark, tmp_path, line_end, piece):
    """Same rows as the reader of whole files: stray quotes, ragged rows, blank lines."""
    rng = random.Random(piece)
    files = []
    for name in ("a.csv", "b.csv"):
        lines = ["q,c,a"] + [",".join(rng.choice(CELLS) for _ in range(rng.choice([1, 2, 3, 3, 3, 4]))) for _ in range(120)] + ['last,"c",d']
        text = "\n".join(lines)
        files.append(put(tmp_path / name, text.replace("\n", line_end) + line_end))
    whole = read_csv(spark, files, provenance=True, columns=("q", "c", "a")).collect()
    with pieces_of(spark, piece):
        cut = read_large_csv(spark, files, ("q", "c", "a"), CSV_NA_TOKENS, provenance=True).collect()
    cut.sort(key=lambda r: (r["_file"], r["_row"]))
    whole.sort(key=lambda r: (r["_file"], r["_row"]))
    assert [(r["_file"], r["q"], r["c"], r["a"]) for r in cut] == [(r["_file"], r["q"], r["c"], r["a"]) for r in whole]


def test_an_open_quote_is_an_error(spark, tmp_path):
    file = put(tmp_path / "a.csv", 'q,c\n1,2\n"3,4\n5,6\n')
    with pytest.raises(Exception, match="not closed"):
        read_large_csv(spark, [file], ("q", "c"), ()).collect()


def test_columns_named_like_the_stores_own_survive(spark, tmp_path):
    put(tmp_path / "raw" / "f" / "two.jsonl", '{"class": "x", "_row": 1}\n{"class": "y", "_row": 2}\n')
    put(tmp_path / "raw" / "f" / "more.json", '[{"q": "1", "c": "2", "a": "3", "index": "i", "folder": "g", "class_": "z", "_scan": "s"}]')
    put(tmp_path / "raw" / "f" / "own.csv", "_path,_lane\np,l\n")
    staged = corpus.stage_sources(spark, str(tmp_path / "raw"), str(tmp_path / "staged"))
    tables = corpus.corpus_tables(staged)
    assert tables.index == "level_0"
    rows = {r["source"]: r.asDict() for r in tables.instruct.collect()}
    assert sorted((r["class"], r["_row"]) for r in tables.instruct.collect() if r["source"] == "two.jsonl") == [("x", "1"), ("y", "2")]
    assert (rows["own.jsonl"]["_path"], rows["own.jsonl"]["_lane"]) == ("p", "l")
    (more,) = tables.generation.collect()
    assert (more["index"], more["folder"], more["class_"], more["_scan"], more["level_0"], more["extra"]) == ("i", "g", "z", "s", 0, "NULL")
    names = ["class", "class_", "class__", "folder", "_row", "row", "_row_", "Class", "text", "x_"]
    assert [unshielded(shielded(n)) for n in names] == names and len({shielded(n) for n in names}) == len(names)


@pytest.mark.parametrize("large_from", [None, 1])
def test_index_over_all_formats_in_pieces(spark, tmp_path, large_from):
    rng = random.Random(2)
    wanted = []
    for name, n in (("a.csv", 90), ("b.jsonl", 70), ("c.json", 60), ("d.csv", 1), ("e [1].jsonl", 30)):
        rows = [{"z": f"{name}{i}", "b": "x" * rng.randint(0, 40), "a": "y"} for i in range(n)]
        if name.endswith("csv"):
            text = "z,b,a\n" + "".join(f"{r['z']},{r['b']},{r['a']}\n" for r in rows)
        else:
            text = json.dumps(rows) if name.endswith("json") else "".join(json.dumps(r) + "\n" for r in rows)
        put(tmp_path / "raw" / "f" / name, text)
        wanted += [r["z"] for r in rows]
    with pieces_of(spark, 300):
        found = corpus.normalize_sources(spark, str(tmp_path / "raw"), large_from=large_from)
        write_routed(found, str(tmp_path / "staged"))
    staged = corpus.read_staged(spark, str(tmp_path / "staged"))
    indexed = index_in_file_order(staged.repartition(3))
    assert [q for _, q in sorted((r["index"], r["question"]) for r in indexed.collect())] == wanted
    plan = indexed._jdf.queryExecution().optimizedPlan().toString().splitlines()
    outer = [line for line in plan if not line.lstrip(" +-").startswith(":")]  # without the subquery
    assert not any("Join" in line or "Sort" in line or "Window" in line for line in outer)
    assert index_in_file_order(staged.filter("false")).count() == 0


def test_routes_are_replaced_one_by_one_and_pruned(spark, tmp_path):
    def rows(folder, source, text):
        return spark.createDataFrame([(text, "generation", folder, source)], "question string, class string, folder string, source string")

    for save in ("parquet", "jsonl", "csv"):
        path = str(tmp_path / save)
        write_routed(rows("f", "a", "1").union(rows("g", "b", "2")), path, save=save)
        write_routed(rows("f", "a", "3"), path, "routes", save)
        write_routed(rows("h", "c", "4"), path, "routes", save)
        reader = spark.read.option("header", True).schema("question string, class string, folder string, source string")
        back = reader.format({"jsonl": "json"}.get(save, save)).load(path)
        assert sorted((r["folder"], r["question"]) for r in back.collect()) == [("f", "3"), ("g", "2"), ("h", "4")]
        plan = back.filter("class = 'generation' and folder = 'f'")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(class" in plan and "(folder" in plan
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_routed(rows("f", "a", "1"), str(tmp_path / "csv"), save="csv")


def test_named_lines_are_read_as_lines(spark, tmp_path):
    write_jsonl(spark.createDataFrame([("q", "a")], "Questions string, SQL string"), str(tmp_path / "w"))
    name_files(spark, str(tmp_path / "w"), str(tmp_path / "raw" / "f"), "x.jsonl")
    assert any(n.startswith("x") and n.endswith(".jsonl") for n in os.listdir(tmp_path / "raw" / "f"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert corpus.normalize_sources(spark, str(tmp_path / "raw")).first()["question"] == "q"
