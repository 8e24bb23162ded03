"""End to end: raw files of every format to exported datasets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sqlcorpus.operators.consolidate import index_in_file_order
from sqlcorpus.operators.evaluate import same_result
from sqlcorpus.plans import corpus
from sqlcorpus.plans.templates import DATASETS, PART, PART_BITS, TEMPLATES, dataset, datasets_long
from sqlcorpus.sinks.files import export_datasets
from sqlcorpus.sources.discover import Shape, discover_sources, files_by_folder, group_by_shape
from sqlcorpus.sources.tables import list_datasets, load_dataset_by_name, scan_table

SOURCES = {
    "completion": ("pairs.jsonl",), "finished": ("done.jsonl",),
    "paired": ("pairs.jsonl",), "bare": ("bare.jsonl",), "system prompt": ("sys.jsonl",),
}


@pytest.fixture(scope="module")
def raw(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("corpus") / "raw"
    folder = root / "2024"
    folder.mkdir(parents=True)

    def put(name, text):
        (folder / name).write_text(text)

    put("q1.csv", 'z,b,a\nwho,"T ""x""",SELECT 1\nwhat,NA,"SELECT\n2"\n')
    put("q2.csv", 'z,b,a\nwhy,T2,SELECT 3\n')
    put("tail.csv", "q,c,a,x,y\nq0,c0,a0,,7\n")
    put("sys.csv", "text\nYou are kind\n")
    put("done.csv", "text\n<s> done\n")
    put("bare.csv", "text\nbare words\n")
    put("deep.json", json.dumps([{"z": "zq", "b": "zb", "a": "za", "more": "m"}, {"z": "z2", "b": "b2", "a": "a2"}]))
    put("pairs.jsonl", '{"input": "in", "output": "out"}\n{"input": "in2", "output": null}\n')
    put("keys.jsonl", "".join(json.dumps({"z": f"z{i}", "b": f"b{i}", "a": f"a{i}", "k": i}) + "\n" for i in range(50)))
    put("notes.txt", "ignored")
    spark.createDataFrame([("q", "a", "c", 5)], "q string, a string, c string, k int").coalesce(1) \
        .write.parquet(str(root / "pq"))
    return str(root)


@pytest.fixture(scope="module")
def staged(spark, raw, tmp_path_factory):
    with pytest.warns(UserWarning, match="txt"):
        return corpus.stage_sources(spark, raw, str(tmp_path_factory.mktemp("corpus") / "staged"))


def test_discovery(spark, raw):
    found = discover_sources(spark, raw, exclude=("pq",))
    grouped = {r["folder"]: r["files"] for r in files_by_folder(found).collect()}
    assert grouped == {"2024": ["bare.csv", "deep.json", "done.csv", "keys.jsonl", "notes.txt",
                                "pairs.jsonl", "q1.csv", "q2.csv", "sys.csv", "tail.csv"]}
    shapes = group_by_shape(spark, found)
    assert len(shapes[Shape("csv", ("z", "b", "a"))]) == 2
    assert Shape("jsonl", ("z", "b", "a", "k")) in shapes
    assert Shape("json", ("z", "b", "a", "more")) in shapes
    assert Shape("csv", ("q", "c", "a", "x", "y"), True) in group_by_shape(spark, found, 1)


def test_staged_rows(staged, rows):
    gen = staged.filter("class = 'generation'")
    got = {tuple(r) for r in gen.select("source", "question", "context", "answer", "extra", "more").collect()}
    assert ("q1.jsonl", "who", 'T "x"', "SELECT 1", "NULL", None) in got
    assert ("q1.jsonl", "what", None, "SELECT\n2", "NULL", None) in got
    assert ("tail.jsonl", "q0", "c0", "a0", "7", None) in got
    assert ("deep.jsonl", "zq", "zb", "za", "NULL", "m") in got
    assert ("deep.jsonl", "z2", "b2", "a2", "NULL", None) in got
    assert ("keys.jsonl", "z3", "b3", "a3", "3", None) in got
    assert sum(1 for r in got if r[1:5] == ("q", "c", "a", "5")) == 1
    assert rows(gen.select("folder").distinct()) == [("2024",), ("pq",)]


def test_large_csv_files_give_the_same_rows(spark, raw, staged):
    with pytest.warns(UserWarning):
        cut = corpus.normalize_sources(spark, raw, large_from=1).filter("source like 'q%' or source like 't%'")
    columns = ["source", "question", "context", "answer", "extra", "_row"]
    whole = staged.filter("source like 'q%' or source like 't%'").select(*columns[:5])
    assert same_result(whole, cut.select(*columns[:5]))
    assert sorted(r["_row"] for r in cut.filter("source = 'q1.jsonl'").collect()) == [0, 1]


def test_tables_are_densely_indexed_in_file_order(staged):
    tables = corpus.corpus_tables(staged, SOURCES)
    gen = tables.generation.collect()
    assert sorted(r["index"] for r in gen) == list(range(len(gen)))
    keys = sorted((r["index"], r["question"]) for r in gen if r["source"] == "keys.jsonl")
    assert [q for _, q in keys] == [f"z{i}" for i in range(50)]
    assert [i for i, _ in keys] == list(range(keys[0][0], keys[0][0] + 50))
    assert sorted(r["index"] for r in tables.instruct.collect()) == list(range(5))


def test_index_follows_a_file_cut_into_many_pieces(spark, tmp_path):
    folder = tmp_path / "raw" / "set"
    folder.mkdir(parents=True)
    for name in ("a", "b"):
        (folder / f"{name}.jsonl").write_text("".join(
            json.dumps({"z": f"{name}{i}", "b": "x" * (i % 50), "a": "y", "k": i}) + "\n" for i in range(3000)))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        small = corpus.stage_sources(spark, str(tmp_path / "raw"), str(tmp_path / "staged"))
        assert small.select("_path", "_block").distinct().count() > 4
        rows = sorted((r["index"], r["question"]) for r in index_in_file_order(small.repartition(5)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert rows == list(enumerate(f"{name}{i}" for name in ("a", "b") for i in range(3000)))
    with pytest.raises(Exception, match="rows missing inside"):
        index_in_file_order(small.filter("question <> 'a7'")).collect()


def test_datasets_and_export(spark, staged, tmp_path, rows):
    tables = corpus.corpus_tables(staged, SOURCES)
    n_gen = tables.generation.count()
    assert dataset("chatbot", tables).count() == n_gen
    assert dataset("text_completition", tables).count() == n_gen + 2
    texts = {r["text"] for r in dataset("text_instruct", tables).collect()}
    assert {"<s> done", "<s> in out</s>", "<s> bare words</s>", None,
            "<s> [INST] who The context is: T 'x' [/INST] SELECT 1</s>"} <= texts
    assert rows(dataset("sys_prompt", tables)) == [("You are kind",)]

    long = datasets_long(tables)
    for name in DATASETS:
        assert rows(long.filter(long.dataset == name), "text") == rows(dataset(name, tables), "text")
    for save in ("jsonl", "csv"):
        export_datasets(long.drop("source"), str(tmp_path / save), save)
        assert sorted(d for d in os.listdir(tmp_path / save) if "=" in d) == [f"dataset={n}" for n in DATASETS]
    back = spark.read.json(str(tmp_path / "jsonl"))
    assert rows(back, "dataset", "index", "text") == rows(long, "dataset", "index", "text")


def test_prompts_of_a_row_share_a_part(spark, staged, rows):
    tables = corpus.corpus_tables(staged, SOURCES)
    parted = datasets_long(tables, parted=True)
    assert rows(parted.drop(PART)) == rows(datasets_long(tables))
    assert parted.filter(F.col(PART).isNull()).count() == 0
    generation = parted.filter(F.col("dataset").isin("chatbot", "translation", "text_generation")).groupBy("index").agg(F.count_distinct(PART).alias("n"))
    assert {row["n"] for row in generation.collect()} == {1}


def test_parts_are_small(spark):
    class Many:
        index, sources = "idx", {}

        def rows(self, kind):
            made = spark.range(0, 3 << PART_BITS, 1, 1).select(F.col("id").alias("idx"), F.lit("documents").alias("source"))
            return made.select("*", *(F.lit("t").alias(c) for c in ("question", "context", "answer", "text", "input", "output")))

    Many.sources = {t.sources: ("none",) for t in TEMPLATES if t.sources}
    chat = datasets_long(Many(), parted=True).filter("dataset = 'chatbot'").groupBy(PART).count().collect()
    assert sorted((row[PART], row["count"]) for row in chat) == [(k, 1 << PART_BITS) for k in range(3)]


def test_stored_tables(spark, staged):
    tables = corpus.corpus_tables(staged, SOURCES)
    corpus.store_tables(staged, tables)
    corpus.store_tables(staged, tables)  # replaces
    assert scan_table(spark, "all_datasets").count() == staged.count()
    assert scan_table(spark, "raw_instructs").count() == 5
    corpus.create_datasets(tables, ["translation", "chatbot"])
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        corpus.create_datasets(tables, ["chatbot"])
    corpus.create_datasets(tables, ["chatbot"], overwrite=True)
    assert list_datasets(spark) == ["dataset_chatbot", "dataset_translation"]
    assert load_dataset_by_name(spark, "Translation dataset").columns == ["index", "text"]
    with pytest.raises(KeyError):
        load_dataset_by_name(spark, "translation")
    assert corpus.source_table(staged, "q1").count() == 2
