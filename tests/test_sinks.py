import os
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from sqlcorpus.operators.evaluate import same_result
from sqlcorpus.plans.queries import queries
from sqlcorpus.sinks.files import (
    BUCKET_BYTES, MOST_BUCKETS, Buckets, bucket_count, export_datasets, write_csv, write_jsonl, write_routed, write_rows,
)
from sqlcorpus.sinks.tables import create_table, export_tables, open_store, replace_table
from sqlcorpus.sources.files import read_csv, read_jsonl
from sqlcorpus.sources.tables import key_by_key, table_in

NASTY = [("a \"b\", 'c'", "line1\nline2\\"), ("  edge ", "NULL"), ("ü###", None)]


def nasty(spark):
    return spark.createDataFrame(NASTY, "q string, a string")


def test_csv_round_trip_loses_only_the_missing_text(spark, tmp_path):
    write_csv(nasty(spark), str(tmp_path / "c"))
    back = read_csv(spark, str(tmp_path / "c"))
    assert same_result(spark.createDataFrame([NASTY[0], ("  edge ", None), NASTY[2]], "q string, a string"), back)


def test_jsonl_round_trip_is_exact_and_writes_nulls(spark, tmp_path):
    write_jsonl(nasty(spark), str(tmp_path / "j"))
    assert same_result(nasty(spark), read_jsonl(spark, str(tmp_path / "j")))
    text = "".join(open(tmp_path / "j" / f).read() for f in os.listdir(tmp_path / "j") if f.endswith(".json"))
    assert '"a":null' in text


def written(folder):
    """Names and total size of the data files below a folder."""
    found = [os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.startswith("part-")]
    return [os.path.basename(f) for f in found], sum(map(os.path.getsize, found))


def test_exports_under_a_codec_hold_the_same_rows_in_fewer_bytes(spark, tmp_path):
    texts = [*NASTY, *[(f"prompt {k} of the same words and a few more of them", None if k % 7 else f"line\n{k}") for k in range(2000)]]
    long = spark.createDataFrame([(f"d{k % 2}", k, q, a) for k, (q, a) in enumerate(texts)], "dataset string, idx long, q string, a string")
    for save in ("jsonl", "csv"):
        plain, packed = str(tmp_path / save), str(tmp_path / f"{save}-packed")
        export_datasets(long, plain, save)
        export_datasets(long, packed, save, compression="gzip")
        names, size = written(packed)
        assert names and all(n.endswith(".gz") for n in names) and size < written(plain)[1] / 2
        assert not any(n.endswith(".gz") for n in written(plain)[0])
        assert sorted(d for d in os.listdir(packed) if "=" in d) == ["dataset=d0", "dataset=d1"]
        if save == "jsonl":
            back = spark.read.schema("idx LONG, q STRING, a STRING, dataset STRING").json(packed).select(*long.columns)
            assert same_result(long, back)


def test_the_export_of_all_datasets_is_packed(spark, tmp_path):
    spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a")],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "words of a text " * 200, "en", "src1")],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "t")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries()["export_datasets"](spark, str(tmp_path))
    names = [os.path.basename(f) for f in out.inputFiles()]
    assert names and all(n.endswith(".json.gz") for n in names)
    # six prompts of either generation row, one of either instruct row, and a system prompt
    assert out.count() == 2 * 6 + 2 + 1


def runs_of(values):
    """Values without immediate repeats."""
    return [value for value, _ in groupby(values)]


def test_an_export_in_buckets_is_read_key_by_key_without_a_shuffle(spark, tmp_path):
    long = spark.createDataFrame([(f"d{k}", idx // 50, idx, f"prompt {k} of\n\"{idx}\"") for idx in range(300) for k in range(3)],
                                 "dataset string, part long, idx long, text string")
    database = open_store(spark, "buckets_of_exports", str(tmp_path / "store"))
    for save in ("jsonl", "csv"):
        buckets, path = Buckets(table_in(database, save), "part", 5), str(tmp_path / save)
        # quotes and line ends are the reader's matter in csv
        rows = long if save == "jsonl" else long.withColumn("text", F.translate("text", '\n"', "  "))
        export_datasets(rows.repartition(5, "part"), path, save, compression="gzip", buckets=buckets)
        assert sorted(d for d in os.listdir(path) if "=" in d) == ["dataset=d0", "dataset=d1", "dataset=d2"]
        assert len(written(path)[0]) <= 3 * 5
        back = key_by_key(spark.table(buckets.table), ["part", "idx"], "dataset").select(*long.columns)
        assert same_result(rows, back)
        assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
        found = [row["idx"] for row in back.collect()]
        assert sorted(runs_of(found)) == list(range(300))
    # other readers take the files as they are
    plain = spark.read.schema("part LONG, idx LONG, text STRING, dataset STRING").json(str(tmp_path / "jsonl")).select(*long.columns)
    assert same_result(long, plain)


def test_buckets_grow_in_number_with_the_rows():
    assert [bucket_count(size) for size in (0, BUCKET_BYTES - 1, BUCKET_BYTES, 100 * BUCKET_BYTES)] == [1, 1, 2, 101]
    assert bucket_count(BUCKET_BYTES * 10**9) == MOST_BUCKETS


def test_prompts_of_one_text_lie_together_where_the_export_is_read(spark, tmp_path):
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(20_000)]
    texts = [" ".join(draw.choices(words, k=300)) for _ in range(400)]
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(k, text, "en", f"src{k % 4}") for k, text in enumerate(texts)],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"t{k}") for k in range(9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries()["export_datasets"](spark, str(tmp_path))
    found = [row["idx"] for row in out.collect()]
    # six prompts of each text, one more of texts of two of the four sources
    assert found.count(None) == 9 and len(found) == 9 + 6 * 400 + 200
    assert sorted(runs_of(idx for idx in found if idx is not None)) == list(range(400))
    out.write.parquet(str(tmp_path / "saved"))
    out.sort("dataset", "idx").write.parquet(str(tmp_path / "apart"))
    assert written(str(tmp_path / "saved"))[1] < written(str(tmp_path / "apart"))[1] / 2


def test_modes(spark, tmp_path):
    write_rows(nasty(spark), str(tmp_path / "x"), "jsonl")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_rows(nasty(spark), str(tmp_path / "x"), "jsonl")
    write_rows(nasty(spark), str(tmp_path / "x"), "jsonl", "overwrite")
    with pytest.raises(ValueError):
        write_rows(nasty(spark), str(tmp_path / "y"), "xlsx")


def test_routed_folders(spark, tmp_path):
    df = spark.range(1000).selectExpr(
        "cast(id as string) question", "'generation' class", "'f' folder", "concat('s', id % 3, '.jsonl') source")
    write_routed(df, str(tmp_path / "r"))
    assert sorted(os.listdir(tmp_path / "r" / "class=generation" / "folder=f")) == [
        f"source=s{i}.jsonl" for i in range(3)]
    assert same_result(df, spark.read.parquet(str(tmp_path / "r")).select(*df.columns))


def test_table_sinks(spark, tmp_path):
    create_table(nasty(spark), "dataset_sinks_test")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        create_table(nasty(spark), "dataset_sinks_test")
    create_table(nasty(spark).limit(1), "dataset_sinks_test", overwrite=True)
    replace_table(nasty(spark), "plain_sinks_test")
    replace_table(nasty(spark), "plain_sinks_test")
    nasty(spark).createOrReplaceTempView("dataset_sinks_view")
    names = export_tables(spark, str(tmp_path / "out"), "csv")
    assert {"dataset_sinks_test", "dataset_sinks_view"} <= set(names) and "plain_sinks_test" not in names
    assert len(names) == len(set(names))
    assert read_csv(spark, str(tmp_path / "out" / "dataset_sinks_test")).count() == 1
    spark.catalog.dropTempView("dataset_sinks_view")
    spark.sql("DROP TABLE dataset_sinks_test")
    spark.sql("DROP TABLE plain_sinks_test")
