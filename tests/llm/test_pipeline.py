"""The pipeline's stages one after another, each against what it says."""

import brute
import corpus_pipeline
import __spark_entry__ as contract
from oracle_check import database, differs
import pytest
from sqlcorpus.llm import minhash, queries


def test_registered():
    names = contract.queries()
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "sentence_pieces"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, given, name):
    assert differs(spark, database(given), given, name) is None


def test_stages(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "kept")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, "")
        if name != "sentence_pieces":
            assert done.columns == columns
        done.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    assert docs.count() > 0


def test_near_copies_from_80_per_cent_on_go(spark):
    """Texts of 104 words, 100 shingles: a change of the last n words takes n of them from either side."""
    rows = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(104)]
        for n in (0, 11, 13):  # 89/111 = 0.802, 87/113 = 0.770
            rows.append((100 * k + n, " ".join(words[: 104 - n] + [f"z{k}y{n}v{i}" for i in range(n)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(d for d, _, _, kept in brute.near_duplicates(rows, 80) if kept)
    left = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert left == want and len(want) == 40
    assert [minhash.chunks_for(p) for p in (85, 80)] == [minhash.CHUNKS, 12]


def test_run(spark, given):
    rows = corpus_pipeline.run(spark, given)
    assert 0 < rows.count() < 3 * spark.read.parquet(f"{given}/documents.parquet").count()
    assert rows.where("size(ids) <> size(ends)").count() == 0
