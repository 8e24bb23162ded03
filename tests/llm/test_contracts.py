"""The registered queries themselves: columns, types and rows against plain versions; and inputs made to mislead."""

import hashlib
import time
from collections import Counter

import brute
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sqlcorpus.llm import arrays, langid, minhash, queries, sentence_pieces, substring_dedup, suffix_dedup

LONG, TEXT, FLAG = "bigint", "string", "boolean"


@pytest.fixture(scope="module")
def docs(spark, given):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{given}/documents.parquet").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def wanted(found):
    return sorted(found, key=str)


def test_op1(spark, given, docs):
    found = queries.op1_minhash_near_dedup(spark, given)
    assert found.dtypes == [("doc_id", LONG), ("n_shingles", LONG), ("component_id", LONG), ("kept", FLAG)]
    assert rows(found) == wanted(brute.near_duplicates([d[:2] for d in docs]))


def test_op3(spark, given, docs):
    found = queries.op3_mix_sources(spark, given)
    assert found.dtypes == [("doc_id", LONG), ("size", LONG), ("source_size", LONG), ("target", "double"), ("taken", LONG)]
    sources = dict(map(tuple, queries.table(spark, given, "documents").select("doc_id", "source").collect()))
    sizes = {d: len(brute.words(t)) for d, t, _ in docs}
    of_source = Counter()
    for d, n in sizes.items():
        of_source[sources[d]] += n
    targets = brute.targets(of_source)
    taken = Counter()
    for d, size, source_size, target, n in rows(found):
        assert size == sizes[d] and source_size == of_source[sources[d]] and target == pytest.approx(targets[sources[d]])
        assert 0 <= n <= 3 * size
        taken[sources[d]] += n
    assert all(abs(taken[s] - targets[s]) <= 0.02 * targets[s] + 200 for s in targets)
    assert rows(found) == rows(queries.op3_mix_sources(spark, given))


def test_op5(spark, given, docs):
    found = queries.op5_suffix_array_dedup(spark, given)
    assert found.dtypes == [("doc_id", LONG), ("n_bytes", LONG), ("n_removed", LONG), ("n_spans", LONG), ("kept_sha256", TEXT)]
    assert rows(found) == wanted(brute.bytes_removed([d[:2] for d in docs]))


def test_op6(spark, given):
    found = queries.op6_embedding_near_dedup(spark, given)
    assert found.dtypes == [("vec_id", LONG), ("n_links", LONG), ("component_id", LONG), ("kept", FLAG)]
    vectors = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, given, "embeddings").collect()]
    links = brute.vector_links(vectors)
    assert sum(r[1] for r in rows(found)) == 2 * len(links) and len(rows(found)) == len(vectors)


def test_op7(spark, given, docs):
    found = queries.op7_sentence_pieces(spark, given).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found.dtypes == [("doc_id", LONG), ("n_tokens", LONG), ("ids_sha256", TEXT), ("decoded_sha256", TEXT)]
    library = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    want = []
    for d, text, _ in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert rows(found) == wanted(want)


def test_op8(spark, given, docs):
    found = queries.op8_substring_dedup(spark, given)
    assert found.dtypes == [("doc_id", LONG), ("n_words", LONG), ("n_removed", LONG), ("kept_sha256", TEXT)]
    assert rows(found) == wanted(brute.words_removed([d[:2] for d in docs]))


def test_op10(spark, given, docs):
    found = queries.op10_language_id(spark, given)
    assert found.dtypes[:4] == [("doc_id", LONG), ("held_out", FLAG), ("lang_pred", TEXT), ("score", "double")]
    lang = {d: known for d, _, known in docs}
    held = [r for r in found.collect() if r["held_out"] and lang[r["doc_id"]]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_defeat_power_sums(spark, n):
    """Words, and texts of words, whose power sums modulo 2**64 are equal for every odd base."""
    one, two = "".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))
    filler = [f"w{i}" for i in range(19)]
    texts = [" ".join([one, *filler]), " ".join([two, *filler]), " ".join(thue_morse(n, "x", "y")), " ".join(thue_morse(n, "y", "x")), one, two]
    given = list(enumerate(texts))
    docs = spark.createDataFrame(given, "doc_id long, text string")
    assert rows(minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")) == wanted(brute.near_duplicates(given))
    cut = suffix_dedup.dedup_bytes(docs).withColumn("h", F.sha2("kept", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "h")
    assert rows(cut) == wanted(brute.bytes_removed(given))
    cut = substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    assert rows(cut) == wanted(brute.words_removed(given))


def test_hashes_are_sums_modulo_the_prime():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 500, dtype=np.uint64)
    sums = arrays.prefix_sums(values)
    small = arrays.prefix_sums((values & arrays.LOW30).astype(np.uint32))
    for k in (0, 1, 2, 77, 500):
        assert int(sums[k]) % arrays.PRIME == sum(int(v) * pow(arrays.BASE, i, arrays.PRIME) for i, v in enumerate(values[:k])) % arrays.PRIME
        assert int(small[k]) % arrays.PRIME == sum((int(v) % 2**30) * pow(arrays.BASE, i, arrays.PRIME) for i, v in enumerate(values[:k])) % arrays.PRIME
    again = arrays.prefix_sums(np.r_[values[100:200], values])
    assert (arrays.stretch_hash(sums, np.array([100]), np.array([200])) == arrays.stretch_hash(again, np.array([0]), np.array([100]))).all()
    assert (arrays.all_stretches(sums, 7)[:400] == arrays.stretch_hash(sums, np.arange(400), np.arange(400) + 7)).all()


def test_the_suffix_array_decides(spark, given, docs, monkeypatch):
    """With a wrong order of the suffixes other bytes are removed."""
    frames = []
    marked = suffix_dedup.mark_equal
    texts = [("p%d " % k + " ".join(f"word{(i * 7919) % 997}" for i in range(40 * k, 40 * k + 200))).encode() for k in range(4)]
    import pandas as pd

    from sqlcorpus.llm.windows import Windows

    frame = pd.DataFrame({"g": 1, "c": range(4), "lead": [len(t) for t in texts], "tail": 0, "context": texts})
    w = Windows(100, 20, words=False, earlier=False)
    right = marked(frame, w)
    assert len(right)
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: list(range(len(text) - 1, -1, -1)))
    wrong = marked(frame, w)
    assert [s for s in wrong["spans"]] != [s for s in right["spans"]]
    frames.append(wrong)


def test_one_of_each_group_whatever_the_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = a.replace("a59", "zz")

    def left(rows_):
        return sorted((tuple(r) for r in minhash.drop_near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string, extra string")).collect()), key=str)

    assert left([(5, a, "1"), (5, b, "2"), (6, a, "3"), (7, b, "4")]) == [(5, a, "1"), (5, b, "2")]
    assert [r[:2] for r in left([(None, a, "1"), (None, a, "2"), (None, a, "3")])] == [(None, a)]
    assert [r[:2] for r in left([(None, a, "1"), (4, near, "2"), (4, near, "3"), (9, b, "4")])] == [(4, near), (9, b)]
    assert len(left([(1, "", "1"), (1, "", "2"), (None, None, "3"), (None, None, "4")])) == 4


def test_rows_that_repeat_one_id_take_linear_time(spark):
    text = " ".join(f"word{i} " * 3 for i in range(100))

    def spent(n):
        docs = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
        at = time.time()
        assert suffix_dedup.dedup_bytes(docs).agg(F.sum("n_removed")).first()[0] == n * len(text)
        return time.time() - at

    spent(10)
    few, many = spent(200), spent(3000)
    assert many < 15 * few + 5


def test_more_units_than_are_remembered(spark, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHED", 50)
    model = sentence_pieces.Pieces(queries.piece_model())
    library = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    texts = [" ".join(f"u{i}" for i in range(200)), " ".join(f"u{i}" for i in range(100, 260)), "u3 new", " ".join(f"u{i}" for i in range(40))]
    for part in (texts, texts[::-1], texts[1:]):
        for text, (ids, _, _) in zip(part, model.encode(part)):
            assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_ids_decode_to_texts(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, ids string")
    proto = queries.piece_model()
    found = sentence_pieces.decode(sentence_pieces.encode(docs, proto).drop("text"), proto)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {1: library.decode(library.encode("Hello  wörld")), 2: "", 3: ""}


@pytest.mark.parametrize("text, letter", [("² ½ 12", False), ("①②", False), ("x²", True), ("_ 1 _", False), ("ß", True), ("词", True), ("", False), ("٣", False)])
def test_letters(text, letter):
    assert langid.has_letter(text) is letter
