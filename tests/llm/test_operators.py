"""The operators against plain versions, on given tables and on odd rows."""

import hashlib

import brute
import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from sqlcorpus.llm import forest, langid, line_dedup, minhash, mixing, quality, queries, sentence_pieces, substring_dedup, suffix_dedup, url_filter
from sqlcorpus.llm.components import components
from sqlcorpus.llm.windows import Windows, repeated_spans


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, given):
    return spark.read.parquet(f"{given}/documents.parquet")


ALL = {
    "near": lambda d: minhash.near_duplicates(d), "quality": lambda d: quality.judge_quality(d),
    "mix": lambda d: mixing.mix_sources(d), "plan": lambda d: mixing.mixing_plan(d), "bytes": lambda d: suffix_dedup.dedup_bytes(d),
    "pieces": lambda d: sentence_pieces.encode(d, queries.piece_model(), tuple(sentence_pieces.MORE)),
    "words": lambda d: substring_dedup.dedup_substrings(d), "lines": lambda d: line_dedup.dedup_lines(d),
    "language": lambda d: langid.predict(d, langid.train(d, F.lit(True))), "unique": lambda d: minhash.drop_near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables_give_empty_tables(none, name):
    assert ALL[name](none).count() == 0


@pytest.mark.parametrize("name", sorted(set(ALL) - {"mix", "plan", "unique"}))
def test_odd_rows_all_come_back(odd, name):
    assert ALL[name](odd).count() == odd.count()


def test_near_duplicates(docs):
    found = minhash.near_duplicates(docs)
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(pairs(docs)), key=str)


def test_near_duplicates_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 2)
    text = " ".join(f"w{i}" for i in range(300))
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(100_000 + i, text.replace(f"w{i} ", "zz ").replace(f"w{i + 1} ", "yy ")) for i in range(0, 60, 3)], "doc_id long, text string"))
    assert got(minhash.near_duplicates(many), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(pairs(many)), key=str)


def test_signatures_within_the_radius_always_share_an_entry():
    rng = np.random.default_rng(3)
    sign = rng.integers(0, 2**16, (40, minhash.SYMBOLS), dtype=np.uint16)
    other = sign.copy()
    for k in range(40):
        where = rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)
        other[k, where] ^= 1
    frame = pd.DataFrame({"node": range(80), "sign": [s.tobytes() for s in np.r_[sign, other]]})
    found = next(minhash.entries(iter([frame])))
    own = found.groupby("node")["entry"].apply(set)
    assert all(own[k] & own[40 + k] for k in range(40))


def test_one_of_each_group_stays(odd):
    left = minhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in left.select("doc_id").collect()) == [0, 1, 2, 7, 8, 9, 10, 2**60 + 1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100), (7, None), (300, 200), (200, 250)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(51)} | {100: 100, 300: 200, 200: 200, 250: 200}


@pytest.mark.parametrize("length, anchor, crowd", [(400, 100, 20_000), (40, 10, 20_000), (40, 10, 1)])
def test_bytes_removed(docs, length, anchor, crowd):
    found = suffix_dedup.dedup_bytes(docs, length, anchor, crowd=crowd).withColumn("h", F.sha2("kept", 256))
    assert got(found, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == sorted(brute.bytes_removed(pairs(docs), length), key=str)


@pytest.mark.parametrize("length, anchor, crowd", [(20, 6, 20_000), (5, 2, 20_000), (5, 2, 1)])
def test_words_removed(docs, length, anchor, crowd):
    found = substring_dedup.dedup_substrings(docs, length, anchor, crowd=crowd).withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert got(found, "doc_id", "n_words", "n_removed", "h") == sorted(brute.words_removed(pairs(docs), length), key=str)


def test_repeats_in_odd_rows(odd):
    removed = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.dedup_bytes(odd).select("doc_id", "n_bytes", "n_removed").collect()}
    assert removed[(1, 849)] == 849 and removed[(2, 858)] >= 849 and removed[(None, 849)] == 849 and removed[(None, 0)] == 0
    assert removed[(2**60 + 1, 70001)] == 70001
    later = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.dedup_substrings(odd).select("doc_id", "n_words", "n_removed").collect()}
    assert later[(1, 120)] == 0 and later[(2, 122)] == 120 and later[(None, 120)] == 120 and later[(2**60 + 2, 20001)] == 20001


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    for size in (0, 1, 7, 60, 300):
        for kinds in (1, 2, 5, 50):
            text = [*rng.integers(1, kinds + 1, size).tolist(), 0]
            want = sorted(range(len(text)), key=lambda i: text[i:])
            assert suffix_dedup.suffix_array(text) == want
            assert substring_dedup.suffix_order(np.array(text)).tolist() == want


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 4, 400), 0)
    index = substring_dedup.FMIndex(text)
    ends = np.arange(6, 400)
    length, low, high = index.matches(text, ends, 6)
    for e, n, lo, hi in zip(ends.tolist(), length, low, high):
        part = text[e - n : e].tolist()
        assert hi - lo == sum(text[i : i + n].tolist() == part for i in range(len(text) - n + 1))


def test_mixing(docs):
    plan = mixing.mixing_plan(docs, group=40).toPandas()
    sizes = plan.groupby("source", dropna=False).first()
    want = brute.targets({s if isinstance(s, str) else None: int(z) for s, z in sizes["source_size"].items()})
    taken = (plan["size"] * plan["times"] * plan["copies"]).groupby(plan["source"].fillna("")).sum()
    for source, target in want.items():
        row = plan[plan["source"].isna()] if source is None else plan[plan["source"] == source]
        assert row["target"].iloc[0] == pytest.approx(target)
        assert abs(taken[source or ""] - target) <= max(0.05 * target, row["size"].max())
    assert plan["copies"].max() <= 3 and len(plan) == docs.count()
    again = mixing.mixing_plan(docs.repartition(7), group=40).toPandas()
    assert sorted(map(tuple, again.to_numpy().tolist()), key=str) == sorted(map(tuple, plan.to_numpy().tolist()), key=str)


def test_flight_keeps_words_and_documents():
    rng = np.random.default_rng(6)
    words, chance = rng.integers(1, 500, 200), rng.random(200)
    after = mixing.flight(words, chance, rng)
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert after.sum() == pytest.approx(chance.sum()) and after @ words == pytest.approx(chance @ words)


def test_mixed_rows_repeat(odd):
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns
    plan = mixing.mixing_plan(odd).toPandas()
    assert mixed.count() == int((plan["copies"] * plan["times"]).sum())


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[base, base[:30] + rng.normal(size=(30, 16)) * 0.05])]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [])]
    found = {r["vec_id"]: r for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=16).collect()}
    links = brute.vector_links(rows)
    count = np.zeros(len(rows), int)
    for a, b in links:
        count[[a, b]] += 1
    assert len(found) == len(rows)
    assert sum(found[i]["n_links"] for i, _ in rows) >= 0.9 * count.sum() > 0
    assert all(found[i]["n_links"] <= c for (i, _), c in zip(rows, count))
    assert found[204]["component_id"] == 3 and not found[204]["kept"] and found[301]["kept"] and found[300]["n_links"] == 0


def test_large_leaves_are_split(spark, monkeypatch):
    monkeypatch.setattr(forest, "MOST", 20)
    rng = np.random.default_rng(8)
    center = rng.normal(size=8)
    rows = [(i, (center + rng.normal(size=8) * 0.01).tolist()) for i in range(150)]
    found = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=1000, spill=0.3).collect()
    assert {r["component_id"] for r in found} == {0}


def leaf_rows(spark, vectors, leaves):
    rows = [(n, leaf, v.tolist(), 1) for leaf in leaves for n, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "node long, leaf long, embedding array<double>, copies long")


def test_trees_split_large_leaves_in_different_ways(spark, monkeypatch):
    monkeypatch.setattr(forest, "MOST", 120)
    vectors = np.random.default_rng(9).normal(size=(200, 16))
    split = forest.split_leaves(leaf_rows(spark, vectors, [1, 1 << 40]), 0.0).toPandas()
    parts = split.groupby("leaf")["node"].apply(frozenset)
    assert len(parts) == 4 and len(set(parts)) == 4 and (split["leaf"] >= 0).all()


def test_large_leaves_keep_multiples_together(spark, monkeypatch):
    monkeypatch.setattr(forest, "MOST", 120)
    vectors = np.random.default_rng(10).normal(size=(100, 16))
    split = forest.split_leaves(leaf_rows(spark, np.r_[vectors, vectors * 10], [1]), 0.01).toPandas()
    leaves = split.groupby("node")["leaf"].apply(set)
    assert split["leaf"].nunique() == 2 and all(leaves[n] & leaves[100 + n] for n in range(100))


def test_links_of_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(forest, "MOST", 40)
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[rng.normal(size=32) * 0.2 + 1 + rng.normal(size=(600, 32)) * 0.3, rng.normal(size=(200, 32))])]
    count = np.bincount(np.array(list(brute.vector_links(rows))).ravel(), minlength=len(rows))
    found = {r["vec_id"]: r["n_links"] for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), trees=3).collect()}
    assert sum(found.values()) >= 0.9 * count.sum() > 10_000
    assert all(found[i] <= c for i, c in enumerate(count))


@pytest.mark.parametrize("most", [2048, 30])
def test_vectors_of_every_length_are_linked(spark, monkeypatch, most):
    monkeypatch.setattr(forest, "MOST", most)
    rng = np.random.default_rng(12)
    rows = []
    for length, pairs_of in ((16, 60), (9, 50), (3, 1)):
        base = rng.normal(size=(pairs_of, length))
        for v in base:
            rows += [(len(rows), v.tolist()), (len(rows) + 1, (v * 2 + rng.normal(size=length) * 0.02).tolist())]
    rows.append((len(rows), [1.0]))
    found = {r["vec_id"]: r for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=16).collect()}
    links = np.zeros(len(rows), int)
    for length in (16, 9, 3):
        for a, b in brute.vector_links([r for r in rows if len(r[1]) == length]):
            first = next(i for i, v in rows if len(v) == length)
            links[[first + a, first + b]] += 1
    assert all(found[i]["n_links"] == c for i, c in enumerate(links)) and links[:-1].min() >= 1 and found[len(rows) - 1]["kept"]
    assert all(found[i]["component_id"] <= i - i % 2 for i in range(len(rows) - 1))


def test_pieces_equal_the_library(docs, odd):
    proto = queries.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    for df in (docs, odd):
        for r in sentence_pieces.encode(df, proto).select("text", "ids", "starts", "ends").collect():
            text = r["text"] or ""
            assert list(r["ids"]) == library.encode(text, add_bos=True, add_eos=True)
            assert r["ends"][-1] == len(text.encode()) and r["starts"][1:] == r["ends"][:-1]


def test_digest(odd):
    proto = queries.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    for r in sentence_pieces.encode(odd, proto, tuple(sentence_pieces.MORE)).select("text", "n_tokens", "ids_sha256", "decoded_sha256").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_compiled_character_maps():
    """The normaliser with a real map of compatibility characters, against the library's own."""
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model = sentencepiece_model_pb2.ModelProto.FromString(queries.piece_model())
    spec = sentencepiece_model_pb2.ModelProto.FromString(rule.serialized_model_proto()).normalizer_spec
    model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = True
    own = sentence_pieces.Pieces(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ("ﬁne  ＡＢＣ ①②", "  two   blanks ", "㍿ ガ ｶﾞ x", "é e\u0301", "", "   ", "plain", "tab\tand\nline", "\u3000wide"):
        ids, starts, ends = own.encode([text])[0]
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert (starts <= ends).all() and ends[-1] <= len(text.encode())


def test_languages(docs):
    model = langid.train(docs, ~queries.held_out())
    found = langid.predict(docs, model).where(queries.held_out() & (F.length("text") > 100))
    right = found.where("lang_pred = lang").count() / found.count()
    assert right > 0.95
    assert found.where("score < 0 or score > 1").count() == 0


def test_texts_without_letters(odd):
    found = langid.predict(odd, langid.train(odd, F.lit(True)))
    assert {r["doc_id"] for r in found.where("lang_pred = 'und'").collect()} == {None, 7, 8, 10}
    assert found.where("lang_pred = 'und' and (score <> 0 or not rejected)").count() == 0


def test_lines(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc\na\nb\nc"), (4, "q\nw\ne\nr\nt"), (5, "0\nq\nw\ne\nr\nt"), (6, None), (7, ""), (None, "q\nw\ne")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(found, "doc_id", "text", "n_lines", "n_removed") == sorted([
        (1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 5, 3), (3, "", 6, 6), (4, "q\nw\ne\nr\nt", 5, 0), (5, "0", 6, 5),
        (6, None, 0, 0), (7, "", 1, 0), (None, "", 3, 3)], key=str)


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, bad, "spam") for i in range(30)] + [(100 + i, good, "spam") for i in range(5)] + [(200 + i, good, "fine") for i in range(30)]
    rows += [(300, good, None), (301, None, None), (302, "a b c " * 30, "fine")]
    found = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not found[100]["kept"] and not found[100]["base_failed"] and found[200]["kept"] and found[300]["kept"] and not found[301]["kept"]
    assert found[302]["n_repeat_words"] == 90 and found[302]["base_failed"]


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, "https://example.net/de/"), (3, "x://org/fr/1#a"), (4, "x://myorg/fr/"), (5, None), (6, "no host"),
            (7, "http://net"), (8, "http://a.example.com/de/"), (9, "http://example.com/en/"), (9, "http://example.com/en/"), (10, "a://b.net/c://x.org/")]
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules)
    assert got(found, "page_id", "host", "path", "rule", "verdict") == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"), (3, "org", "/fr/1", "org/fr/", "allow"),
        (4, "myorg", "/fr/", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "net", "", None, "allow"),
        (8, "a.example.com", "/de/", "example.com/de/", "block"), (9, "example.com", "/en/", None, "allow"), (9, "example.com", "/en/", None, "allow"),
        (10, "b.net", "/c://x.org/", "net/", "block")], key=str)
    assert url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_windows_shorter_than_their_anchor_find_nothing(odd):
    assert repeated_spans(odd.limit(0), Windows(20, 6, True, True), substring_dedup.mark_later).count() == 0
