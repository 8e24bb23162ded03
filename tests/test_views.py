"""The given tables in other shapes, where the given rows do not go."""

from sqlcorpus.plans.views import Given


def test_pairs_follow_the_order_of_turns(spark, tmp_path, rows):
    spark.createDataFrame([
        (1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 3, "assistant", "a3"), (1, 4, "user", "q4"), (1, 9, "user", "q9"),
        (1, 10, "assistant", "a10"), (1, 12, "assistant", "a12"), (2, 5, "assistant", "b5"), (2, 6, "user", "q6"),
        (3, 2, "user", "r2"), (3, 3, "system", "t"), (3, 4, "assistant", "b4"),
    ], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(Given(spark, str(tmp_path)).pairs(), "conv_id", "turn", "q", "a", "c") == [
        (1, 1, "q1", "a3", "s"), (1, 4, "q4", None, "s"), (1, 9, "q9", "a10", "s"), (2, 6, "q6", None, "NULL"), (3, 2, "r2", None, "t")]


def test_texts_are_measured_as_often_as_pairs_quote_them(spark, tmp_path):
    spark.createDataFrame([
        (1, 0, "system", "12345"), (1, 1, "user", "q"), (1, 2, "assistant", "ab"), (1, 3, "user", None), (2, 0, "user", "ü"), (3, 0, "system", "s"),
    ], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame([(1, "1234567890"), (2, None)], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    # a conversation's own 8 bytes and its system text for two user turns; a letter of two bytes; a system text that nobody asks under
    assert Given(spark, str(tmp_path)).text_bytes() == (8 + 2 * 5) + 2 + 1 + 2 * 10
