"""Line dedup: windows of three neighbouring lines that occurred before are removed, all on the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sqlcorpus.llm.tables import quoted, text_key, without

WINDOW = 3


def lines_of(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id``, ``key``, ``pos`` (from 0), ``h1``, ``h2`` of every window of ``width`` lines."""
    lines = docs.select("doc_id", text_key().alias("key"), lines_of(F.col("text")).alias("lines")).where(F.size("lines") >= width)

    def window(i):
        part = [F.element_at("lines", i + k) for k in range(1, width + 1)]
        return F.struct(F.xxhash64(*part).alias("h1"), F.hash(*part[::-1]).alias("h2"))

    found = F.transform(F.sequence(F.lit(0), F.size("lines") - F.lit(width)), window)
    return lines.select("doc_id", "key", F.posexplode(found).alias("pos", "w")).select("doc_id", "key", "pos", "w.h1", "w.h2")


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id``, ``key``, ``starts``: per document the windows that also start earlier.

    Earlier is a smaller doc_id (null last), or a smaller place in the same one. First places are
    folded before the shuffle, then looked up: no window's occurrences ever form one group.
    """
    windows = line_windows(docs, width)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("pos").alias("p"))
    first = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first")).where("times > 1")
    return (
        windows.join(first.drop("times"), ["h1", "h2"]).where(order > F.col("first"))
        .groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("pos")).alias("starts"))
    )


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """All columns, ``text`` without the lines that repeated windows cover, and ``n_lines``, ``n_removed`` (long).

    Lines end at ``\\n`` only and are compared as they are. A null text stays null and has 0 lines;
    an empty one has one line. Texts of fewer lines than the window are left alone, and if all
    lines go the text is empty. Rows with equal id and text are one document as to what is
    earlier: both stay. Columns named ``n_lines`` or ``n_removed`` give way.
    """
    others = without(docs, ["n_lines", "n_removed"])
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), F.col("doc_id").alias("doc_id"),
        F.col("text").alias("text"), text_key().alias("key"))
    hits = repeated_windows(docs, width).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "starts")
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["d"]) & (rows["key"] == hits["k"]), "left")
    lines = lines_of(F.col("text"))
    ends = F.concat(F.array(F.lit(-width)), F.col("starts"), F.array(F.size("lines")))
    # a kept piece lies between the end of one covered window and the start of the next
    pieces = F.filter(
        F.zip_with(F.slice("ends", F.lit(1), F.size("ends") - 1), F.slice("ends", F.lit(2), F.size("ends") - 1),
                   lambda a, b: F.struct((a + width).alias("start"), (b - a - width).alias("len"))),
        lambda p: p["len"] > 0)
    cut = joined.withColumn("lines", lines).withColumn("ends", ends).withColumn("pieces", F.when(F.col("starts").isNotNull(), pieces))
    kept = F.flatten(F.transform("pieces", lambda p: F.slice("lines", p["start"] + 1, p["len"])))
    text = F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    stay = F.aggregate("pieces", F.lit(0), lambda n, p: n + p["len"])
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    return cut.select(
        F.col("row").withField("text", text).alias("row"), total.cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("lines") - stay).cast("long").alias("n_removed"),
    ).select("row.*", "n_lines", "n_removed")
