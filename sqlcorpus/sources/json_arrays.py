"""The records of JSON array files, whatever their size and line ends, by as many tasks as the files have pieces.

A file is read as text cut at every closing brace, which splits anywhere. What a fragment does to the state of the
document (inside a string or not, depth of nesting) depends on the state at its start only by
whether that is inside a string: an escape never spans a brace that closes. So each piece of a file is summed up for
both cases, a small table puts the pieces of a file in a row, and then every fragment knows its
depth and every record its number. Only the fragments of one record are ever brought together.

The records are then kept as JSON lines, since Spark's reader of those gives values as they are spelt.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sqlcorpus.operators.ordering import before
from sqlcorpus.session import staging_root
from sqlcorpus.sources.paths import literals
from sqlcorpus.sources.place import PIECE, PROVENANCE, with_provenance

STRING = '"[^"]*+(?:"|$)'


def _depth(outside: Column) -> Column:
    """Openings less closings in text that holds no strings; the brace that ends a fragment is not in it."""
    opened = F.length(outside) - F.length(F.translate(outside, "{[", ""))
    return opened - (F.length(outside) - F.length(F.replace(outside, F.lit("]"), F.lit(""))))


def _fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Fragments with their quotes, the depth they add from either state, and the same of those before in the piece."""
    lines = with_provenance(spark.read.option("lineSep", "}").text(literals(paths)))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))) % 2
    lines = lines.select("*", quotes.cast("int").alias("_quotes"), plain.alias("_plain"))
    # the closing brace counts where the fragment ends outside of strings
    from_out = _depth(F.regexp_replace("_plain", STRING, "")) - (1 - F.col("_quotes"))
    from_in = _depth(F.regexp_replace(F.regexp_replace("_plain", '^[^"]*+(?:"|$)', ""), STRING, "")) - F.col("_quotes")
    lines = lines.select("value", *PROVENANCE, "_quotes", F.array(from_out, from_in).alias("_adds"))
    lines = lines.select("*", (before("_quotes", PIECE, "_row") % 2).cast("int").alias("_seen"))
    for start in (0, 1):  # as if the piece began outside, or inside, of a string
        lines = lines.withColumn(f"_add{start}", F.get("_adds", (F.col("_seen") + start) % 2).cast("long"))
    lines = lines.select("*", *(before(f"_add{s}", PIECE, "_row").alias(f"_rel{s}") for s in (0, 1)))
    return lines.drop("_adds")


def _pieces(fragments: DataFrame) -> DataFrame:
    """Each piece with its state at the start, the records that end before it, and the number of its file."""
    def case(s: int) -> Column:
        ends_outside = (F.col("_seen") + s + F.col("_quotes")) % 2 == 0
        after = F.col(f"_rel{s}") + F.col(f"_add{s}")
        return F.struct(F.lit(s).alias("s"), F.when(ends_outside, after).alias("depth"), F.col(f"_add{s}").alias("add"))

    each = fragments.select(*PIECE, "_quotes", F.explode(F.array(case(0), case(1))).alias("c"))
    by_depth = each.groupBy(*PIECE, "c.s", "c.depth").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c.add").alias("add"), F.sum("_quotes").alias("quotes"))
    summed = by_depth.groupBy(*PIECE).pivot("s", [0, 1]).agg(
        F.sum("add").alias("add"), F.sum("quotes").alias("quotes"),
        F.map_from_entries(F.collect_list(F.when(F.col("depth").isNotNull(), F.struct("depth", "n")))).alias("ends"))
    states = summed.select(*PIECE, "0_add", "1_add", "0_quotes", "0_ends", "1_ends", (before("0_quotes", ["_path"], "_block") % 2).alias("_in"))

    def chosen(name: str) -> Column:
        return F.when(F.col("_in") == 0, F.col(f"0_{name}")).otherwise(F.col(f"1_{name}"))

    states = states.select(*PIECE, "_in", "0_quotes", chosen("add").alias("add"), chosen("ends").alias("ends"))
    states = states.select("*", before("add", ["_path"], "_block").alias("_depth"))
    # a record ends where a closing brace leads back to the depth of the array
    ended = F.coalesce(F.try_element_at("ends", 1 - F.col("_depth")), F.lit(0))
    states = states.select("*", ended.alias("_ended"))
    file = W.partitionBy("_path")
    # the rest after the last brace counts one that is not there
    sound = (F.sum("add").over(file) == -1) & (F.sum("0_quotes").over(file) % 2 == 0)
    first = F.when(sound, before("_ended", ["_path"], "_block")).otherwise(
        F.raise_error(F.concat(F.lit("not one whole JSON array: "), "_path")))
    return states.select(
        *PIECE, "_in", "_depth", first.alias("_first"), (F.dense_rank().over(W.orderBy("_path")) - 1).cast("int").alias("_number"))


def array_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value`` (the text of one object) and provenance for every element of the arrays; a file is one piece.

    Files that are not one array of objects are an error.
    """
    fragments = _fragments(spark, paths)
    placed = fragments.join(_pieces(fragments), PIECE)

    def chosen(name: str) -> Column:
        return F.when(F.col("_in") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    start = F.col("_depth") + chosen("_rel")
    inside = (F.col("_in") + F.col("_seen") + F.col("_quotes")) % 2 == 1
    placed = placed.select(
        "_path", "_file", "_block", "_row", "value", "_first", "_number", start.alias("_start"), inside.alias("_inside"),
        (start + chosen("_add")).alias("_end"))
    closes = ~F.col("_inside") & (F.col("_end") == 1)
    placed = placed.select("*", closes.alias("_closes"))
    record = F.col("_first") + before("_closed", PIECE, "_row")
    placed = placed.withColumn("_closed", F.col("_closes").cast("long")).select("*", record.alias("_record"))
    # what follows the last record closes the array, and that of an empty one opens it as well
    rest = F.regexp_replace("value", r"\s", "")
    last = F.col("_end") == -1
    fine = rest == F.when(F.col("_record") == 0, "[]").otherwise("]")
    checked = F.when(last & ~fine, F.raise_error(F.concat(F.lit("more than objects in the array of "), "_path"))).otherwise(F.col("value"))
    placed = placed.select("_path", "_file", "_block", "_row", "_number", "_record", "_start", "_closes", last.alias("_last"), checked.alias("value"))
    whole = placed.filter("_closes AND _start <= 1")
    parts = placed.filter("NOT (_closes AND _start <= 1) AND (NOT _last OR value IS NULL)")
    in_order = F.sort_array(F.collect_list(F.struct("_block", "_row", "value")))
    joined = parts.groupBy("_path", "_file", "_number", "_record").agg(
        F.array_join(F.transform(in_order, lambda part: part["value"]), "}").alias("value"))
    texts = whole.select("_path", "_file", "_number", "_record", "value").unionByName(joined)
    # the separator in front and the brace at the end
    value = F.concat(F.regexp_replace("value", r"^[\s,\[]++", ""), F.lit("}"))
    return texts.select(
        value.alias("value"), "_path", "_file", F.lit(0).cast("long").alias("_block"), F.col("_record").alias("_row"),
        F.col("_number").alias("_lane"))


def stage_as_lines(spark: SparkSession, paths: str | list[str]) -> str:
    """A folder below the staging root with a JSON line for each record: it as ``value``, and its provenance."""
    records = array_elements(spark, paths)
    place = F.to_json(F.struct(*PROVENANCE))
    # line ends between the parts of a record; within strings there are none
    line = F.concat(F.lit('{"value":'), F.translate("value", "\r\n", "  "), F.lit(","), F.substring(place, F.lit(2), F.length(place)))
    folder = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    records.select(line).write.text(folder)
    return folder
