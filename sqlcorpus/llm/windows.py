"""Repeated windows of fixed length over a whole corpus: what suffix-array and substring dedup have in common.

Each window has one anchor: the stretch inside it whose hash is least (the leftmost of equals). Equal
windows have equal anchors at equal places, so anchors that occur once rule out all their windows.
Occurrences of the other anchors are told apart by the text around them; where an anchor occurs
with different texts, one of each goes to an index that finds the equal windows among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sqlcorpus.llm.arrays import BYTE_VALUES, U, all_stretches, encoded, in_slices, lay_out, mix, prefix_sums, sliding_min, stretch_hash, words_of
from sqlcorpus.llm.tables import ID, identified, small_batches, stage

SHARD_SYMBOLS = 400_000  # symbols of one index
CROWD = 20_000  # texts around one anchor above which its windows are grouped one by one
CLASS = ["g", "c", "lead", "tail"]


@dataclass(frozen=True)
class Windows:
    """``length`` symbols make a window, ``anchor`` an anchor. Symbols are bytes or words."""

    length: int
    anchor: int
    words: bool
    earlier: bool  # only windows that also start earlier count

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the texts end to end as 64-bit values; where each text starts and ends."""
        if self.words:
            _, _, _, values, first = words_of(texts)
            return values, first[:-1], first[1:]
        buf, starts = lay_out(texts)
        return BYTE_VALUES[buf], starts[:-1], starts[1:] - 1


def anchor_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """Text number, first window, last window, anchor, hash of the anchor and of the text of all the run's windows."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if len(values) < w.length:
        return none
    sums = prefix_sums(values)
    hashes = all_stretches(sums, w.anchor)
    hashes = np.append(hashes, stretch_hash(sums, np.array([len(values) - w.anchor]), np.array([len(values)])))
    keys = (hashes >> U(32) << U(32)) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_min(keys, w.length - w.anchor + 1) & U(0xFFFFFFFF)).astype(np.int64)
    count = np.maximum(ends - starts - w.length + 1, 0)
    text = np.repeat(np.arange(len(starts)), count)
    if not len(text):
        return none
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + starts[text]
    own = at[place]
    new = np.r_[True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])]
    first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:] - 1, len(text) - 1]
    a, b, anchor = place[first], place[last], own[first]
    return text[first], a, b, anchor, hashes[anchor], stretch_hash(sums, a, b + w.length)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint (start, end) rows that cover the same places; touching ones become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], 1)


RUN = "no_id boolean, doc_id long, key long, at int, lead int, tail int, g long, c long"
SPAN = "array<struct<from:int,to:int>>"
CONTEXT = "shard int, g long, c long, lead int, tail int, no_id boolean, doc_id long, at int, context binary"
MARK = f"g long, c long, lead int, tail int, spans {SPAN}"


def _scan(w: Windows) -> Callable:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, "text"):
            values, starts, ends = w.symbols(encoded(frame["text"]))
            text, a, b, anchor, g, c = anchor_runs(values, starts, ends, w)
            yield pd.DataFrame({
                "no_id": frame["no_id"].to_numpy()[text], "doc_id": frame["doc_id"].to_numpy()[text], "key": frame["key"].to_numpy()[text], "at": (anchor - starts[text]).astype(np.int32),
                "lead": (anchor - a).astype(np.int32), "tail": (anchor - b).astype(np.int32), "g": g.view(np.int64), "c": c.view(np.int64)})

    return scan


def _cut(w: Windows, shards: int) -> Callable:
    """The texts around the wanted anchors: bytes, or 8 bytes for each word."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, "text"):
            out = []
            texts = encoded(frame["text"])
            values, starts, ends = w.symbols(texts)
            for k, row in enumerate(frame.itertuples(index=False)):
                for x in row.wanted:
                    lo, hi = x["at"] - x["lead"], x["at"] - x["tail"] + w.length
                    context = values[starts[k] + lo : starts[k] + hi].tobytes() if w.words else texts[k][lo:hi]
                    out.append((int(mix(np.array([x["g"]], np.int64).view(np.uint64))[0] % U(shards)), x["g"], x["c"], x["lead"], x["tail"],
                                row.no_id, row.doc_id, x["at"], context))
            yield pd.DataFrame(out, columns=["shard", *CLASS, "no_id", "doc_id", "at", "context"])

    return cut


def _crowded(contexts: DataFrame, w: Windows) -> DataFrame:
    """The same marks for anchors with very many texts, from one row for each window."""
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                values = np.frombuffer(row.context, np.uint64) if w.words else BYTE_VALUES[np.frombuffer(row.context, np.uint8)]
                sums, start = prefix_sums(values), np.arange(row.lead - row.tail + 1)
                window = stretch_hash(sums, start, start + w.length)
                yield pd.DataFrame({
                    "g": row.g, "c": row.c, "lead": row.lead, "tail": row.tail, "off": (row.lead - start).astype(np.int32),
                    "h": window.view(np.int64), "no_id": row.no_id, "doc_id": row.doc_id, "at": row.at})

    order = F.struct("no_id", "doc_id", "at")
    rows = contexts.mapInPandas(each, "g long, c long, lead int, tail int, off int, h long, no_id boolean, doc_id long, at int")
    first = rows.groupBy("g", "off", "h").agg(F.count(F.lit(1)).alias("m"), F.min(order).alias("first")).where("m > 1")
    hit = rows.join(first, ["g", "off", "h"])
    if w.earlier:
        hit = hit.where(order > F.col("first"))
    return hit.groupBy(*CLASS).agg(F.collect_set(F.struct((-F.col("off")).alias("from"), (w.length - F.col("off")).alias("to"))).alias("spans")).select(
        *CLASS, F.col("spans").cast(SPAN).alias("spans"))


def repeated_spans(docs: DataFrame, w: Windows, index: Callable[[pd.DataFrame, Windows], pd.DataFrame], crowd: int = CROWD) -> DataFrame:
    """``no_id``, ``doc_id``, ``key``, ``spans``: the stretches of symbols that repeated windows cover, for documents that have any.

    ``index`` gets the different texts around the anchors of one shard and marks, relative to the
    anchor, windows that are equal to one of another text (with ``earlier``: to one that comes before).
    """
    small_batches(docs.sparkSession)
    texts = identified(docs)
    runs = texts.mapInPandas(_scan(w), RUN)
    often = stage(runs.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g"))
    hits = stage(runs.join(often, "g").select(*ID, "at", *CLASS))
    order = F.struct("no_id", "doc_id", "at", "key")
    classes = stage(hits.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")))
    many = classes.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    several = stage(classes.join(many, "g"))
    length = F.col("lead") - F.col("tail") + w.length
    symbols = several.agg(F.sum(length)).first()[0] or 0
    shards = int(symbols // SHARD_SYMBOLS) + 1
    wanted = several.groupBy(*[F.col(f"first.{c}").alias(c) for c in ID]).agg(
        F.collect_list(F.struct("g", "c", "lead", "tail", F.col("first.at").alias("at"))).alias("wanted"))
    contexts = texts.join(wanted, ID).select("no_id", "doc_id", "text", "wanted").mapInPandas(_cut(w, shards), CONTEXT)

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        return index(frame.drop_duplicates(CLASS), w)

    crowds = several.where(F.col("m") > crowd).select("g").distinct()
    if crowds.isEmpty():
        marks = contexts.groupBy("shard").applyInPandas(mark, MARK)
    else:
        contexts = stage(contexts.dropDuplicates(CLASS))
        marks = contexts.join(crowds, "g", "left_anti").select(*[c.split()[0] for c in CONTEXT.split(", ")]).groupBy("shard").applyInPandas(mark, MARK)
        marks = marks.unionByName(_crowded(contexts.join(crowds, "g"), w))
    marks = stage(marks)

    first = F.struct("no_id", "doc_id", "at")
    one = classes.select(*CLASS, "n", F.struct("first.no_id", "first.doc_id", "first.at").alias("first"))
    # written, so that a text with very many occurrences meets a plain table and its join can be split
    told = stage(one.join(marks, CLASS, "left").where("n > 1 or spans is not null"))
    here = hits.join(told, CLASS)
    whole = F.array(F.struct((F.col("at") - F.col("lead")).alias("from"), (F.col("at") - F.col("tail") + w.length).alias("to"))).cast(SPAN)
    part = F.transform(F.coalesce("spans", F.array().cast(SPAN)), lambda s: F.struct((s["from"] + F.col("at")).alias("from"), (s["to"] + F.col("at")).alias("to"))).cast(SPAN)
    all_of_it = (first != F.col("first")) if w.earlier else (F.col("n") > 1)
    spans = here.select(*ID, F.when(all_of_it, whole).otherwise(part).alias("spans")).where(F.size("spans") > 0)
    # repeated rows of one id and text have equal spans, which are kept once
    return spans.groupBy(*ID).agg(F.flatten(F.collect_set("spans")).alias("spans"))
