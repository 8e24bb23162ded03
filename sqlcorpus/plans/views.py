"""The given tables in the shapes the library works on."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlcorpus.operators.consolidate import unite
from sqlcorpus.operators.ordering import group_bases, nested_totals, position
from sqlcorpus.plans.templates import SYSTEM_PROMPT
from sqlcorpus.schemas import GENERATION, INSTRUCT, MISSING

GEN = ("question", "context", "answer", "extra", "source")
INS = ("text", "input", "output", "source")


def pair_key() -> Column:
    return F.concat("conv_id", F.lit("-"), "turn")


def conversation_file() -> Column:
    """Conversations came in four files; this names the one a conversation lay in."""
    return F.concat(F.lit("conv"), F.col("conv_id") % 4)


def moment() -> Column:
    """Event time in microseconds by the clock it was written with, whatever the session's time zone."""
    ts = F.col("ts")
    whole = (F.unix_date(ts.cast("date")).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return whole * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


class Given:
    """The tables below one folder; each is opened once per query, and only if used."""

    index = "idx"
    # stand-ins for the named source files
    sources = {
        "completion": ("conv0", "conv1", "conv2"),
        "finished": ("src1",),
        "paired": ("conv0", "conv3"),
        "bare": ("src2",),
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.table = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def _placed(self, **totals: list[str]) -> DataFrame:
        """(conv_id, turn, next, …) of the user turns: the conversation's next turn, and their number so far in all or in a group.

        Of the turns only keys are put in order.
        """
        turns = self.table("conversations").select(
            "conv_id", "turn", (F.col("role") == "user").cast("long").alias("asks"), conversation_file().alias("source"))
        return nested_totals(turns, "conv_id", "turn", "asks", totals, "next").filter("asks = 1").drop("asks")

    def pairs(self, **totals: list[str]) -> DataFrame:
        """(conv_id, turn, …, q, a, c): each user turn, the answer if the next turn is one, the system text.

        Turns are unique in a conversation and may have gaps. Every text is moved by (conversation, turn),
        so that a conversation that holds most of the rows is still spread over all tasks. The system
        text meets bare keys first, so that the turns are not moved by conversation. ``totals`` adds
        the number of earlier pairs, in all or in a group, under the names given.
        """
        key = ["conv_id", "turn"]
        turns = self.table("conversations")
        placed = self._placed(**totals)
        asked = turns.filter("role = 'user'").select(*key, F.col("text").alias("q"))
        answers = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("next"), F.col("text").alias("a"))
        system = turns.filter("role = 'system'").select("conv_id", F.col("text").alias("c"))
        contexts = self._asked().join(system, "conv_id")
        joined = placed.join(answers, ["conv_id", "next"], "left").join(asked, key).join(contexts, key, "left")
        return joined.select(*key, *totals, *(["source"] if totals else []), "q", "a", F.coalesce("c", F.lit(MISSING)).alias("c"))

    def _asked(self) -> DataFrame:
        return self.table("conversations").filter("role = 'user'").select("conv_id", "turn")

    def _gen_parts(self, **totals: list[str]) -> tuple[DataFrame, DataFrame]:
        missing = F.lit(MISSING)
        names = {"question": "q", "context": "c", "answer": "a"}
        from_pairs = self.pairs(**totals).withColumnsRenamed({old: new for new, old in names.items()}).withColumns(
            {"extra": missing, "source": F.lit("conversations")}
        )
        from_documents = self.table("documents").select(
            "doc_id", missing.alias("question"), F.col("text").alias("context"),
            F.col("lang").alias("answer"), missing.alias("extra"), F.lit("documents").alias("source"),
        )
        return from_pairs, from_documents

    def gen_keyed(self) -> DataFrame:
        """Generation rows with a unique text key and no index: needs no order at all."""
        from_pairs, from_documents = self._gen_parts()
        return unite([
            from_pairs.select(F.concat("source", F.lit(":"), pair_key()).alias("key"), *GEN),
            from_documents.select(F.concat("source", F.lit(":"), "doc_id").alias("key"), *GEN),
        ])

    def gen_keys(self) -> DataFrame:
        """The keys of ``gen_keyed``, from key columns alone."""
        return unite([
            self._asked().select(F.concat(F.lit("conversations:"), pair_key()).alias("key")),
            self.table("documents").select(F.concat(F.lit("documents:"), "doc_id").alias("key")),
        ])

    def gen(self) -> DataFrame:
        """(idx, question, context, answer, extra, source): idx runs over (source, key)."""
        from_pairs, from_documents = self._gen_parts(idx=[])
        first_document = self._asked().agg(F.count(F.lit(1))).scalar()
        documents = position(from_documents, [], F.col("doc_id"), ["doc_id"], "idx")
        return unite([
            from_pairs.select("idx", *GEN),
            documents.select((F.col("idx") + first_document).alias("idx"), *GEN),
        ])

    def ins(self) -> DataFrame:
        """(idx, text, input, output, source): idx runs over (source, key)."""
        documents = self.table("documents").select("doc_id", "text", "source")
        keys = self._asked().select(conversation_file().alias("source"))
        sizes = unite([keys, documents.select("source")])
        bases = group_bases(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source")
        from_pairs = self.pairs(idx=["source"]).join(bases, "source").select(
            (F.col("idx") + F.col("base")).alias("idx"), F.col("q").alias("input"), F.col("a").alias("output"), "source")
        from_documents = position(documents, ["source"], F.col("doc_id"), ["doc_id"], "idx", base=bases)
        return unite([from_pairs, from_documents.drop("doc_id")]).select("idx", *INS)

    def text_bytes(self) -> int:
        """Bytes of the texts that prompts quote; a system text counts once for each user turn."""
        size = F.octet_length("text").cast("long")
        talks = self.table("conversations").groupBy("conv_id").agg(
            F.sum(size).alias("size"), F.sum(F.when(F.col("role") == "system", size)).alias("system"),
            F.count(F.when(F.col("role") == "user", 1)).alias("asks"),
        ).select((F.col("size") + F.coalesce("system", F.lit(0)) * F.col("asks")).alias("size"))
        texts = unite([talks, *(self.table(name).select(size.alias("size")) for name in ("documents", "benchmark"))])
        return texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]  # one row

    def rows(self, kind: str) -> DataFrame:
        """The table a template reads."""
        if kind == SYSTEM_PROMPT:
            return self.table("benchmark").select(F.col("item_id").alias("idx"), "text")
        return {GENERATION: self.gen, INSTRUCT: self.ins}[kind]()

    def losses(self) -> DataFrame:
        """(run, loss, …) of every event; a run is one user's events of one type."""
        return self.table("events").select(
            F.concat("event_type", F.lit("-"), "user_id").alias("run"), "event_type", "user_id",
            "ts", "event_id", F.col("value").alias("loss"),
        )
