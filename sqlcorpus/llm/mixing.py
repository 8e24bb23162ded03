"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target number of words. A document's rate is target / size of its source: the
whole part is taken outright, the fraction is an inclusion probability. The flight moves these
probabilities, three units at a time, along the one direction that changes neither the words
nor the number of documents expected, until all but two units of a group are decided. Undecided
units of all groups meet in fewer groups, level by level; the last few of a source land.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sqlcorpus.llm.tables import WORD, quoted, small_batches, stage, without

MOST = 3  # times that a document, and a source, may be taken
GROUP = 20_000  # units that one task decides at a time
LANDED = 14  # units of a source that land together with the at most two left by the flight
SEED = 11


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``rank``, ``target`` from ``source``, ``source_size``.

    Weights 1, 2, 3 repeat over the sources by code point, null last. The level that reshared
    excess settles at is found from running sums over one narrow row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    ceiling = (F.lit(most) * F.col("source_size")).cast("double")
    ordered = Window.orderBy(ceiling / F.col("weight"), "rank")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(ceiling).over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = ranked.withColumn("level", level).withColumn(
        "settled", F.max(F.when(F.col("level") <= ceiling / F.col("weight"), F.col("level"))).over(every))
    return levels.select("source", "source_size", "rank", F.least(ceiling, F.col("settled") * F.col("weight")).alias("target"))


def flight(words: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances after the walk: all 0 or 1 but for at most two. Sums of chance and words * chance stay."""
    out, size = chance.tolist(), words.astype(float).tolist()
    draws = rng.random(len(out) + 1).tolist()
    active: list[int] = []
    for unit in range(len(out)):
        if 0.0 < out[unit] < 1.0:
            active.append(unit)
        if len(active) < 3:
            continue
        a, b, c = active
        way = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not (way[0] or way[1]):
            way = (1.0, -1.0, 0.0)
        active = _move(out, active, way, draws[unit])
    return np.array(out)


def landing(words: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Decides the last units: of all their subsets the one nearest to the words, then to the number, expected."""
    active = np.flatnonzero((chance > 0) & (chance < 1))
    taken = (np.arange(1 << len(active))[:, None] >> np.arange(len(active)) & 1).astype(float)
    off = taken - chance[active]
    out = chance.copy()
    out[active] = taken[np.argmin(np.abs(off @ words[active]) + 0.01 * np.abs(off.sum(1)))]
    return out


def _move(out: list[float], active: list[int], way: tuple[float, ...], draw: float) -> list[int]:
    ahead = back = np.inf
    for unit, step in zip(active, way):
        if step > 0:
            ahead, back = min(ahead, (1 - out[unit]) / step), min(back, out[unit] / step)
        elif step < 0:
            ahead, back = min(ahead, out[unit] / -step), min(back, (1 - out[unit]) / -step)
    by = ahead if draw * (ahead + back) < back else -back
    for unit, step in zip(active, way):
        moved = out[unit] + by * step
        out[unit] = 0.0 if moved < 1e-9 else 1.0 if moved > 1 - 1e-9 else moved
    return [u for u in active if 0.0 < out[u] < 1.0]


UNIT = "rank int, doc_id long, size long, times long, place long, chance double"


def _decide(level: int, last: bool, seed: int):
    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        # large units first: those left over at the end are small, and so is what landing them changes
        frame = frame.sort_values(["size", "place", "doc_id"], ascending=[False, True, True], kind="stable")
        words = (frame["size"] * frame["times"]).to_numpy()
        rng = np.random.Generator(np.random.PCG64([seed, level, int(frame["rank"].iloc[0]), int(frame["bucket"].iloc[0])]))
        chance = frame["chance"].to_numpy().copy()
        # some units of all sizes are kept for the landing, so that their sums can meet the target
        held = np.unique(np.linspace(0, len(frame) - 1, LANDED).astype(int)) if last else np.zeros(0, int)
        flown = np.setdiff1d(np.arange(len(frame)), held)
        chance[flown] = flight(words[flown], chance[flown], rng)
        if last:
            chance = landing(words, chance)
        return frame.assign(chance=chance).drop(columns="bucket")

    return decide


def draw_units(units: DataFrame, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """``units`` (UNIT) with every chance moved to 0 or 1."""
    small_batches(units.sparkSession)
    left, done, level = units, [], 0
    while True:
        counts = left.groupBy("rank").agg((F.floor(F.count(F.lit(1)) / group) + 1).cast("int").alias("buckets"))
        most = counts.agg(F.max("buckets")).first()[0]
        if most is None:
            break
        dealt = left.join(counts, "rank").withColumn(
            "bucket", F.pmod(F.xxhash64("place", F.lit(level)), F.col("buckets")).cast("int")).drop("buckets")
        moved = stage(dealt.groupBy("rank", "bucket").applyInPandas(_decide(level, most == 1, seed), UNIT))
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(moved.where(~open_))
        if most == 1:
            break
        left, level = moved.where(open_), level + 1
    out = done[0] if done else units
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mixing_plan(docs: DataFrame, most: int = MOST, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``times``, ``source_size``, ``target``, ``copies``, one row per unit.

    A unit is all rows that agree in doc_id, source and size (``times`` of them, mostly one); they are
    taken alike. A null or empty text has size 0; a source without words has target 0; null is a
    source of its own. The draw depends on ids and sizes alone, not on partitions.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    units = stage(docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), size.alias("size"))
                  .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")))
    aims = stage(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size")), most))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    named = aims.withColumnRenamed("source", "s")
    rated = units.join(named, units["source"].eqNullSafe(named["s"])).drop("s").withColumn("rate", rate)
    chance = F.col("rate") - F.floor("rate")
    chances = rated.where(chance > 0).select(
        "rank", "doc_id", "size", "times", F.xxhash64("doc_id", "size", F.lit(seed)).alias("place"), chance.alias("chance"))
    drawn = draw_units(chances, group, seed).where("chance = 1").select(
        F.col("rank").alias("r"), F.col("doc_id").alias("d"), F.col("size").alias("z"), F.lit(1).alias("extra"))
    return rated.join(
        drawn, (rated["rank"] == drawn["r"]) & rated["doc_id"].eqNullSafe(drawn["d"]) & (rated["size"] == drawn["z"]), "left",
    ).select("doc_id", "source", "size", "times", "source_size", "target",
             (F.floor("rate") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the plan takes it (0 to 3 times), same columns."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    plan = mixing_plan(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "copies")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in without(docs, [])]).alias("row"),
                       F.col("doc_id").alias("d"), F.col("source").alias("s"), size.alias("z"))
    taken = rows.join(plan, rows["d"].eqNullSafe(plan["p_id"]) & rows["s"].eqNullSafe(plan["p_source"]) & (rows["z"] == plan["p_size"]))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
