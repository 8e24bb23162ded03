"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits the vectors again and again near the median of a random projection; vectors
close to a border go to both sides. Vectors are compared with those in their leaves only, links are
verified in double precision and joined to components. A pair that meets in several leaves is
counted in the first of them, which both ends know from their lists of leaves. The margin follows
from the distance at the least cosine where a leaf is narrow; leaves that are too dense to split are
compared whole, block by block, each block with each. Vectors of other lengths than the commonest start in
one leaf of each tree for each length, and are split like large leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus.llm.components import components
from sqlcorpus.llm.tables import stage

TREES = 12
LEAF = 256  # vectors that a leaf should hold
MOST = 2048  # vectors in a leaf above which it is split further, and in a block of a leaf that is dense
DENSE = 0.7  # share of a leaf on one side from which on blocks, each with each, copy less than more splits
SPILL = 0.1  # standard deviations around a border within which a vector goes to both sides
SAMPLE = 8192  # vectors that the first borders are taken from
ROUNDS = 40
OTHER = 1 << 62  # leaves that vectors of less common lengths start in are numbered from here


def unit_rows(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def direction(tree: int, level: int, dims: int) -> np.ndarray:
    way = np.random.Generator(np.random.PCG64([31, tree, level])).normal(size=dims)
    return way / np.linalg.norm(way)


def margin_of(ratio: float, spill: float) -> float:
    """Standard deviations of a leaf within which vectors spill, at least ``spill``.

    ``ratio`` is the spread, along a direction, of pairs that are just linked, over the leaf's own.
    This margin keeps the chance that a split cuts such a pair near 0.08 for ratios of up to 1.3.
    """
    return max(spill, 0.45 * ratio * ratio)


def pair_spread(dims: int, least: float) -> float:
    """Standard deviation, along a random direction, of the difference of two unit vectors with cosine ``least``."""
    return math.sqrt(max(0.0, 2 - 2 * least) / dims)


def trees_for(total: int, trees: int) -> int:
    """More trees where so many splits are needed that pairs with the least cosine would be cut in most of ``trees``."""
    splits = math.log2(max(1, total / LEAF)) if total <= SAMPLE * 32 else 10 + max(0.0, math.log(total / 1024 / MOST) / math.log(1 / 0.54))
    return max(trees, math.ceil(math.log(0.03) / math.log(1 - 0.92 ** max(1.0, splits))))


def grow(sample: np.ndarray, depth: int, trees: int, spill: float, least: float) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each tree and level: the border of every node (left to right), and the margin around it.

    Dense nodes have no border: they stay whole, on the low side.
    """
    forest = []
    for tree in range(trees):
        at = np.zeros(len(sample), np.int64)
        levels = []
        for level in range(depth):
            value = sample @ direction(tree, level, sample.shape[1]) if len(sample) else np.zeros(0)
            spread, all_sd = pair_spread(sample.shape[1], least), float(value.std()) if len(value) else 0.0
            borders = np.full(1 << level, float(np.median(value)) if len(value) else 0.0)
            margins = np.full(1 << level, spill * all_sd)
            order = np.lexsort((value, at))
            cuts = np.searchsorted(at[order], np.arange((1 << level) + 1))
            for node in np.flatnonzero(np.diff(cuts)):
                mine = value[order[cuts[node] : cuts[node + 1]]]
                borders[node] = np.median(mine)
                if len(mine) < 8:  # too few to tell how dense they are
                    continue
                sd = float(mine.std())
                margins[node] = max(spill * all_sd, margin_of(spread / sd, spill) * sd) if sd else math.inf
                if max((mine - borders[node] <= margins[node]).mean(), (mine - borders[node] > -margins[node]).mean()) > DENSE:
                    borders[node] = math.inf
            levels.append((borders, margins))
            at = at * 2 + (value > borders[at])
        forest.append(levels)
    return forest


def leaves(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and leaf of every vector, once for each leaf that it spills into."""
    row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level, (borders, margins) in enumerate(levels):
        whole = np.isinf(borders[at])
        value, margin = (x @ direction(tree, level, x.shape[1]))[row] - borders[at], margins[at]
        low, high = whole | (value <= margin), ~whole & (value > -margin)
        row, at = np.r_[row[low], row[high]], np.r_[at[low] * 2, at[high] * 2 + 1]
    return row, at


def met_before(lists: np.ndarray, here: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` (down) and ``b`` (across) share a leaf with a smaller number than ``here``."""
    found = np.zeros((len(a), len(b)), bool)
    earlier = [np.unique(part[(part >= 0) & (part < here)]) for part in (lists[a], lists[b])]
    shared = np.intersect1d(*earlier)
    for lo in range(0, len(shared), 512):
        some = shared[lo : lo + 512]
        sides = []
        for rows in (a, b):
            place = np.minimum(np.searchsorted(some, lists[rows]), len(some) - 1)
            r, c = np.nonzero(some[place] == lists[rows])
            member = np.zeros((len(rows), len(some)), np.float32)
            member[r, place[r, c]] = 1
            sides.append(member)
        found |= (sides[0] @ sides[1].T) > 0
    return found


def compare_leaf(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Per vector of one leaf, or of two blocks of it: ``root`` of its links here, and links first met here (copies of ends counted)."""
    frame = frame.sort_values("node")
    node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
    here, i, j = (int(frame[c].iloc[0]) for c in ("leaf", "i", "j"))
    x = unit_rows(frame["embedding"].tolist())
    width = max(len(v) for v in frame["all_leaves"])
    lists = np.full((len(node), width), -1, np.int64)
    for k, v in enumerate(frame["all_leaves"]):
        lists[k, : len(v)] = v
    side = frame["side"].to_numpy()
    down, across = np.flatnonzero(side == i), np.flatnonzero(side == j)
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    for start in range(0, len(down), 512):
        a = down[start : start + 512]
        near = (x[a] @ x[across].T) >= least
        if i == j:
            near &= a[:, None] < across
        rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            continue
        a, b, near = a[rows], across[columns], near[np.ix_(rows, columns)]
        first = near & ~met_before(lists, here, a, b)
        links[a] += first @ copies[b]
        links[b] += copies[a] @ first
        for k, row in zip(a.tolist(), near):
            ends = label[b[row]]
            low, high = min(ends.min(), label[k]), max(ends.max(), label[k])
            if low != high:
                label[np.isin(label, np.append(ends, label[k]))] = low
    return pd.DataFrame({"node": node, "root": node[label], "links": links})


def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each unit vector's place along a direction that belongs to its leaf alone (a leaf belongs to one tree)."""
    for frame in frames:
        if not len(frame):
            continue
        value, dims = np.zeros(len(frame)), np.zeros(len(frame), np.int32)
        for leaf, at in frame.groupby("leaf").indices.items():
            x = unit_rows(frame["embedding"].iloc[at].tolist())
            dims[at] = x.shape[1]
            value[at] = x @ direction(97, int(leaf), x.shape[1])
        yield frame[["leaf", "node"]].assign(value=value, dims=dims)


def split_leaves(rows: DataFrame, spill: float, least: float = 0.9) -> DataFrame:
    """Splits leaves of over ``MOST`` vectors until there are none, or those left are dense and stay whole."""
    done = None
    for again in range(ROUNDS):
        sizes = stage(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MOST))
        if sizes.isEmpty():
            break
        large = stage(rows.join(sizes.select("leaf"), "leaf").select("leaf", "node", "embedding").mapInPandas(project, "leaf long, node long, value double, dims int"))
        borders = large.groupBy("leaf").agg(
            F.percentile_approx("value", F.lit(0.5), F.lit(1000)).alias("border"), F.stddev_pop("value").alias("sd"),
            F.max("dims").alias("d")).withColumn("spread2", F.lit(pair_spread(1, least) ** 2) / F.col("d"))
        step = F.col("value") - F.col("border")
        margin = F.greatest(F.lit(spill) * F.col("sd"), F.lit(0.45) * F.col("spread2") / F.col("sd"))  # as margin_of
        margin = F.when(F.col("sd") > 0, margin).otherwise(float("inf"))

        def child(side: int) -> Column:  # compare_leaf takes leaves below 0 for none
            return F.xxhash64("leaf", F.lit(again), F.lit(side)).bitwiseAND(F.lit(2**63 - 1))

        sided = large.join(borders, "leaf").select("leaf", "node", (step <= margin).alias("low"), (step > -margin).alias("high"))
        shares = sided.groupBy("leaf").agg(F.greatest(F.avg(F.col("low").cast("int")), F.avg(F.col("high").cast("int"))).alias("share"))
        cut = stage(shares.where(F.col("share") <= DENSE).select("leaf"))
        sides = F.filter(F.array(F.when(F.col("low"), child(0)), F.when(F.col("high"), child(1))), lambda s: s.isNotNull())
        halves = rows.join(sided.join(cut, "leaf"), ["leaf", "node"]).withColumn("leaf", F.explode(sides)).select(*rows.columns)
        rest = rows.join(cut, "leaf", "left_anti").select(*rows.columns)
        done = rest if done is None else done.unionByName(rest)
        rows = stage(halves)
    return rows if done is None else done.unionByName(rows)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Vectors of leaves of over ``MOST`` once for each other block of the leaf: ``side`` is a vector's own, ``i`` <= ``j`` are those that meet."""
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / MOST).cast("int").alias("blocks")).where("blocks > 1")
    dealt = rows.join(sizes, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("side", "other")).withColumn(
        "j", F.greatest("side", "other")).drop("blocks", "other")


def near_vectors(vectors: DataFrame, least: float = 0.9, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept``, one row per vector of ``vec_id``, ``embedding``.

    Linked are vectors found together in a leaf with cosine ``least`` or more. Equal vectors are
    one node: they are linked with each other and never compared. Null, empty, zero vectors and
    those with null or non-finite components link with nothing. Vectors of different lengths have no
    cosine and are never linked; those of one length are, however rare it is. A null vec_id counts
    after all others as smallest id. Other columns are not read.
    """
    valid = (F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(
        "embedding", lambda v: v != 0)
    named = vectors.select(F.col("vec_id").alias("vec_id"), F.when(valid, F.col("embedding")).alias("embedding"))
    nodes = stage(named.where("embedding is not null").groupBy("embedding").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()))
    common = nodes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims, total = (common[0]["d"], common[0]["count"]) if common else (1, 0)
    depth = max(0, math.ceil(math.log2(max(1, min(total, SAMPLE * 32) / leaf))))
    drawn = nodes.where(F.size("embedding") == dims).select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).collect()
    sample = unit_rows([r[0] for r in drawn]) if drawn else np.zeros((0, dims))
    model = nodes.sparkSession.sparkContext.broadcast(grow(sample, depth, trees_for(total, trees), spill, least))

    def drop_down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            node, length = frame["node"].to_numpy(), frame["embedding"].map(len).to_numpy(dtype=np.int64)
            own, other = length == dims, length != dims
            x = unit_rows(frame["embedding"][own].tolist()) if own.any() else np.zeros((0, dims))
            for tree, levels in enumerate(model.value):
                row, at = leaves(x, levels, tree)
                yield pd.DataFrame({"node": node[own][row], "leaf": (tree << 40) + at})
                yield pd.DataFrame({"node": node[other], "leaf": OTHER + (tree << 40) + length[other]})

    placed = nodes.select("node", "embedding").mapInPandas(drop_down, "node long, leaf long")
    kind = dict(nodes.dtypes)["embedding"]
    rows = stage(placed.join(nodes.select("node", "embedding", "copies"), "node").select("node", "leaf", "embedding", "copies"))
    rows = split_leaves(rows, spill, least)
    lists = rows.groupBy("node").agg(F.collect_list("leaf").alias("all_leaves"))  # some dozens for each vector
    full = rows.join(lists, "node").select("leaf", "node", "copies", F.col("embedding").cast(kind), "all_leaves")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return compare_leaf(frame, least)

    found = stage(in_blocks(full).groupBy("leaf", "i", "j").applyInPandas(compare, "node long, root long, links long"))
    linked = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = nodes.join(counts, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    result = grouped.join(smallest, "root").select(
        F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = named.join(result, named["embedding"] == result["e"], "left")
    component = F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
