"""MinHash near-dedup by a multi-index Hamming join.

A document's signature has ``SYMBOLS`` symbols of 16 bits, one for each of as many min-wise
hashes of its shingle set. Signatures that differ in at most a radius of symbols, 2 * chunks - 1, are
found by pigeonhole: one of the chunks differs in at most radius // chunks = 1 symbol, so each chunk
is entered once for each symbol left out, and two documents share an entry. Entries are tied to
their smallest document; within the clusters so made, signatures are compared and links confirmed
on the full sets, nearest pairs first, skipping pairs already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sqlcorpus.llm.arrays import U, all_stretches, encoded, in_slices, LOWER, mix, prefix_sums, random_words, stretch_hash, words_of
from sqlcorpus.llm.components import components
from sqlcorpus.llm.tables import ID, given_id, identified, quoted, small_batches, stage, text_key, without

SHINGLE = 5
SYMBOLS, CHUNKS = 64, 10
RADIUS = 2 * CHUNKS - 1  # for 85 per cent
FLIP, FACTOR = random_words(SYMBOLS, 21), random_words(SYMBOLS, 22) | U(1)
PLACE = random_words(SYMBOLS * (SYMBOLS + 1), 23)
BLOCK_SHINGLES, BLOCK_ROWS = 1_000_000, 2048  # what one side of a comparison holds


def chunks_for(least: int) -> int:
    """Chunks whose radius, twice as many less one, misses about one in a thousand pairs that are exactly at ``least``."""
    p = (100 - least) / 100
    chance = [math.comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(SYMBOLS + 1)]
    return next(c for c in range(1, SYMBOLS + 1) if sum(chance[2 * c :]) < 0.002)


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text (A-Z lower-cased)."""
    _, _, _, words, first = words_of([t.translate(LOWER) for t in texts])
    sums = prefix_sums(words)
    whole = all_stretches(sums, width)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(stretch_hash(sums, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit symbols for each non-empty set."""
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]].astype(np.int64)
    values = np.concatenate(sets)
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((values ^ FLIP[k]) * FACTOR[k], starts)
        out[:, k] = least & U(0xFFFF)
    return out


def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in in_slices(frames, "text"):
        sets = shingle_sets(encoded(frame["text"]))
        full = [k for k, s in enumerate(sets) if len(s)]
        sign: list[bytes | None] = [None] * len(sets)
        h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        if full:
            for k, row in zip(full, signatures([sets[k] for k in full])):
                sign[k] = row.tobytes()
                h1[k], h2[k] = mix(sets[k] ^ U(0xA5A5)).sum(), mix(sets[k] ^ U(0xC3C3C3)).sum()
        yield pd.DataFrame({
            **{c: frame[c].to_numpy() for c in ID}, "n": [len(s) for s in sets],
            "h1": h1.view(np.int64), "h2": h2.view(np.int64), "sign": sign})


def entries(frames: Iterator[pd.DataFrame], chunks: int = CHUNKS) -> Iterator[pd.DataFrame]:
    """Each chunk of each signature once for every symbol left out, as a 64-bit key."""
    shares = [list(map(int, part)) for part in np.array_split(np.arange(SYMBOLS), chunks)]
    for frame in frames:
        if not len(frame):
            continue
        sign = np.stack([np.frombuffer(s, np.uint16) for s in frame["sign"]]).astype(np.uint64)
        keys = []
        for c, places in enumerate(shares):
            terms = mix(sign[:, places] + PLACE[places])
            total = terms.sum(1, dtype=np.uint64)
            keys += [mix(total - terms[:, p] + PLACE[SYMBOLS * (1 + c) + places[p] % SYMBOLS]) for p in range(len(places))]
        yield pd.DataFrame({
            "entry": np.stack(keys, 1).ravel().view(np.int64), "node": np.repeat(frame["node"].to_numpy(), SYMBOLS)})


def link_block(frame: pd.DataFrame, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links among one cluster's rows, or between two blocks of it."""
    frame = frame.drop_duplicates("node")
    node = frame["node"].to_numpy()
    sets = [np.asarray(s).astype(np.int64) for s in frame["shingles"]]
    size = np.array([len(s) for s in sets])
    sign = np.stack([np.frombuffer(s, np.uint16) for s in frame["sign"]])
    crossing = bool(frame["i"].iloc[0] != frame["j"].iloc[0])
    side = frame["side"].to_numpy()
    radius = 2 * chunks_for(least) - 1
    pairs = []
    for a in range(len(node) - 1):
        rest = np.arange(a + 1, len(node))
        if crossing:
            rest = rest[side[rest] != side[a]]
        # sizes alone rule out sets that differ too much
        rest = rest[100 * np.minimum(size[a], size[rest]) >= least * np.maximum(size[a], size[rest])]
        if len(rest):
            apart = (sign[rest] != sign[a]).sum(1)
            near = apart <= radius
            pairs.append(np.stack([apart[near], np.full(near.sum(), a), rest[near]], 1))
    if not pairs:
        return []
    found = np.concatenate(pairs)
    parent = list(range(len(node)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for _, a, b in found[np.argsort(found[:, 0], kind="stable")].tolist():
        x, y = top(a), top(b)
        if x == y:
            continue
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= least * (size[a] + size[b] - common):
            parent[max(x, y)] = min(x, y)
            out.append((int(node[a]), int(node[b])))
    return out


def grouped(docs: DataFrame, least: int) -> DataFrame:
    """``no_id``, ``doc_id`` (0 where null), ``key``, ``n``, ``root``, ``component_id`` per document; the first two without a group where n is 0."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = identified(docs)
    rows = stage(texts.mapInPandas(signed, "no_id boolean, doc_id long, key long, n long, h1 long, h2 long, sign binary"))
    nodes = stage(
        rows.where("n > 0").groupBy("h1", "h2", "n").agg(
            F.min(F.struct(*ID)).alias("first"), F.first("sign").alias("sign"))
        .withColumn("node", F.monotonically_increasing_id()))

    chunks = chunks_for(least)

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return entries(frames, chunks)

    index = nodes.select("node", "sign").mapInPandas(enter, "entry long, node long")
    hubs = index.groupBy("entry").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    ties = stage(index.join(hubs, "entry").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    clusters = stage(components(ties))

    members = clusters.join(nodes, "node")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
    sizes = stage(sizes.withColumn("blocks", F.greatest(
        F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int")))
    small = sizes.agg(F.sum(F.when(F.col("blocks") == 1, F.col("total")))).first()[0] or 0
    shards = int(small // BLOCK_SHINGLES) * 2 + 8
    wanted = members.join(sizes, "root").select("node", "root", "sign", "blocks", "first.*")
    fetched = texts.join(wanted, ID)

    def with_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(encoded(frame["text"]))]
            yield frame[["node", "root", "sign", "blocks"]].assign(shingles=sets)

    sets = fetched.select("node", "root", "sign", "blocks", "text").mapInPandas(
        with_sets, "node long, root long, sign binary, blocks int, shingles array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    task = F.when((F.col("i") == 0) & (F.col("j") == 0) & (F.col("blocks") == 1), F.pmod(F.xxhash64("root"), F.lit(shards)))
    task = F.coalesce(task, F.xxhash64("root", "i", "j"))
    spread = sets.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).withColumn("task", task).select(
        "task", "node", "root", "sign", "shingles", "side", "i", "j")

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        found = [e for _, part in frame.groupby(["root", "i", "j"], sort=False) for e in link_block(part, least)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    links = components(spread.groupBy("task").applyInPandas(link, "a long, b long"))
    first_id = F.when(~F.col("first.no_id"), F.col("first.doc_id")).alias("first_id")
    rooted = nodes.select("node", "h1", "h2", "n", first_id).join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least_id, "root").select("h1", "h2", "n", "root", "component_id")
    return rows.select(*ID, "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left").select(*ID, "n", "root", "component_id")


def near_duplicates(docs: DataFrame, least: int = 85) -> DataFrame:
    """``doc_id``, ``key``, ``n_shingles``, ``component_id``, ``kept``, one row per document.

    Linked are documents whose shingle sets meet in at least ``least`` per cent of their union
    (confirmed on full sets; the signature radius follows from ``least`` and misses about one in a
    thousand pairs that are exactly at it, hardly any three above). Equal sets are one node, so copies never make pairs.
    Empty and null texts are linked with nothing; a null doc_id counts after all others as
    smallest id, and is null where no other is reachable. Repeated rows are linked like any
    copies. Clusters that are large are compared block by block, each block against each.
    """
    found = grouped(docs, least)
    return found.select(
        given_id(), "key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(given_id()).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, least: int = 85) -> DataFrame:
    """One document of each group, the one with the smallest id (null last), then key of the text; same columns.

    Groups are those of linked texts, whatever their ids: unrelated texts under one id are two groups, and copies
    without any id are one. Of rows that repeat the id and the text that stays, one stays. Texts without
    words all stay.
    """
    found = grouped(docs, least)
    times = found.groupBy("root", *ID).agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"))
    first = times.where("n > 0").groupBy("root").agg(F.min(F.struct(*ID, "times")).alias("f")).select("f.*")
    empty = times.where("n = 0").select(*ID, F.lit(1).cast("long").alias("times"))
    stay = stage(first.unionByName(empty))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), text_key().alias("key"))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in without(docs, [])]).alias("row"), own.alias("own")).select("row", "own.*")
    kept = rows.join(stay, ID)
    single = kept.where("times = 1").select("row")
    if stay.where("times > 1").isEmpty():
        return single.select("row.*")
    return single.unionByName(kept.where("times > 1").groupBy(*ID).agg(F.first("row").alias("row")).select("row")).select("row.*")
