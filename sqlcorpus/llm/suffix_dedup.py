"""Suffix-array dedup of byte strings that occur more than once.

The texts around repeated anchors (see ``windows``) are cut into phrases at borders that two
neighbouring bytes decide; the suffix array of the phrases is built by linear grouping. Windows are equal if their
whole phrases lie in one run of suffixes that share as many phrases, and the few bytes before and after are equal. Phase one
takes the groups of suffixes with equal Lyndon prefixes in descending order and, by pointers to
the previous smaller suffix, moves the suffixes in front of them to larger groups. Phase two
emits each group's order from the suffixes already emitted. No renaming, no recursion.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sqlcorpus.llm.arrays import BYTE_VALUES, U, encoded, in_slices, mix, prefix_sums, stretch_hash
from sqlcorpus.llm.tables import ID, quoted, small_batches, text_key, without
from sqlcorpus.llm.windows import Windows, merged, repeated_spans

LENGTH, ANCHOR = 400, 100
PHRASE = 16  # bytes that a phrase has on average
PAIRS = BYTE_VALUES.astype(np.uint64)
BORDER = mix(PAIRS[:, None] + (PAIRS[None, :] << U(31))) % U(PHRASE) == 0


def suffix_array(text: list[int]) -> list[int]:
    """Order of all suffixes of numbers from 0 on; the last number must be the only 0."""
    n = len(text)
    if not n:
        return []
    # a group is known by the first of the places its suffixes will take
    places = np.argsort(text, kind="stable")
    ranks = np.asarray(text)[places]
    heads = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
    size = [0] * n
    waiting: list[list[int] | None] = [None] * n
    group = [0] * n
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), n]):
        waiting[a] = places[a:b].tolist()
        size[a] = b - a
        for i in waiting[a]:
            group[i] = a
    smaller = [-1] * n
    for g in range(n - 1, -1, -1):
        if waiting[g] is None:
            continue
        members = waiting[g]
        pointed: dict[int, int] = {}
        for i in members:
            if group[i] != g:
                continue
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        # those in front of more members of this group are larger, hence moved first, to the far end
        by_count: dict[int, list[int]] = defaultdict(list)
        for j, times in pointed.items():
            by_count[times].append(j)
        for times in sorted(by_count, reverse=True):
            moving: dict[int, list[int]] = defaultdict(list)
            for j in by_count[times]:
                moving[group[j]].append(j)
            for old, moved in moving.items():
                left = size[old] - len(moved)
                if not left:
                    continue
                size[old] = left
                new = old + left
                size[new] = len(moved)
                moved.sort()
                waiting[new] = moved
                for j in moved:
                    group[j] = new
    order = [-1] * n
    order[0] = n - 1
    free = list(range(n))
    placed = [False] * n
    placed[n - 1] = True
    for r in range(n):
        s = order[r] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
    return order


def shared_prefixes(text: list[int], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix, and by rank how many symbols a suffix shares with the one before it."""
    n = len(text)
    rank = [0] * n
    for r, s in enumerate(order):
        rank[s] = r
    shared = np.zeros(n, np.int64)
    k = 0
    for i in range(n):
        if not rank[i]:
            k = 0
            continue
        j = order[rank[i] - 1]
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        shared[rank[i]] = k
        k = k - 1 if k else 0
    return np.array(rank, np.int64), shared


def mark_equal(frame: pd.DataFrame, w: Windows) -> pd.DataFrame:
    """Windows of each text that are equal to one of another text of the shard.

    Windows with as many whole phrases are equal only if the suffixes at their first border lie in one run of the
    suffix array in which each shares at least these phrases with the one before. The bytes in front of the first and
    behind the last border, less than a phrase each, are told apart by hash; so is a window without whole phrases.
    """
    texts = [bytes(c) for c in frame["context"]]
    size = np.array([len(t) for t in texts])
    start = np.r_[0, np.cumsum(size)]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sums = prefix_sums(BYTE_VALUES[buf])
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = BORDER[buf[:-1], buf[1:]]
    cut[start] = True
    border = np.flatnonzero(cut)
    phrase = stretch_hash(sums, border[:-1], border[1:])
    _, code = np.unique(phrase, return_inverse=True)
    # after each text a symbol of its own; one smaller than all at the end
    after = np.searchsorted(border, start[1:])
    kinds = int(code.max()) + 1 if len(code) else 0
    symbols = np.insert(code + 1, after, kinds + 1 + np.arange(len(texts)))
    string = [*symbols.tolist(), 0]
    rank, shared = shared_prefixes(string, suffix_array(string))
    of_phrase = np.delete(rank[:-1], after + np.arange(len(texts)))  # by number of the phrase
    # only borders that bytes inside the text decide: the first and last of a text are cut where it is
    solid = np.flatnonzero(~np.isin(border, start))
    at_border = border[solid]

    count = size - w.length + 1
    text = np.repeat(np.arange(len(texts)), count)
    first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + start[text]
    lo, hi = np.searchsorted(at_border, first, "right"), np.searchsorted(at_border, first + w.length, "left") - 1
    whole = np.maximum(hi - lo, 0)  # phrases between the first and last border inside the window
    run = np.zeros(len(text), np.int64)
    for k in np.unique(whole[whole > 0]):
        mine = np.flatnonzero(whole == k)
        run[mine] = np.cumsum(shared < k)[of_phrase[solid[lo[mine]]]]
    front = np.where(whole > 0, at_border[np.minimum(lo, len(at_border) - 1)] - first if len(at_border) else 0, 0)
    # equal windows agree in all three; of runs that no other window is in, no bytes are looked at
    group = mix(mix(run.astype(np.uint64) + (whole.astype(np.uint64) << U(40))) + front.astype(np.uint64))
    _, back, times = np.unique(group, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[back] > 1)
    first, text, whole, group = first[some], text[some], whole[some], group[some]
    end = first + w.length
    head_end = np.where(whole > 0, first + front[some], end)
    tail = np.where(whole > 0, at_border[hi[some]] if len(at_border) else 0, end)
    key = mix(group ^ stretch_hash(sums, first, head_end)) + stretch_hash(sums, tail, end)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = times[back] > 1
    off = start[text] + frame["lead"].to_numpy()[text] - first
    return gathered(frame, text[hit], off[hit], w)


def gathered(frame: pd.DataFrame, text: np.ndarray, off: np.ndarray, w: Windows) -> pd.DataFrame:
    """The marked windows of each text as covered stretches, relative to the anchor."""
    out = []
    bounds = np.searchsorted(text, np.arange(len(frame) + 1))
    rows = frame[["g", "c", "lead", "tail"]].to_numpy()
    for k in np.flatnonzero(np.diff(bounds)):
        o = -off[bounds[k] : bounds[k + 1]]
        spans = merged(np.stack([o, o + w.length], 1))
        out.append((*rows[k].tolist(), [{"from": int(a), "to": int(b)} for a, b in spans]))
    return pd.DataFrame(out, columns=["g", "c", "lead", "tail", "spans"])


def dedup_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, **options) -> DataFrame:
    """All columns, with ``n_bytes``, ``n_removed``, ``n_spans`` (long) and ``kept`` (binary).

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else, in
    this document or another; ``n_spans`` counts maximal removed runs. Null and empty texts, and
    those shorter than ``length``, keep all. Repeated rows lose whatever such strings cover. Columns of
    the same names give way; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, Windows(length, anchor, words=False, earlier=False), mark_equal, **options)
    others = without(docs, ["n_bytes", "n_removed", "n_spans", "kept"])
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), "doc_id", "text").select("row", identified_columns(), "text")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts, found in frames:
            out = []
            for t, s in zip(encoded(texts), found):
                m = merged(np.array([(x["from"], x["to"]) for x in s], np.int64)) if s is not None and len(s) else []
                kept, at = [], 0
                for a, b in m:
                    kept.append(t[at:a])
                    at = b
                kept.append(t[at:])
                left = b"".join(kept)
                out.append((len(t), len(t) - len(left), len(m), left))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    made = F.pandas_udf(cut, "n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.select("row", "id.*", "text").join(spans, ID, "left").withColumn("v", made("text", "spans")).select("row.*", "v.*")


def identified_columns():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), text_key().alias("key")).alias("id")
