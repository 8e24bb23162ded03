"""Substring dedup with a compressed full-text index per shard.

The texts around repeated anchors (see ``windows``) of a shard make one string of words. Its
Burrows-Wheeler transform lies in a wavelet tree of packed bits; backward search extends the
match of every window end by end, all windows of the streamed texts in step, for as long as the
match occurs elsewhere. Windows whose matching statistic reaches the threshold are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sqlcorpus.llm.suffix_dedup import gathered, identified_columns
from sqlcorpus.llm.tables import ID, quoted, small_batches, without
from sqlcorpus.llm.windows import Windows, merged, repeated_spans

LENGTH, ANCHOR = 20, 6


class Bits:
    """Packed bits with counts of ones before every word of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, end: np.ndarray) -> np.ndarray:
        word, bit = end >> 6, (end & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Counts of a symbol among the first entries of a sequence, level by level from its highest bit."""

    def __init__(self, values: np.ndarray) -> None:
        self.depth = max(1, int(values.max(initial=0)).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level & 1).astype(np.uint8)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            values = np.r_[values[bit == 0], values[bit == 1]]

    def count(self, symbol: np.ndarray, end: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """How often each symbol is among the first ``end`` entries."""
        lo, hi = np.zeros_like(end), end
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - k) & 1).astype(bool)
            low, high = bits.ones(lo), bits.ones(hi)
            lo, hi = np.where(one, zeros + low, lo - low), np.where(one, zeros + high, hi - high)
        return hi - lo


def suffix_order(string: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; stops once all ranks differ."""
    _, rank = np.unique(string, return_inverse=True)
    n, step = len(string), 1
    while True:
        key = (rank + 1) * (n + 2)
        key[: n - step] += rank[step:] + 1
        _, rank = np.unique(key, return_inverse=True)
        if int(rank.max()) == n - 1:
            return np.argsort(rank)
        step *= 2


class FMIndex:
    def __init__(self, string: np.ndarray) -> None:
        """``string``: numbers whose last is the only smallest one."""
        self.order = suffix_order(string)
        self.tree = WaveletTree(string[self.order - 1])
        self.first = np.searchsorted(np.sort(string), np.arange(int(string.max()) + 2))

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes in [lo, hi) with the symbol put in front."""
        both = self.tree.count(np.r_[symbol, symbol], np.r_[lo, hi])
        base = self.first[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def matches(self, string: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every ``end``: how many symbols before it occur elsewhere too (``most`` at most), and their rows."""
        length = np.zeros(len(end), np.int64)
        low, high = np.zeros(len(end), np.int64), np.full(len(end), len(string), np.int64)
        live = np.arange(len(end))
        for k in range(1, most + 1):
            lo, hi = self.back(string[end[live] - k], low[live], high[live])
            more = hi - lo > 1
            live, lo, hi = live[more], lo[more], hi[more]
            low[live], high[live] = lo, hi
            length[live] = k
            if not len(live):
                break
        return length, low, high


def mark_later(frame: pd.DataFrame, w: Windows) -> pd.DataFrame:
    """Windows of each text that are equal to an earlier one of another text of the shard."""
    texts = [np.frombuffer(bytes(c), np.uint64) for c in frame["context"]]
    size = np.array([len(t) for t in texts])
    start = np.r_[0, np.cumsum(size + 1)]
    _, code = np.unique(np.concatenate(texts), return_inverse=True)
    kinds = int(code.max()) + 1
    string = np.insert(code + 1, np.cumsum(size), kinds + 1 + np.arange(len(texts)))
    string = np.append(string, 0)
    index = FMIndex(string)
    count = size - w.length + 1
    text = np.repeat(np.arange(len(texts)), count)
    first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    length, low, _ = index.matches(string, start[text] + first + w.length, w.length)
    full = length >= w.length
    text, first, low = text[full], first[full], low[full]
    off = frame["lead"].to_numpy()[text] - first
    # rank of every occurrence: doc_id (null last), then place
    no_id, doc_id, at = (frame[c].to_numpy()[text] for c in ("no_id", "doc_id", "at"))
    place = at - off
    order = np.lexsort((place, doc_id, no_id))
    same = (np.diff(place[order]) == 0) & (np.diff(doc_id[order]) == 0) & (no_id[order][1:] == no_id[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.r_[0, ~same]) if len(order) else order
    _, back = np.unique(low, return_inverse=True)
    least = np.full(int(back.max()) + 1 if len(back) else 0, len(order), np.int64)
    np.minimum.at(least, back, rank)
    hit = rank > least[back]
    return gathered(frame, text[hit], off[hit], w)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, **options) -> DataFrame:
    """All columns, ``text`` without the repeated words, ``n_words``, ``n_removed`` (long) and ``removed`` (word spans).

    Removed is every word covered by a window of ``length`` words whose sequence also starts earlier: in
    a document with a smaller doc_id (null last), or earlier in the same one. Kept words are joined
    by one blank; a null text stays null, with 0 words. Rows with equal ids count as one document: of
    two equal windows at equal places neither is earlier. Columns named ``n_words``, ``n_removed``
    or ``removed`` give way; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, Windows(length, anchor, words=True, earlier=True), mark_later, **options)
    others = without(docs, ["n_words", "n_removed", "removed"])
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), "doc_id", "text").select("row", identified_columns(), "text")

    def cut(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in frames:
            out = []
            for t, s in zip(texts, found):
                words = t.encode("utf-8").split() if t is not None and t == t else []
                m = merged(np.array([(x["from"], x["to"]) for x in s], np.int64)) if s is not None and len(s) else []
                kept, at = [], 0
                for a, b in m:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8"), [{"from": int(a), "to": int(b)} for a, b in m]))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "t", "removed"])

    made = F.pandas_udf(cut, "n_words long, n_removed long, t string, removed array<struct<from:int,to:int>>")
    done = rows.select("row", "id.*", "text").join(spans, ID, "left").withColumn("v", made("text", "spans"))
    text = F.when(F.col("text").isNotNull(), F.col("v.t"))
    return done.select(F.col("row").withField("text", text).alias("row"), "v.n_words", "v.n_removed", "v.removed").select(
        "row.*", "n_words", "n_removed", "removed")
