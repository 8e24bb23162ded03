"""Vectorised work on many texts laid end to end: words, hashes and windows.

Everything here is a small helper for Arrow batches inside tasks. The hash of a stretch is that of its symbols as digits to
a random base modulo the prime 2**61 - 1, so that it is a difference of two prefix sums, and different stretches
of n symbols share one with a chance of n in 2**61, whatever they look like. Words have a simpler hash of their own.
Hashes are mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


PRIME = (1 << 61) - 1
P, LOW31, LOW30 = U(PRIME), U((1 << 31) - 1), U((1 << 30) - 1)
BYTE_VALUES = (random_words(256, 1) & LOW30).astype(np.uint32)  # below 2**30, all different
BASE = 0x0B5A9D3C71E24F86
# a word's hash is the sum of these over its first bytes, by place and byte, and of mixed values over the rest
PLACES = 32
AT_PLACE = random_words(PLACES * 256, 2)
STRETCH = 1 << 17  # bytes whose words are hashed at once


def folded(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values, modulo the prime but up to 7 above it."""
    low = x & P
    low += x >> U(61)
    return low


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo the prime."""
    x = folded(x)
    x -= P * (x >= P)
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of folded values, themselves not folded; in halves of 30 and 31 bits that never overflow."""
    high, low = a >> U(31), a & LOW31
    if b.dtype == np.uint32:  # below 2**30
        high *= b
        low *= b
    else:
        b_high, b_low = b >> U(31), b & LOW31
        top = high * b_high
        top <<= U(1)
        high *= b_low
        high += low * b_high
        low *= b_low
        low = folded(low)
        low += top
    low += high >> U(30)
    high &= LOW30
    high <<= U(31)
    low += high
    return low


class Powers:
    """Powers of the base and of its inverse, kept as long as the longest batch seen so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up, self.down = (
                np.r_[known, reduced(times(known, np.full(1, pow(base, size, PRIME), np.uint64)))]
                for known, base in ((self.up, BASE), (self.down, pow(BASE, -1, PRIME))))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which ``stretch_hash`` takes the hash of any stretch; one longer than ``values`` (at most 2**30)."""
    powers = POWERS.get(len(values) + 1)[0][:-1]
    terms = folded(times(powers, values if values.dtype == np.uint32 else folded(values)))
    high = np.cumsum(terms >> U(31), dtype=np.uint64)
    terms &= LOW31
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    low = out[1:]
    low += high >> U(30)
    high &= LOW30
    high <<= U(31)
    low += high
    out[1:] = folded(low)
    return out


def _hashed(away: np.ndarray, down: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(reduced(times(folded(away), down)) + mix(length))


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _hashed(sums[end] + U(2 * PRIME) - sums[start], POWERS.get(len(sums))[1][start], (end - start).astype(np.uint64))


def all_stretches(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all stretches of one length, by start."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    return _hashed(sums[length:] + U(2 * PRIME) - sums[:n], POWERS.get(len(sums))[1][:n], np.full(1, length, np.uint64))


def word_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each word: a sum over its bytes of values that have nothing to do with each other.

    The bytes are taken in stretches of whole words of about ``STRETCH`` bytes, so that what is held for each byte stays small.
    """
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(last, first[at] + STRETCH, "right")))
        lo, hi = int(first[at]), int(last[end - 1])
        out[at:end] = _hashed_words(buf[lo:hi], first[at:end] - lo, last[at:end] - lo)
        at = end
    return out


def _hashed_words(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    place = np.arange(len(buf), dtype=np.int64)
    start = np.zeros(len(buf), np.int64)
    start[first] = first
    place -= np.maximum.accumulate(start)
    far = np.flatnonzero(place >= PLACES)
    value = AT_PLACE[np.minimum(place, PLACES - 1) * 256 + buf]
    if len(far):
        value[far] = mix(AT_PLACE[buf[far]] + mix(place[far].astype(np.uint64)))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix(sums[last] - sums[first] + mix((last - first).astype(np.uint64)))


def lay_out(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a blank after each, and where each text starts (one more at the end)."""
    texts = list(texts)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b" ".join(texts) + b" " if texts else b"", np.uint8), starts


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last byte of every word in bytes that end with white space."""
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[1:] = ~SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words_of(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends, word hashes, and the first word of each text (one more at the end)."""
    buf, starts = lay_out(texts)
    first, last = word_bounds(buf)
    return buf, first, last, word_hashes(buf, first, last), np.searchsorted(first, starts)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` neighbours, by doubling."""
    if len(keys) < width:
        return keys[:0]
    span, out = 1, keys
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def in_slices(frames: Iterator[pd.DataFrame], column: str, limit: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """The same rows in frames whose texts stay near ``limit`` characters (one long text may exceed it)."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(frame)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield frame.iloc[a:b]


def encoded(column: pd.Series) -> list[bytes]:
    return [t.encode("utf-8") if t is not None and t == t else b"" for t in column]
