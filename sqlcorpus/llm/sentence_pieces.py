"""SentencePiece encoding with offsets: normalisation through the compiled character map, then the model's pieces.

The map is a double-array trie; the longest key at each place is replaced, and for every byte of
the normalised text the source byte it came from is kept. Pieces are found in the normalised
text and projected back to byte spans of the original.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from sqlcorpus.llm.arrays import in_slices
from sqlcorpus.llm.tables import quoted, small_batches, without

MARK = "▁"
CACHED = 250_000  # units whose pieces a worker remembers, besides those of the texts at hand
BATCH = 1 << 19  # characters encoded together
SPANS = "ids array<int>, starts array<int>, ends array<int>"


class CharMap:
    """Longest-prefix replacement by a compiled character map (trie size, trie units, replacement texts)."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        if not self.units:
            return None
        node, found = self._child(0), None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def _offset(self, unit: int) -> int:
        return unit >> 10 << (unit >> 6 & 8)

    def _child(self, node: int) -> int:
        return node ^ self._offset(self.units[node])


class Pieces:
    """A piece model, with what its normaliser does and the pieces of the words met so far."""

    def __init__(self, proto: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        spec, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only models that mark blanks, before words, and fall back to bytes are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.chars = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        # if no piece goes on over the start of a word, words are encoded one by one
        apart = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces if p.type == kinds.NORMAL)
        self.unit = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if apart else "(?s).+")
        # the same pieces for text that is normalised already
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, units: set[str]) -> None:
        """Appends the pieces of new units to ``ids``; ``first`` tells where each unit's begin."""
        new = list(units)
        found = self.segmenter.encode(new, num_threads=1)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(f) for f in found])])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte it came from."""
        data = text.encode("utf-8")
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.chars.units and not self.squeeze:
            head = 1 if self.prefix else 0
            width = np.where(np.frombuffer(data, np.uint8) == 0x20, 3, 1)
            source = np.repeat(np.arange(len(data)), width)
            return MARK * head + text.replace(" ", MARK), np.r_[np.zeros(3 * head, np.int64), source, len(data)]
        out, source, at = [], [], 0
        while at < len(data):
            found = self.chars.longest(data, at)
            if found is None:
                step = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                found = (step, data[at : at + step])
            out.append((found[1], at))
            at += found[0]
        end = len(data)
        if self.squeeze:
            while out and out[0][0] in (b" ", b""):
                out.pop(0)
            while out and out[-1][0].strip(b" ") == b"":
                end = out.pop()[1]
            if out and out[-1][0].endswith(b" "):
                out[-1] = (out[-1][0].rstrip(b" "), out[-1][1])
        made = bytearray(MARK.encode() if self.prefix and out else b"")
        source += [out[0][1] if out else 0] * len(made)
        blank = self.squeeze
        for piece, origin in out:
            if self.squeeze and blank:
                piece = piece.lstrip(b" ")
            if not piece:
                continue
            blank = piece.endswith(b" ")
            piece = piece.replace(b" ", MARK.encode())
            made += piece
            source += [origin] * len(piece)
        return made.decode("utf-8", "replace"), np.array([*source, end], np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text ids with begin and end, and first and past-last source byte of each (empty at begin and end)."""
        normal = [self.normalise(t) for t in texts]
        units = [self.unit.findall(norm) for norm, _ in normal]
        needed = {u for us in units for u in us}
        new = needed - self.known.keys()
        if new and len(self.known) + len(new) > CACHED:  # all but what these texts need is forgotten
            self._forget()
            new = needed
        if new:
            self._learn(new)
        out = []
        for us, (_, source) in zip(units, normal):
            number = np.fromiter(map(self.known.__getitem__, us), np.int64, len(us))
            count = self.first[number + 1] - self.first[number]
            shift = np.repeat(self.first[number] - np.cumsum(count) + count, count)
            ids = self.ids[shift + np.arange(len(shift))]
            ends = source[np.r_[0, np.cumsum(self.width[ids]), len(source) - 1]].astype(np.int32)
            starts = np.r_[ends[:1], ends[:-1]]
            out.append((np.r_[self.begin, ids, self.end].astype(np.int32), starts, ends))
        return out


LOADED: dict[bytes, Pieces] = {}


def pieces(proto: bytes) -> Pieces:
    if proto not in LOADED:
        LOADED[proto] = Pieces(proto)
    return LOADED[proto]


# what ``encode`` can add to ids and spans
MORE = {"decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, proto: bytes, more: tuple[str, ...] = ()) -> DataFrame:
    """All columns, with ``ids`` and the byte spans ``starts``, ``ends`` that each id covers in the source text.

    A null or empty text has the begin and end ids alone. Spans follow each other without gaps, so
    they also tell what a replacement or a squeezed blank came from. ``more`` names further columns made of
    the ids in the same pass: ``decoded`` (the text they decode to), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.
    Texts are taken whole; one of n bytes needs about 150 n bytes of a worker's memory. Columns of the same names give
    way; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    names = ["ids", "starts", "ends", *more]
    others = without(docs, names)

    def made(model: Pieces, texts: list[str]) -> dict[str, list]:
        found = model.encode(texts)
        out = {"ids": [f[0] for f in found], "starts": [f[1] for f in found], "ends": [f[2] for f in found]}
        if "decoded" in more or "decoded_sha256" in more:
            out["decoded"] = [model.library.decode(f[0].tolist()) for f in found]
        if "n_tokens" in more:
            out["n_tokens"] = [len(f[0]) for f in found]
        if "ids_sha256" in more:
            out["ids_sha256"] = [hashlib.sha256(f[0].astype("<u4").tobytes()).hexdigest() for f in found]
        if "decoded_sha256" in more:
            out["decoded_sha256"] = [hashlib.sha256(d.encode("utf-8")).hexdigest() for d in out["decoded"]]
        return {name: out[name] for name in names}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = pieces(shared.value)
        for texts in batches:
            parts = [made(model, [t if t is not None and t == t else "" for t in part["text"]])
                     for part in in_slices(iter([texts.to_frame("text")]), "text", BATCH)]
            yield pd.DataFrame({name: [v for part in parts for v in part[name]] for name in names})

    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), F.col("text").alias("text"))
    schema = ", ".join([SPANS, *(f"{name} {MORE[name]}" for name in more)])
    return rows.withColumn("e", F.pandas_udf(run, schema)("text")).select("row.*", "e.*")


def decode(encoded: DataFrame, proto: bytes) -> DataFrame:
    """All columns, with ``text``: what the ids in ``ids`` decode to. Null ids give a null text; a column ``text`` gives way."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        library = pieces(shared.value).library
        for ids in batches:
            yield pd.Series([None if i is None else library.decode(i.tolist()) for i in ids])

    others = [F.col(quoted(c)) for c in without(encoded, ["text"])]
    return encoded.withColumn("text", F.pandas_udf(run, "string")("ids")).select(*others, "text")
