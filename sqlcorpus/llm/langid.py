"""Language ID: averaged embeddings of hashed subwords under a linear softmax.

Trained in numpy by stochastic gradient descent on a bounded sample of labelled rows; scores
are calibrated on part of that sample, and texts that score too low are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sqlcorpus.llm.arrays import encoded, in_slices, lay_out
from sqlcorpus.llm.tables import quoted, small_batches, without

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
SAMPLE_PER_LABEL = 400  # bound on the labelled rows the model is fitted on, per language
STEPS = 640  # of gradient descent, at least
WORD_SIGN = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """``logits`` has the product of embedding and output layer for every bucket."""

    labels: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(buf: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the byte n-gram that starts at each place."""
    n = len(buf) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = np.full(n, order, np.uint32)
    for k in range(order):
        code *= np.uint32(0x01000193)
        code ^= buf[k : k + n]
    code *= np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - 15)


def has_letter(text: str) -> bool:
    """Digits of other kinds, fractions and the like are no letters."""
    return any(sign[0].isalpha() for sign in WORD_SIGN.finditer(text))


def folded(texts: pd.Series) -> list[bytes]:
    return encoded(texts.where(texts.notna(), "").str.lower())


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    return np.unique(np.concatenate([grams(buf, o) for o in ORDERS]), return_counts=True)


def sampled_features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in in_slices(frames, "text"):
        rows = [gram_counts(t) for t in folded(frame["text"])]
        yield pd.DataFrame({
            "lang": frame["lang"].to_numpy(), "place": frame["place"].to_numpy(),
            "buckets": [r[0].astype(np.int32).tobytes() for r in rows], "counts": [r[1].astype(np.float32).tobytes() for r in rows],
        })


def fit(rows: list, dims: int = 16, epochs: int = 8, batch: int = 32, rate: float = 0.5, seed: int = 5) -> Model:
    """``rows``: (lang, buckets, counts). Every fifth row serves calibration only."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    number = {lang: k for k, lang in enumerate(labels)}
    rng = np.random.Generator(np.random.PCG64(seed))
    embedding = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
    output = rng.normal(0, 0.1, (dims, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    data = [(np.asarray(b), np.asarray(c, np.float32) / np.float32(max(1.0, float(np.sum(c)))), number[lang]) for lang, b, c in rows]
    train = [d for k, d in enumerate(data) if k % 5 != 4] or data
    held = [d for k, d in enumerate(data) if k % 5 == 4] or data
    epochs = max(epochs, -(-STEPS * batch // len(train)))  # small samples are seen more often
    steps, total = 0, epochs * -(-len(train) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(train))
        for at in range(0, len(train), batch):
            part = [train[k] for k in order[at : at + batch]]
            buckets = np.concatenate([p[0] for p in part])
            weights = np.concatenate([p[1] for p in part])
            first = np.r_[0, np.cumsum([len(p[0]) for p in part])[:-1]]
            hidden = np.add.reduceat(embedding[buckets] * weights[:, None], first)
            scores = hidden @ output + bias
            probs = np.exp(scores - scores.max(1, keepdims=True))
            probs /= probs.sum(1, keepdims=True)
            probs[np.arange(len(part)), [p[2] for p in part]] -= 1
            step = np.float32(rate * (1 - steps / total))
            back = probs @ output.T
            output -= step * (hidden.T @ probs) / len(part)
            bias -= step * probs.mean(0)
            # the gradient of a mean reaches a bucket by its share of the text, which is tiny: hence the factor
            for (own, share, _), slope in zip(part, back):
                embedding[own] -= step * 20 * share[:, None] * slope
            steps += 1
    logits = embedding @ output
    raw = np.stack([(logits[b] * w[:, None]).sum(0) + bias for b, w, _ in held])
    truth = np.array([d[2] for d in held])
    temperature = min(np.geomspace(0.05, 5, 60), key=lambda t: _loss(raw / t, truth))
    probs = _softmax(raw / temperature)
    right = probs.max(1)[probs.argmax(1) == truth]
    threshold = min(0.5, float(np.quantile(right, 0.001))) if len(right) else 0.0
    return Model(labels, logits.astype(np.float32), bias, float(temperature), threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _loss(x: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log(_softmax(x)[np.arange(len(x)), truth] + 1e-12).mean())


def train(docs: DataFrame, usable: Column, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fits a model on at most about ``per_label`` rows of each language among the ``usable`` ones.

    Rows are drawn by a hash of id and text, so that any run draws the same ones.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(usable).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("place"))
    share = rows.groupBy("lang").agg((F.lit(float(per_label)) / F.count(F.lit(1))).alias("share"))
    counts = {r["lang"]: r["share"] for r in share.collect()}  # one row for each language
    if not counts:
        return fit([])
    drawn = F.lit(False)
    for lang, part in counts.items():
        drawn = drawn | ((F.col("lang") == lang) & (F.pmod("place", F.lit(1 << 20)) < int(min(1.0, part) * (1 << 20))))
    # bytes, not lists: the driver holds the sample in arrays
    found = rows.where(drawn).mapInPandas(
        sampled_features, "lang string, place long, buckets binary, counts binary").limit(2 * per_label * len(counts)).collect()
    found.sort(key=lambda r: (r["place"], r["lang"]))
    return fit([(r["lang"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in found])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns, with ``lang_pred``, ``score`` (calibrated, 0 to 1) and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every
    text if the model knows no language. Columns of the same names give way. Repeated rows are
    judged alike; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    others = without(docs, ["lang_pred", "score", "rejected"])
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), F.col("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        clean = folded(texts)
        buf, starts = lay_out([b" " + t for t in clean])
        sums = np.zeros((len(clean), len(m.labels)), np.float64)
        wide = buf.astype(np.uint32)
        lengths = np.diff(starts)
        count = np.zeros(len(clean))
        for order in ORDERS:
            bucket = grams(wide, order)
            if not len(bucket):
                continue
            valid = np.maximum(lengths - order + 1, 0)
            for k in range(len(m.labels)):
                run = np.zeros(len(bucket) + 1, np.float64)
                np.cumsum(m.logits[:, k][bucket], out=run[1:])
                sums[:, k] += run[np.minimum(starts[:-1] + valid, len(bucket))] - run[np.minimum(starts[:-1], len(bucket))]
            count += valid
        letters = np.array([has_letter(t) if t is not None and t == t else False for t in texts], bool)
        if m.labels:
            probs = _softmax((sums / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
            best, top = probs.argmax(1), probs.max(1)
        else:
            letters[:] = False
            best, top = np.zeros(len(clean), int), np.zeros(len(clean))
        return pd.DataFrame({
            "lang_pred": [m.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters)],
            "score": np.where(letters, np.clip(top, 0, 1), 0.0),
            "rejected": ~letters | (top < m.threshold),
        })

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.concat([score(part["text"]) for part in in_slices(iter([texts.to_frame("text")]), "text")]
                            or [score(texts)], ignore_index=True)

    judge = F.pandas_udf(judged, "lang_pred string, score double, rejected boolean")
    return rows.withColumn("v", judge("text")).select("row.*", "v.*")
