"""Toxicity: a linear model on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.session import cut

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
SLICE = 4 << 20  # bytes of text looked at together
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Weights of the chosen n-gram buckets and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def _ngram_buckets(data: bytes) -> Iterator[np.ndarray]:
    """Per order, the bucket of the n-gram that starts at each byte (8 zero bytes must end `data`)."""
    n = len(data) - 8
    words = np.ndarray((max(n, 0),), "<u8", data, strides=(1,))
    for order in ORDERS:
        part = (words & np.uint64((1 << 8 * order) - 1)) + np.uint64(order << 58)
        yield ((part * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _slices(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Lower-cased texts packed into slices: bytes, where each stretch starts, whose it is.

    Texts are parted by 8 zero bytes, so no n-gram mixes two; a text longer than a
    slice is cut with an overlap of 7 bytes, so every n-gram is seen whole.
    """
    parts, starts, owners, size = [], [], [], 0
    for i, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        for at in range(0, max(len(data), 1), SLICE):
            piece = data[at : at + SLICE + 7]
            if size and size + len(piece) > SLICE:
                yield b"".join(parts), np.array(starts), np.array(owners)
                parts, starts, owners, size = [], [], [], 0
            parts += [piece, bytes(8)]
            starts.append(size)
            owners.append(i)
            size += len(piece) + 8
    if parts:
        yield b"".join(parts), np.array(starts), np.array(owners)


def _hits(texts: list[str | None], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs of the n-grams whose bucket has a slot."""
    width = int(slot.max()) + 1 if slot.size else 1
    found = []
    for data, starts, owners in _slices(texts):
        full = np.frombuffer(data, np.uint8) != 0
        for order, buckets in zip(ORDERS, _ngram_buckets(data), strict=True):
            got = slot[buckets]
            at = np.flatnonzero(got >= 0)
            at = at[full[at] & full[at + order - 1]]  # inside one text: the gaps hold zeros
            if at.size:
                who = owners[np.searchsorted(starts, at, "right") - 1].astype(np.int64)
                found.append(np.unique(who * width + got[at]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // width, pairs % width


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class that have each bucket, summed over this task."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    all_slots = np.arange(1 << BUCKET_BITS, dtype=np.int32)
    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.iloc[i : i + 64]
            doc, bucket = _hits(part["text"].tolist(), all_slots)
            label = part["toxic"].to_numpy()[doc]
            for c in (0, 1):
                counts[c] += np.bincount(bucket[label == c], minlength=1 << BUCKET_BITS)
    some = np.flatnonzero(counts.sum(0))
    yield pd.DataFrame({"bucket": some, "clean": counts[0, some], "toxic": counts[1, some]})


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps with a fixed step size."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    v, vb = w.copy(), b
    # The largest curvature, by power iteration, sets the step.
    u = np.ones(d, np.float32)
    for _ in range(15):
        u = x.T @ (x @ u)
        u /= max(float(np.linalg.norm(u)), 1e-12)
    step = 1.0 / (0.25 * float(np.linalg.norm(x @ u)) ** 2 + 0.25 * n + l2)
    for k in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30))) - y
        nw, nb = v - step * (x.T @ g + l2 * v), vb - step * float(g.sum())
        push = k / (k + 3)
        v, vb = nw + push * (nw - w), nb + push * (nb - b)
        w, b = nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, features: int = 2048, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit the classifier on about `per_class` labelled documents of each class.

    The sample is drawn by a hash of the id, so it is the same on every run. Over it, a
    bucket's log-count ratio compares the shares of toxic and of clean documents that
    have it. The `features` buckets whose two shares differ most clearly are the inputs,
    each scaled by its ratio; a logistic regression with L2 penalty weighs them. The
    sample, the features and the matrix (documents by features) are bounded by the two
    parameters; the intercept is moved back to the class shares of all labelled rows.

    Null labels and ids are ignored, a repeated label counts once (the larger).
    Without rows of both classes the score is the share of toxic labels, or 0.
    """
    known = cut(
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.0
    flat = Model(np.zeros(0, np.int64), np.zeros(0), _logit(prior))
    if not n0 or not n1:
        return flat
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / n1)).otherwise(min(1.0, per_class / n0))
    # The sample's ids are bounded by the parameter, so they may be broadcast.
    chosen = F.broadcast(known.where(draw < share))
    sample = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id").select("text", "toxic"))
    have = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(have) < 2:
        return flat
    counts = sample.mapInPandas(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    s0, s1 = F.lit(float(have[0])), F.lit(float(have[1]))
    pooled = (F.col("clean") + F.col("toxic") + 1) / (s0 + s1 + 2)
    clear = F.abs(F.col("toxic") / s1 - F.col("clean") / s0) / F.sqrt(pooled * (1 - pooled) * (1 / s0 + 1 / s1))
    best = counts.where(F.col("clean") + F.col("toxic") >= 5).withColumn("clear", clear).orderBy(F.desc("clear"), "bucket").limit(features).toPandas().sort_values("bucket")
    if not len(best):
        return flat
    buckets = best["bucket"].to_numpy()
    ratio = np.log((best["toxic"].to_numpy() + 1.0) / (have[1] + 2)) - np.log((best["clean"].to_numpy() + 1.0) / (have[0] + 2))
    slot = _slots(buckets)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc, hit = _hits(batch["text"].tolist(), slot)
            bits = np.zeros((len(batch), len(buckets)), bool)
            bits[doc, hit] = True
            yield pd.DataFrame({"toxic": batch["toxic"], "bits": [np.packbits(r).tobytes() for r in bits]})

    table = sample.mapInPandas(rows, "toxic int, bits binary").toPandas()
    x = np.unpackbits(np.frombuffer(b"".join(table["bits"]), np.uint8).reshape(len(table), -1), axis=1, count=len(buckets)).astype(np.float32) * ratio.astype(np.float32)
    w, b = _fit(x, table["toxic"].to_numpy().astype(np.float32))
    return Model(buckets, w * ratio, b + _logit(prior) - math.log(have[1] / have[0]))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _slots(buckets: np.ndarray) -> np.ndarray:
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    slot[buckets] = np.arange(len(buckets))
    return slot


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add the probability that a text is toxic; null and empty texts get the bare intercept.

    The whole text counts, whatever its length. A column already named like the result is
    replaced. Other columns pass through.
    """
    frame = docs.drop(out_col)
    names = frame.columns

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slot = _slots(model.buckets)
        for texts in batches:
            total = np.full(len(texts), model.bias)
            for i in range(0, len(texts), 1024):
                doc, hit = _hits(texts.iloc[i : i + 1024].tolist(), slot)
                np.add.at(total, doc + i, model.weights[hit] if len(hit) else 0.0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    rate_udf = F.pandas_udf(rate, "double")
    return frame.select(*names, rate_udf(F.coalesce(F.col(text_col), F.lit(""))).alias(out_col))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
