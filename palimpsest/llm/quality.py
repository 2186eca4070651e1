"""Quality classifier: hashed word n-gram logistic regression.

Words and punctuation runs are hashed, with their shapes and repetitions, as
n-grams of up to three; follow-the-regularised-leader updates fit one weight a
bucket on a bounded sample of labelled rows; a document's score is the sparse
dot product of its n-gram shares with the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.batches import annotate, crc_mod, durable, labelled_sample, labelled_texts, lowered, mix, span_hashes, table, utf8

#: log2 of the buckets; training rows of each label; passes over them.
BITS, SAMPLE_PER_LABEL, EPOCHS = 18, 3_000, 4
#: Bytes of packed n-grams that the sample may have; it ends, in the order of hashes, where they are reached.
SAMPLE_BYTES = 256 << 20
#: Weight of the shares, so that their sum of 1 a family isn't drowned by the regulariser.
SHARE = 8.0
#: Follow-the-regularised-leader: learning rate, its offset, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.2

#: What a byte is part of: 0 white space, 1 word (letters, digits, any byte over 127), 2 punctuation.
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and rows of all n-grams, and how many n-grams each row has."""
    rows = len(offsets) - 1
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    row = np.searchsorted(offsets, starts, side="right") - 1
    token = span_hashes(lowered(data), starts, ends)
    upper, lower = np.concatenate(([0], np.cumsum(_UPPER[data]))), np.concatenate(([0], np.cumsum(_LOWER[data])))
    n_up, n_low, n = upper[ends] - upper[starts], lower[ends] - lower[starts], ends - starts
    punct = kind[starts] == 2
    # Shapes: capitals only, capital first, mixed, plain; punctuation keeps what it says, as its hash.
    shape = np.where(n_up == 0, 1, np.where(n_low == 0, np.where(n > 1, 2, 3), np.where((n_up == 1) & (_UPPER[data[starts]] == 1), 3, 4))).astype(np.uint64)
    shape = np.where(punct, token, shape)
    same = np.zeros(len(token), np.uint64)
    near = np.zeros(len(token), bool)
    if len(token) > 1:
        near[1:] = row[1:] == row[:-1]
        same[1:] = near[1:] & (token[1:] == token[:-1])
    found = [mix(token + np.uint64(1)), mix(shape * np.uint64(2) + same + np.uint64(1 << 40))]
    at = [row, row]
    if len(token) > 2:
        two, three = np.flatnonzero(near), np.flatnonzero(near[2:] & near[1:-1]) + 2
        found += [mix(mix(token[two - 1]) * np.uint64(3) + token[two]), mix(mix(shape[two - 1] * np.uint64(2) + same[two]) * np.uint64(5) + shape[two]), mix(mix(mix(shape[three - 2]) * np.uint64(7) + shape[three - 1]) * np.uint64(9) + shape[three])]
        at += [row[two], row[two], row[three]]
    buckets, at = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(at)
    return buckets, at, np.bincount(at, minlength=rows)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float


def shares(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `buckets` (packed int32) and `shares` (packed float32) of each whole text."""

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        offsets, data = utf8(piece.column(at))
        buckets, row, n = grams(data, offsets)
        keys, counts = np.unique(row.astype(np.int64) << BITS | buckets, return_counts=True)
        cut = np.searchsorted(keys, np.arange(len(n) + 1, dtype=np.int64) << BITS)
        own = (keys & ((1 << BITS) - 1)).astype(np.int32)
        part = (SHARE * counts / np.maximum(n, 1)[keys >> BITS]).astype(np.float32)
        cuts = list(zip(cut[:-1], cut[1:], strict=True))
        return [pa.array([own[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([part[a:b].tobytes() for a, b in cuts], pa.binary())]

    return annotate(df, text, [("buckets", T.BinaryType()), ("shares", T.BinaryType())], compute, ["y", "weight", "h"])


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> QualityModel:
    """Train on at most `per_label` rows of each label, weighted to the labels' true shares.

    The sample has SAMPLE_BYTES of packed n-grams at most, which all reach the
    driver, and one text of each id.  No labelled rows: zero weights, so every
    score is 0.5.
    """
    chosen = labelled_sample(labels, doc_id, label, train, per_label)
    packed = durable(shares(labelled_texts(docs, chosen, doc_id, text)))
    sizes = sorted((r.h, r.n) for r in packed.select("h", (F.octet_length("buckets") + F.octet_length("shares")).alias("n")).collect())
    within = np.cumsum([size for _, size in sizes]) <= SAMPLE_BYTES
    last = max((h for (h, _), some in zip(sizes, within, strict=True) if some), default=sizes[0][0] if sizes else 0)
    examples = sorted(packed.where(F.col("h") <= last).collect(), key=lambda r: (r.h, r.y))
    return learn([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.shares, np.float32).astype(float), r.y, r.weight) for r in examples])


def learn(examples: list[tuple[np.ndarray, np.ndarray, int, float]]) -> QualityModel:
    """Follow-the-regularised-leader over (buckets, shares, label, weight), EPOCHS times in the order given."""
    z, n, w = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = bias_n = 0.0
    total = sum(weight for _, _, _, weight in examples)
    for _ in range(EPOCHS):
        for at, x, y, share in examples:
            weight = share * len(examples) / total
            now = np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
            error = weight * (1 / (1 + np.exp(-np.clip(now @ x + bias, -30, 30))) - y)
            g = error * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * now
            n[at] += g * g
            bias_n += error * error
            bias -= ALPHA * error / (BETA + bias_n**0.5)
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return QualityModel(w.astype(np.float32), bias)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1, higher: better) and predicted (1 from `threshold` up).

    A null or empty text has no n-grams: its score is that of the bias alone.
    Repeated rows score alike; nothing but the text counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        offsets, data = utf8(piece.column(at))
        buckets, row, n = grams(data, offsets)
        dot = np.bincount(row, weights=sent.value.weights[buckets], minlength=len(n)) * SHARE / np.maximum(n, 1)
        p = 1 / (1 + np.exp(-np.clip(dot + sent.value.bias, -30, 30)))
        return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]

    return annotate(docs, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], compute, keep)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    docs = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
    return score(docs, model, keep=["doc_id", "held_out"])
