"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all documents the model may learn from. Weights are learned on a bounded sample of them with
follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties), which leaves most weights at zero; a part of
the sample that the weights never saw sets the temperature of the softmax.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams of 1 to 3 characters.
ORDERS, BITS = 3, 16
#: Documents that the weights and the temperature are fitted on, at most; the sample is by a hash of doc_id.
TRAIN_DOCUMENTS, CALIBRATION_DOCUMENTS = 3000, 1000
#: Distinct n-grams that a training document contributes, at most (those of the largest weight); predictions use all.
TRAIN_FEATURES = 4096
#: Languages that can be learned, at most: the most frequent ones of the sample.
MAX_LANGUAGES = 256
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.002, 3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the n-grams of the lower-cased text, runs of other characters than letters as one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    plain = (points < 128) & ~((points >= 97) & (points <= 122))
    points = np.where(plain, np.uint64(32), points)
    points = points[np.concatenate(([True], ~(plain[1:] & plain[:-1])))]
    found = []
    with np.errstate(over="ignore"):
        value = np.zeros(len(points), np.uint64)
        for n in range(1, ORDERS + 1):
            value = (value[:len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1:] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append(value >> np.uint64(64 - BITS))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << BITS)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of unit length: (1 + log count) times inverse document frequency."""
    buckets, counts = ngram_counts(text)
    values = (1 + np.log(counts)) * idf[buckets]
    norm = np.sqrt((values**2).sum())
    return buckets, values / norm if norm else values


def learnable(documents: DataFrame) -> DataFrame:
    """Rows with text and lang whose doc_id is not held out."""
    return documents.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_frequencies(documents: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, by bucket, of those that have it. Tasks send one sum per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                buckets, _ = ngram_counts(value.as_py())
                total[buckets] += 1
                n += 1
        total[-1] = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for bucket, n in documents.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return int(out[-1]), out[:-1]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def scores(self, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self.weights[:, buckets] @ values + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its calibrated probability; UNKNOWN and 0 without text, letters or learned languages."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        shares = softmax(self.scores(*features(text, self.idf)) / self.temperature)
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = ALPHA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal over the rows (buckets, values, class); the bias is not penalised."""
    size = (1 << BITS) + 1
    z, n = np.zeros((classes, size)), np.zeros((classes, size))
    order = np.random.default_rng(31)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[:, at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - np.where(at == size - 1, 0, l1), 0)
        return -shrunk / ((BETA + np.sqrt(n[:, at])) / alpha + l2)

    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            buckets, values, label = rows[k]
            at, x = np.append(buckets, size - 1), np.append(values, 1.0)
            w = weights(at)
            error = softmax(w @ x)
            error[label] -= 1
            g = error[:, None] * x
            before = n[:, at]
            after = before + g * g
            z[:, at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[:, at] = after
    w = weights(np.arange(size))
    return w[:, :-1], w[:, -1]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        return float(-np.log(softmax(scores / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(documents: DataFrame) -> Model:
    """A model of the learnable rows. Without any, it knows no language."""
    known = learnable(documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    total, frequency = document_frequencies(known)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    if not total:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros(0), idf)
    wanted = TRAIN_DOCUMENTS + CALIBRATION_DOCUMENTS
    # about twice as many by hash, then exactly the first: no sort over all documents
    share = min(1.0, 2 * (wanted + 100) / total)
    place = F.xxhash64(F.lit("sample"), "doc_id")
    sample = known.withColumn("place", place).filter(F.col("place") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).repartition(16, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for place, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buckets, values = features(text, idf)
                if len(buckets) > TRAIN_FEATURES:
                    top = np.sort(np.argpartition(values, -TRAIN_FEATURES)[-TRAIN_FEATURES:])
                    buckets, values = buckets[top], values[top]
                out.append((place, lang, buckets.astype(np.uint16).tobytes(), values.astype(np.float32).tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["place", "lang", "buckets", "values"])

    taken = sample.select("place", "text", "lang").mapInArrow(run, "place long, lang string, buckets binary, values binary").orderBy("place", "lang", "buckets").limit(wanted).collect()
    by_count: dict[str, int] = {}
    for r in taken:
        by_count[r.lang] = by_count.get(r.lang, 0) + 1
    languages = sorted(sorted(by_count, key=lambda k: (-by_count[k], k))[:MAX_LANGUAGES])
    number = {k: i for i, k in enumerate(languages)}
    rows = [(np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(np.float64), number[r.lang]) for r in taken if r.lang in number]
    cut = max(1, len(rows) * TRAIN_DOCUMENTS // wanted)
    weights, bias = follow_leader(rows[:cut], len(languages))
    model = Model(languages, weights.astype(np.float32), bias, idf)
    if rows[cut:]:
        model.temperature = temperature(np.array([model.scores(b, v) for b, v, _ in rows[cut:]]), np.array([k for _, _, k in rows[cut:]]))
    return model


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, from its whole text only.

    Null texts and texts without a letter are UNKNOWN with score 0. Rows are returned as often as they come; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
