"""Importance resampling towards a target distribution, by an automaton over the frequent words.

Features are runs of up to ``order`` words; a feature's bucket is the CRC-32 of its bytes modulo the number of buckets.
The most frequent words make an Aho-Corasick automaton whose keys are words with a delimiter on either side, so it finds
whole words only; each key carries the word's CRC and length. A scan of the text emits these, and as the CRC of a run
follows from the CRCs and lengths of its words, no run is ever spelled out. Words that are not in the automaton, which is
bounded, get their CRC computed on the spot: the result is the same for every size of the dictionary.

Two passes over the documents: the first counts buckets (a vector for each task, summed by Spark), the second scores.
Null texts have no features. A null ``doc_id`` is hashed like an empty one; rows that share an id are drawn like others,
ties between them are open. Long texts are scanned whole. Empty tables give no rows, an empty target gives gains of the
documents' own counts. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstream.llm.common import once, stored
from chatstream.llm.ranking import ranked
from chatstream.llm.wordlists import frequent_words, slices

#: Words in the automaton at most.
DICTIONARY = 1 << 16
BUCKETS = 10_000
ORDER = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"

_WORDS = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


# --- checksums of joined texts


def _byte_table() -> np.ndarray:
    """What one more byte does to a CRC: 256 values by the polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _doublings() -> list[np.ndarray]:
    """For k from 0 to 31 the change that 2 ** k zero bytes make to a CRC, as four tables by byte."""
    table = _byte_table()
    bytes_ = [np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]
    found = [np.stack([(b >> np.uint32(8)) ^ table[b & np.uint32(255)] for b in bytes_])]
    while len(found) < 32:
        found.append(np.stack([_moved(found[-1], row) for row in found[-1]]))
    return found


def _moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def joined_crc(crc: np.ndarray, following: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts put together, from both parts' CRCs and the length of the second parts."""
    crc = crc.astype(np.uint32)
    for k, tables in enumerate(once("crc-doublings", _doublings)):
        has = (length >> k) & 1 == 1
        if not has.any():
            if not (length >> k).any():
                break
            continue
        crc = np.where(has, _moved(tables, crc), crc)
    return crc ^ following.astype(np.uint32)


# --- the automaton


class Dictionary:
    """Whole words to (CRC, length)."""

    def __init__(self, words: list[bytes]):
        import ahocorasick

        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.automaton = ahocorasick.Automaton() if words else None
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", i)
        if words:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of each word."""
        text = b" " + b" ".join(words) + b" "
        gaps = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
        length = np.diff(gaps) - 1
        crc = np.zeros(len(length), dtype=np.uint32)
        known = np.zeros(len(length), dtype=bool)
        if self.automaton is not None:
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
            at = np.searchsorted(gaps, hits[:, 0]) - 1
            crc[at], length[at], known[at] = self.crc[hits[:, 1]], self.length[hits[:, 1]], True
        for i in np.flatnonzero(~known):
            crc[i] = zlib.crc32(words[i])
        return crc, length


def features(dictionary: Dictionary, texts: list[list[bytes]], order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature of these texts of words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if not len(owner):
        return owner, owner
    crc, length = dictionary.scan(list(chain.from_iterable(texts)))
    owners, found, run = [owner], [crc], crc
    space = np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32)
    for m in range(1, order):
        run = joined_crc(run[:-1], joined_crc(space[m:], crc[m:], length[m:]), length[m:] + 1)
        whole = owner[m:] == owner[:-m]
        owners.append(owner[m:][whole])
        found.append(run[whole])
    return np.concatenate(owners), np.concatenate(found).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, words, key: str, order: int, buckets: int) -> list[int]:
    """How many features of all texts are in each bucket; the driver gets one number for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = once(key, lambda: Dictionary(words.value))
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            column = batch.column(0).to_pylist()
            for start, end in slices(column):
                _, found = features(dictionary, [words_of(t or "") for t in column[start:end]], order, buckets)
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for r in sums.collect():
        counts[r.bucket] = r.n
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    s_all, t_all, k = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(corpus, target)]


def noise(doc_id: int | None, seed: str) -> int:
    """A draw from the Gumbel distribution in thousandths, fixed by the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: str = SEED, dictionary_words: int = DICTIONARY) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    spark = docs.sparkSession
    both = docs.select("text").unionByName(target.select("text"))
    words = spark.sparkContext.broadcast([word for word, _ in frequent_words(both, words_of, dictionary_words)])
    key = f"words-{uuid.uuid4().hex}"
    gain = gains(bucket_counts(docs, words, key, order, buckets), bucket_counts(target, words, key, order, buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = once(key, lambda: Dictionary(words.value))
        gain_of = np.array(gain, dtype=np.int64)
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in slices(column):
                texts = [words_of(t or "") for t in column[start:end]]
                owner, found = features(dictionary, texts, order, buckets)
                n_words = np.array([len(t) for t in texts], dtype=np.int64)
                n_features = np.bincount(owner, minlength=len(texts)).astype(np.int64)
                weight = np.zeros(len(texts), dtype=np.int64)
                np.add.at(weight, owner, gain_of[found])
                total = weight + np.array([noise(i, seed) for i in ids[start:end]], dtype=np.int64)
                columns = [pa.array(ids[start:end], pa.int64()), *map(pa.array, (n_words, n_features, weight, total))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: str = SEED, dictionary_words: int = DICTIONARY
) -> DataFrame:
    """Every document with its score, and the rank of those drawn: the highest ``percent`` of those with enough words."""
    rows = stored(scored(docs, target, order, buckets, seed, dictionary_words).withColumn("_fit", F.col("n_words") >= min_words), "scores")
    drawn = rows.where("_fit").count() * percent // 100
    numbered = ranked(rows, ["_fit"], [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "_rank")
    return numbered.select("doc_id", "n_features", "weight", "score", F.when(F.col("_fit") & (F.col("_rank") <= drawn), F.col("_rank")).alias("rank"))
