"""Near-duplicate groups of documents by MinHash.

Each document's set of word shingles gets 128 minima of universal hash functions. 32 bands of 4 minima are the buckets
in which candidates meet: two documents at a similarity of 0.8 miss each other in all bands with a probability of
5e-8. Candidates are compared by signature, then confirmed on their full sets, and components follow by alternating
large-star and small-star. Documents with equal sets are one node from the start, so copies cost nothing later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstream.llm.common import stored
from chatstream.llm.components import components, linked_components

BANDS, ROWS = 32, 4
#: Bytes of text that are cut into words together, unless one text is longer.
SLICE_BYTES = 1_000_000
#: Standard deviations that a signature's estimate may lie below the threshold before a pair is given up.
SLACK = 4.5


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


#: Parameters of the universal hash functions x -> (a x + b) >> 32.
HASH_A, HASH_B = _odd(BANDS * ROWS, 11), _odd(BANDS * ROWS, 12)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    Words are runs of anything but U+0020 and U+0009 to U+000D, A-Z in lower case. A text with fewer words than a
    shingle has its whole sequence as its only shingle; one without words, or null, has none.
    """
    raw = [(t or "").encode() for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in raw]
    letters = joined.astype(np.uint64)
    letters[(joined >= 65) & (joined <= 90)] += np.uint64(32)
    place = np.arange(len(joined), dtype=np.int64)
    place -= np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(joined)]))))
    with np.errstate(over="ignore"):
        mixed = _mixed((letters + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        mixed[space] = 0
        word = _mixed(np.add.reduceat(mixed, starts) + (stops - starts).astype(np.uint64))
        cut = np.searchsorted(starts, ends)
        out, begin = [], 0
        for end in cut.tolist():
            own, begin = word[begin:end], end
            n = len(own)
            size = min(words, n)
            if not size:
                out.append(np.zeros(0, np.uint64))
                continue
            total = np.full(n - size + 1, size, np.uint64)
            for k in range(size):
                total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + own[k:n - size + 1 + k])
            out.append(np.unique(total))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash function over the set."""
    least = np.full(len(HASH_A), np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 2048):
            block = HASH_A[:, None] * hashes[None, k:k + 2048]
            block += HASH_B[:, None]
            np.minimum(least, block.min(1), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + least.reshape(BANDS, ROWS)[:, k])
    return key.view(np.int64)


def slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Start and texts of slices of a string column, each of about SLICE_BYTES."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start = 0
    while start < len(sizes):
        end, total = start + 1, sizes[start]
        while end < len(sizes) and total + sizes[end] <= SLICE_BYTES:
            total += sizes[end]
            end += 1
        yield start, column.slice(start, end - start).to_pylist()
        start = end


def signatures(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), bands, signature (16 bits of each minimum) for each row."""
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for start, texts in slices(batch.column(1)):
                n, keys, bands, kept = [], [], [], []
                for hashes in shingle_sets(texts, words):
                    n.append(len(hashes))
                    with np.errstate(over="ignore"):
                        keys.append(np.array([len(hashes), hashes.sum(dtype=np.uint64), _mixed(hashes + np.uint64(7)).sum(dtype=np.uint64)], np.uint64).tobytes())
                    least = minima(hashes)
                    bands.append(band_keys(least) if len(hashes) else np.zeros(0, np.int64))
                    kept.append(least.astype(np.uint16).tobytes())
                offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands])))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(bands), pa.int64())), pa.array(kept, pa.binary()),
                ], names=["doc_id", "n_shingles", "set_key", "bands", "signature"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. component_id is the smallest
    doc_id that links reach, kept says that it is the row's own. Texts without words link to nothing. Rows with one
    doc_id are one node that has the links of all of them; a row without a doc_id has no component and is kept. Other
    columns are ignored. An empty table gives an empty result.
    """
    known = stored(signatures(documents, words), "signatures")
    nodes = known.filter("n_shingles > 0 and doc_id is not null")
    sets = stored(nodes.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")), "sets")
    chosen = stored(nodes.join(sets, ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key"]).select("doc_id", "bands", "signature"), "chosen")
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5
    agree = int(np.ceil(least * BANDS * ROWS))

    def similar(x, y) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    def contents(ids: DataFrame) -> DataFrame:
        texts = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
        return full_sets(texts.join(ids, "node", "left_semi"), words)

    several = nodes.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x <> y").select("doc_id")
    node = F.col("doc_id").alias("node")
    found = linked_components(chosen.select(F.explode("bands").alias("bucket"), node), chosen.select(node, "signature"), np.uint16, agree, contents, similar)
    if not (several := stored(several, "several")).isEmpty():  # ids that come with more than one text
        ties = nodes.join(several, "doc_id", "left_semi").join(sets.withColumnRenamed("doc_id", "b"), "set_key").select(F.col("doc_id").alias("a"), "b")
        found = components(ties.union(found))
    root = sets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("root"))
    rows = known.join(stored(root, "roots"), "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """node and content (the whole sorted set as bytes) of each row (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for start, some in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), pa.array([h.tobytes() for h in shingle_sets(some, words)], pa.binary())], names=["node", "content"])

    return texts.select("node", "text").mapInArrow(run, "node long, content binary")
