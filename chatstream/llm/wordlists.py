"""The most frequent words of a corpus, as a list of bounded length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstream.llm.common import stored

#: Characters of text that a task handles at a time.
SLICE = 1 << 20


def slices(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of positions whose texts have about ``limit`` characters together, or hold one text."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def frequent_words(texts: DataFrame, words: Callable[[str], Iterable[bytes]], limit: int, at_least: int = 1) -> list[tuple[bytes, int]]:
    """Words of the column ``text`` that occur ``at_least`` times, and how often: at most ``limit``, the most frequent first (then in byte order).

    All texts are counted. Of words that occur equally often all are taken or none, so the list does not depend on
    chance; what is left out is for the caller to handle another way.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).to_pylist()
            for start, end in slices(column):
                seen: Counter = Counter()
                for text in column[start:end]:
                    seen.update(words(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    counted = texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted.where(F.col("n") >= at_least), "words")
    # the driver gets one row for each power of 2 ** (1 / 8), then the words within the limit
    step = F.floor(8 * F.log2("n")).cast("int")
    held, lowest = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect(), reverse=True):
        held += r.words
        if held > limit:
            break
        lowest = r.n
    if lowest is None:
        return []
    return [(w, -n) for n, w in sorted((-r.n, bytes(r.word)) for r in counted.where(F.col("n") >= lowest).collect())]
