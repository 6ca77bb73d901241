"""Phrases whose words keep company, by one count of the longest windows.

Each word opens one window: it and the words that follow it in its piece, ``order`` in all, padded where the piece ends.
Only these windows are counted; a Spark ROLLUP over their columns then sums the shorter ones, as every phrase is the
beginning of exactly the windows that open where it occurs. The total of a language is the number of its words.

The most frequent words have numbers in a bounded dictionary, and a window of such words travels as two numbers, any
other as text. Windows are dealt by their words up to the first that is not common, so that a task has all windows with
such a beginning: what is too rare there to be a candidate gives way to a shorter beginning before the ROLLUP. Common is
a word that makes up a ``COMMON``-th of the words; windows that begin with nothing else are dealt by the last word too,
in 128 parts, and left to the ROLLUP. So no task gets a large share, and none of this changes a count that is asked for.

Null texts are empty, null languages ``und``. Pieces of any length are taken whole; repeated rows count each time. Empty
tables give no rows; columns of other names are ignored. Counts of 10 to the 15 and more would not fit the exact score.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatstream.llm.common import once, stored
from chatstream.llm.ranking import ranked
from chatstream.llm.wordlists import frequent_words, slices

#: Words in the dictionary at most.
DICTIONARY = 1 << 18
MIN_COUNT = 10
#: A phrase goes if a longer candidate that holds it has this share of its occurrences, in percent.
ABSORBED = 50
TOP = 2000

#: A word is common if it is this part of all words or more.
COMMON = 1024
_PARTS = 128

_BREAK = 10
_BYTES = bytes(c + 32 if 65 <= c < 91 else 32 if c == 9 else _BREAK if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_BREAKS = re.compile(rb" *\n[ \n]*")


def _pieces(text: str) -> bytes:
    """Lower case, one space between words, `` \\n `` between pieces."""
    return _BREAKS.sub(b" \n ", text.encode().translate(_BYTES))


def words_of(text: str) -> list[bytes]:
    return [w for w in _pieces(text).split(b" ") if w and w != b"\n"]


class Numbers(dict):
    """The numbers of words: those of the dictionary from 1, further ones as they are met."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(1, len(words) + 1)))
        self.shared = len(words)
        self.digits = np.array(["", *(f"\t{k}" for k in range(1, len(words) + 1))], dtype=object)
        self[b"\n"] = 0
        self.further: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.further.append(word)
        self[word] = number = self.shared + len(self.further)
        return number

    def spelled(self, windows: np.ndarray) -> list[str]:
        """Each row's words with a space between: numbers as tab and digits, other words as they are."""
        words = np.concatenate([self.digits, np.array([w.decode() for w in self.further], dtype=object)])
        texts = words[windows[:, 0]]
        for k in range(1, windows.shape[1]):
            texts = texts + " " + words[windows[:, k]]
        return texts.tolist()

    def lasting(self, windows: np.ndarray) -> np.ndarray:
        """The numbers of shared words, and for further words numbers beyond them that do not depend on what was met before."""
        crcs = np.array([self.shared + 1 + zlib.crc32(w) for w in self.further], dtype=np.int64)
        return np.concatenate([np.arange(self.shared + 1), crcs])[windows]

    def forget(self) -> None:
        for word in self.further:
            del self[word]
        self.further = []


def _windows(numbers: Numbers, texts: list[str], order: int) -> np.ndarray:
    """One row for each word: its number and those that follow in its piece, then zeros."""
    tokens = b" \n ".join([*map(_pieces, texts), b""]).split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, filter(None, tokens)), dtype=np.int64)
    ids = np.concatenate([ids, np.zeros(order, dtype=np.int64)])
    rows = np.stack([ids[k : len(ids) - order + k] for k in range(order)], axis=1)
    rows = rows[rows[:, 0] > 0]
    for k in range(1, order):
        rows[:, k][rows[:, k - 1] == 0] = 0
    return rows


def _bits(order: int) -> int:
    """Of a word's number; all words but one, the part (8 bits) and the number of words (4 bits) share 63."""
    return min(51 // (order - 1), 62 // order, 30)


def _counted(docs: DataFrame, dictionary, key: str, common: int, order: int) -> DataFrame:
    """Windows counted within slices of text: (lang, deal, rest, spelled, n).

    ``deal`` holds the words up to the first that is not common, above them the part (if all but the last are common) and
    above that how many they are; ``rest`` holds the others. A window with a word that has no number is spelled out,
    numbers as tab and digits, and its ``deal`` and ``rest`` only say with which others it is counted.
    """
    bits = _bits(order)

    def joined(words: np.ndarray) -> np.ndarray:
        code = np.zeros(len(words), dtype=np.int64)
        for k in range(words.shape[1]):
            code = (code << bits) | words[:, k]
        return code

    def dealt(words: np.ndarray, last: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``deal``, ``rest`` and how many words are in ``deal``; ``above`` says which words are not common."""
        rare = above[:, :-1]
        found = rare.any(axis=1)
        length = np.where(found, rare.argmax(axis=1) + 1, order - 1)
        deal, rest = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for j in range(1, order):
            at = length == j
            deal[at], rest[at] = joined(words[at, :j]), joined(words[at, j:])
        part = np.where(found, 0, last % _PARTS + 1)
        return deal | ((part | (length << 8)) << (bits * (order - 1))), rest, length

    def rows(lang: str, numbers: Numbers, windows: np.ndarray) -> pa.RecordBatch:
        numbered = (windows <= numbers.shared).all(axis=1)
        known, n = _unique(windows[numbered], bits)
        deal, rest, _ = dealt(known, known[:, -1], known > common)
        others, m = _unique(windows[~numbered], bits)
        lasting = numbers.lasting(others)
        others_deal, others_rest, length = dealt(np.where(others <= numbers.shared, others, 0), lasting[:, -1], others > common)
        # a beginning that holds a word without number has no code; any number of its own below zero will do
        places = np.arange(order - 1)
        unknown = others[:, :-1] > numbers.shared
        others_deal = np.where((unknown & (places < length[:, None])).any(axis=1), _below_zero(lasting[:, :-1] * (places < length[:, None])), others_deal)
        others_rest = np.where(unknown.any(axis=1), _below_zero(lasting[:, :-1]), others_rest >> bits) << bits
        columns = [
            pa.array([lang] * (len(known) + len(others)), pa.string()),
            pa.array(np.concatenate([deal, others_deal])),
            pa.array(np.concatenate([rest, others_rest])),
            pa.concat_arrays([pa.nulls(len(known), pa.string()), pa.array(numbers.spelled(others), pa.string())]),
            pa.array(np.concatenate([n, m]).astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "deal", "rest", "spelled", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = once(key, lambda: Numbers(dictionary.value))
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault("und" if lang is None else lang, []).append(text or "")
            for lang, chosen in texts.items():
                for start, end in slices(chosen):
                    yield rows(lang, numbers, _windows(numbers, chosen[start:end], order))
                    numbers.forget()

    return docs.select("lang", "text").mapInArrow(count, "lang string, deal long, rest long, spelled string, n long")


def _unique(windows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often they occur; by one number for each row where it has the bits."""
    order = windows.shape[1]
    if len(windows) and int(windows.max()) >> bits:
        return np.unique(windows, axis=0, return_counts=True)
    code = np.zeros(len(windows), dtype=np.int64)
    for k in range(order):
        code = (code << bits) | windows[:, k]
    codes, n = np.unique(code, return_counts=True)
    return np.stack([(codes >> (bits * (order - 1 - k))) & ((1 << bits) - 1) for k in range(order)], axis=1), n


def _below_zero(numbers: np.ndarray) -> np.ndarray:
    """A negative number of 38 bits for each row, the same for the same row."""
    mixed = np.zeros(len(numbers), dtype=np.uint64)
    for k in range(numbers.shape[1]):
        mixed = (mixed ^ numbers[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return -1 - (mixed >> np.uint64(26)).astype(np.int64)


def _cut(c: str, bits: int) -> Column:
    return F.shiftleft(F.shiftright(c, bits), bits)


def _without_rare(counted: DataFrame, order: int, min_count: int) -> DataFrame:
    """The same windows, cut before the last word or the one before it where that is too rare for a candidate."""
    bits = _bits(order)
    parts = 0xFF << (bits * (order - 1))
    spelled = F.col("spelled").isNotNull()
    held = F.sum("n").over(Window.partitionBy("lang", "deal", F.shiftright("rest", bits)))
    dealt = F.sum("n").over(Window.partitionBy("lang", "deal"))
    spread = (F.col("deal") >= 0) & (F.col("deal").bitwiseAND(parts) > 0)
    marked = counted.withColumns({"_begins": (held >= min_count) | spread, "_dealt": (dealt >= min_count) | (F.col("deal") >= 0), "_whole": F.col("n") >= min_count})
    all_dealt = F.shiftright("deal", bits * (order - 1) + 8) == order - 1

    def beginning(words: int) -> Column:
        kept = F.slice(F.split("spelled", " "), 1, words)
        return F.concat_ws(" ", F.concat(kept, F.array_repeat(F.lit(""), order - words)))

    # the beginning that a spelled window was dealt by ends with its first word without number
    words = F.split("spelled", " ")
    known = F.expr("cast(greatest(1, array_position(transform(split(spelled, ' '), w -> w <> '' AND NOT startswith(w, '\t')), true)) - 1 AS int)")
    barely = F.concat_ws(" ", F.concat(F.slice(words, F.lit(1), known), F.array_repeat(F.lit(""), F.lit(order) - known)))
    shortened = F.when(F.col("_whole"), F.col("spelled")).when(F.col("_begins"), beginning(order - 1)).when(F.col("_dealt"), beginning(order - 2)).otherwise(barely)
    return marked.select(
        "lang",
        F.when(spelled, F.lit(-1).cast("bigint")).when(spread, F.col("deal").bitwiseAND(~parts)).when(~F.col("_begins") & all_dealt, _cut("deal", bits)).otherwise(F.col("deal")).alias("deal"),
        F.when(spelled, F.lit(0).cast("bigint")).when(F.col("_whole"), F.col("rest")).when(F.col("_begins"), _cut("rest", bits)).otherwise(_cut("rest", min(2 * bits, 63))).alias("rest"),
        F.when(spelled, shortened).alias("spelled"),
        "n",
    ).groupBy("lang", "deal", "rest", "spelled").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, order: int = 3, min_count: int = MIN_COUNT, dictionary_words: int = DICTIONARY) -> DataFrame:
    """lang, phrase, words (how many), n of all phrases of up to ``order`` words (2 to 8) that occur ``min_count`` times.

    The row of no words has the number of all words of the language. All texts are read twice: for the dictionary and
    for the windows.
    """
    spark = docs.sparkSession
    bits = _bits(order)
    frequent = frequent_words(docs, words_of, min(dictionary_words, (1 << bits) - 1), min_count)
    share = sum(n for _, n in frequent)
    common = sum(n * COMMON >= share for _, n in frequent)
    dictionary, key = spark.sparkContext.broadcast([word for word, _ in frequent]), f"numbers-{uuid.uuid4().hex}"
    dealt = _counted(docs, dictionary, key, common, order).repartition("deal")
    counted = _without_rare(dealt.groupBy("lang", "deal", "rest", "spelled").agg(F.sum("n").alias("n")), order, min_count)
    names = [f"w{k}" for k in range(1, order + 1)]
    length, mask = f"cast(shiftright(deal, {bits * (order - 1) + 8}) AS int)", (1 << bits) - 1

    def word(k: int) -> Column:
        in_deal, in_rest = f"shiftright(deal, {bits} * ({length} - {k}))", f"shiftright(rest, {bits * (order - k)})"
        number = F.expr(f"CASE WHEN {k} <= {length} THEN {in_deal} ELSE {in_rest} END & {mask}")
        coded = F.when(number > 0, F.concat(F.lit("\t"), number.cast("string"))).otherwise("")
        return F.when(F.col("spelled").isNull(), coded).otherwise(F.get(F.split("spelled", " "), F.lit(k - 1)))

    windows = counted.select("lang", *(word(k).alias(w) for k, w in enumerate(names, 1)), "n")
    sums = spark.sql(
        f"SELECT lang, {', '.join(names)}, {order} - bit_count(grouping_id()) AS words, sum(n) AS n FROM {{windows}} "
        f"GROUP BY lang, ROLLUP({', '.join(names)}) HAVING words = 0 OR n >= {int(min_count)}",
        windows=windows,
    )
    last = F.get(F.array(*names), F.col("words") - 1)
    found = sums.where((F.col("words") == 0) | (last != ""))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = dictionary.value
        for batch in batches:
            lang, *columns, length, n = batch.columns
            parts = zip(*(c.to_pylist() for c in columns), length.to_pylist())
            phrases = [" ".join(shared[int(w[1:]) - 1].decode() if w[0] == "\t" else w for w in window[:size]) for *window, size in parts]
            yield pa.RecordBatch.from_arrays([lang, pa.array(phrases, pa.string()), length, n], ["lang", "phrase", "words", "n"])

    return found.select("lang", *names, F.col("words").cast("int"), "n").mapInArrow(spell, "lang string, phrase string, words int, n long")


def collocations(docs: DataFrame, order: int = 3, min_count: int = MIN_COUNT, absorbed: int = ABSORBED, top: int = TOP, dictionary_words: int = DICTIONARY) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is a * a / (l * r) in millionths, rounded down, at the cut where it is lowest; a phrase that a longer
    candidate absorbs is left out.
    """
    counts = stored(phrase_counts(docs, order, min_count, dictionary_words), "phrases")
    exact = [F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")]
    candidates = counts.where("words >= 2").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("ws"))
    joined = lambda ws, start, size: F.concat_ws(" ", F.slice(ws, start, size))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined("ws", F.lit(1), F.col("k")).alias("first"), joined("ws", F.col("k") + 1, F.size("ws") - F.col("k")).alias("rest"))
    part = counts.where("words >= 1")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    a, left, right = exact
    cuts = cuts.withColumn("_up", F.lit(1_000_000).cast("decimal(7,0)") * (a * a)).withColumn("_down", left * right).withColumn("score", F.expr("_up div _down"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    longer = candidates.where(F.size("ws") > 2).select("lang", "a", "ws", F.explode(F.sequence(F.lit(2), F.size("ws") - 1)).alias("size"))
    longer = longer.select("lang", "a", "ws", "size", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)).alias("at"))
    held = longer.groupBy("lang", joined("ws", F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    left_over = lowest.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))).drop("longer")
    best = ranked(left_over, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "rank").where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
