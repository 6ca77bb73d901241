"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts and benchmark items become templates: numbers, units after numbers and names (words with a capital inside a sentence, not all capitals)
are typed placeholders, everything else lower-case words. Windows of the templates are hash-joined. Each hit gives a
shift between a document and an item; along it the templates are compared word by word (any word fills the slot of a
name), and what stands in the slots must map one to one from the item's values to the document's. A question whose numbers and names were exchanged is
found, two that share a phrase are not.

What is mostly placeholders tells nothing as a template. Such windows are looked up by their names or, if it is the
numbers, by all their words as they stand; items that are mostly placeholders or of a few words must also agree word for
word along the shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.functions.pinning import pinned
from chatstream.llm.common import stored, text_or_empty

#: Words in a window; every window of a document is looked up among all windows of the items, so an unbroken run of
#: WINDOW template words is always met.
WINDOW = 8
#: Share of the words of a window, and of an item, that must not be placeholders; others are looked up word for word.
LITERAL = 0.5
#: Share of an item's template that a document must hold.
CONTAINED = 0.8
#: Items shorter than this are found word for word only; shorter ones than a window are looked up at their own length.
LEAST_WORDS = 4
#: Benchmark windows that may be broadcast, about 24 bytes each; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000

NUMBER, NAME, UNIT = "﷕", "﷖", "﷔"
# fixed values: units of measure and money
UNITS = "mm cm dm m km inch inches ft feet foot yard yards mile miles mg g kg t lb lbs oz ml cl l litre litres liter liters gallon gallons ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degrees celsius fahrenheit kmh mph hz khz mhz ghz w kw kwh v a ohm j kj cal kcal pa bar usd eur gbp dollar dollars euro euros pound pounds cent cents".split()


def with_words(rows: DataFrame, text: Column) -> DataFrame:
    """Adds arrays of as many words each: ``said``, lower-case words (marks inside numbers are NUMBER), ``typed``, their
    template with names, numbers and units replaced, and ``plain``, the template of the text in lower case, without names.

    Each step is a pinned column: as one expression, every step would be done again wherever the next ones need it.
    """
    x, named = F.col("_x"), F.col("_n").contains(NAME)
    numbers = lambda words: F.when(F.col("_digits"), F.regexp_replace(F.regexp_replace(words, r"(?<![^ ])[0-9][^ ]*", NUMBER), f"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?= |$)", UNIT)).otherwise(words)
    steps = [
        ("_x", F.when(text.rlike(f"[{NUMBER}{NAME}{UNIT}]"), F.translate(text, NUMBER + NAME + UNIT, "   ")).otherwise(text)),
        ("_x", F.regexp_replace(x, r"(?<=[^.!?:;\s\"]\x20)(?=\p{Lu}\p{Ll})", NAME)),
        ("_digits", x.rlike("[0-9]")),
        ("_x", F.when(F.col("_digits"), F.regexp_replace(F.regexp_replace(x, r"(?<=[0-9])[.,:/'](?=[0-9])", NUMBER), r"(?<=[0-9])(?=\p{L})", " ")).otherwise(x)),
        ("_n", F.trim(F.lower(F.regexp_replace(x, rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}{NAME}]+", " ")))),
        ("_x", F.when(named, F.regexp_replace("_n", f"{NAME}[^ ]+", NAME)).otherwise(F.col("_n"))),
        ("typed", split(numbers(x))),
        ("_n", F.when(named, F.translate("_n", NAME, "")).otherwise(F.col("_n"))),
        ("said", split(F.col("_n"))),
        ("plain", F.when(F.array_contains("typed", NAME), split(numbers(F.col("_n")))).otherwise(F.col("typed"))),
    ]
    for name, step in steps:
        rows = rows.withColumn(name, pinned(step))
    return rows.drop("_x", "_n", "_digits")


def split(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _window(words: Column, i: Column, size: int) -> Column:
    """The window at a position. A unit that begins it stands as it was said: what makes it one is not in the window."""
    return F.when(F.get(words, i) == UNIT, F.concat(F.slice("said", i + 1, F.lit(1)), F.slice(words, i + 2, F.lit(size - 1)) if size > 1 else F.array().cast("array<string>"))).otherwise(F.slice(words, i + 1, F.lit(size)))


def _exactly(i: Column, size: int) -> Column:
    return F.xxhash64(F.lit("said"), F.slice("said", i + 1, F.lit(size)))


def _windows(size: int) -> Column:
    """(position, hash) of a document's windows at every position: typed, plain where that differs, as said where numbers are."""
    at = F.sequence(F.lit(0), F.size("typed") - size)
    entry = lambda i, h: F.struct(i.alias("at"), h.alias("hash"))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    having = lambda words, mark: F.filter(at, lambda i: F.array_contains(F.slice(words, i + 1, F.lit(size)), mark))
    typed = F.transform(at, lambda i: entry(i, F.xxhash64(_window(F.col("typed"), i, size))))
    plain = F.when(F.array_contains("typed", NAME), F.transform(having("typed", NAME), lambda i: entry(i, F.xxhash64(_window(F.col("plain"), i, size))))).otherwise(none)
    said = F.when(F.array_contains("plain", NUMBER), F.transform(having("plain", NUMBER), lambda i: entry(i, _exactly(i, size)))).otherwise(none)
    return F.when(F.size("typed") >= size, F.concat(typed, plain, said))


def _item_windows(size: int) -> Column:
    """(position, hash) of an item's windows: by the templates that tell it, by its words where no template does."""
    telling = lambda words: _slots(words) <= (1 - LITERAL) * size

    def both(i: Column) -> Column:
        typed, plain = _window(F.col("typed"), i, size), _window(F.col("plain"), i, size)
        return F.array(F.when(telling(typed) & ~F.col("exact"), F.xxhash64(typed)), F.when(telling(plain), F.xxhash64(plain)).otherwise(_exactly(i, size)))

    at = F.sequence(F.lit(0), F.size("typed") - size)
    return F.flatten(F.transform(at, lambda i: F.transform(both(i), lambda h: F.struct(i.alias("at"), h.alias("hash")))))


def _slots(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(NUMBER, NAME, UNIT)))


def prepared(benchmark: DataFrame) -> DataFrame:
    """item_id, said, typed, plain and exact (to be found word for word only) of the items that have words."""
    rows = with_words(benchmark.select("item_id", text_or_empty("text").alias("text")), F.col("text")).drop("text").filter(F.size("typed") > 0)
    return rows.withColumn("exact", (F.size("typed") < LEAST_WORDS) | (_slots(F.col("typed")) > (1 - LITERAL) * F.size("typed")))


def contaminations(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and share for every item that a document contains.

    share is the part of the item's template words found along shifts whose slots are consistent. Null and empty texts
    contain nothing; rows without a doc_id are not looked at. Repeated rows give one row; equal items one row each.
    """
    items = stored(prepared(benchmark).distinct(), "items")
    length = F.least(F.size("typed"), F.lit(WINDOW))
    sizes = [r[0] for r in items.select(length.alias("n")).distinct().collect()]  # at most WINDOW numbers
    texts = documents.select("doc_id", text_or_empty("text").alias("text"))
    asked_of = with_words(texts.filter("doc_id is not null"), F.col("text")).drop("text")
    found = None
    for size in sorted(sizes):
        known = items.filter(length == size).select("item_id", F.explode(_item_windows(size)).alias("w")).filter("w.hash is not null")
        known = stored(known.select("item_id", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash")).distinct(), "windows")
        if known.count() <= BROADCAST_WINDOWS:
            known = F.broadcast(known)
        asked = asked_of.select("doc_id", F.explode(_windows(size)).alias("w")).select("doc_id", F.col("w.at").alias("at"), F.col("w.hash").alias("hash"))
        hits = asked.join(known, "hash").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        found = hits if found is None else found.union(hits)
    if found is None:
        return documents.limit(0).select("doc_id").join(benchmark.limit(0).select("item_id")).withColumn("share", F.lit(0.0))
    found = stored(found.distinct(), "shifts")
    wanted = stored(found.select("doc_id").distinct(), "wanted")
    rows = with_words(texts.join(wanted, "doc_id", "left_semi"), F.col("text")).select("doc_id", F.col("typed").alias("words"), F.col("said").alias("theirs"))
    pairs = rows.join(found, "doc_id").join(items.select("item_id", "exact", F.col("typed").alias("item"), F.col("said").alias("mine")), "item_id")

    def agrees(i: Column) -> Column:
        there = i + F.col("shift")
        alike = (F.get("words", there) == F.get("item", i)) | ((F.get("item", i) == NAME) & F.get("words", there).isNotNull())
        return (F.get("theirs", there) == F.get("mine", i)) | (~F.col("exact") & alike)

    pairs = pairs.withColumn("places", pinned(F.filter(F.sequence(F.lit(0), F.size("item") - 1), agrees)))
    slots = F.filter("places", lambda i: F.get("item", i).isin(NUMBER, NAME, UNIT))
    held = F.array_distinct(F.transform(slots, lambda i: F.struct(F.get("mine", i).alias("mine"), F.get("theirs", i + F.col("shift")).alias("theirs"))))
    pairs = pairs.select("doc_id", "item_id", F.size("item").alias("length"), "places", pinned(held).alias("held"))
    distinct = lambda name: F.size(F.array_distinct(F.transform("held", lambda h: h[name])))
    consistent = pairs.filter((distinct("mine") == F.size("held")) & (distinct("theirs") == F.size("held")))
    each = consistent.select("doc_id", "item_id", "length", F.explode("places").alias("place")).groupBy("doc_id", "item_id").agg((F.count_distinct("place") / F.first("length")).alias("share"))
    return each.filter(F.col("share") >= CONTAINED)


def marked(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated and item_ids (ascending) of each row; a row without a doc_id is not contaminated."""
    found = contaminations(documents, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = documents.select("doc_id").join(stored(found, "contaminated"), "doc_id", "left")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, all columns as they are."""
    found = stored(contaminations(documents, benchmark).select("doc_id").distinct(), "contaminated")
    return documents.join(found, "doc_id", "left_anti").select(*documents.columns)
