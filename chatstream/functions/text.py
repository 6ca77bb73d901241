"""String rules. White space and case follow Unicode, not only ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that ``trim_space`` strips.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_space(c: Column) -> Column:
    """Strip every Unicode white-space character from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for NULL, empty and all-white-space text. Stops at the first visible character."""
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def lower_simple(c: Column) -> Column:
    """Lower case one code point at a time (no final-sigma or dotted-i rules)."""
    special = F.contains(c, F.lit("İ")) | F.contains(c, F.lit("Σ"))
    return F.lower(F.when(special, F.translate(c, "İΣ", "iσ")).otherwise(c))


def normalize(c: Column) -> Column:
    return lower_simple(trim_space(c))


def clean_words(words: Column) -> Column:
    """Dictionary array: normalise, drop blanks, keep order and duplicates."""
    return F.filter(F.transform(words, normalize), lambda w: w != "")


def _normalize_py(word: str) -> str:
    return word.strip(WHITE_SPACE).replace("İ", "i").replace("Σ", "σ").lower()


def first_match(content: Column, dictionary: list[str]) -> Column:
    """First dictionary entry, in list order, contained in the normalised content."""
    words = [w for w in map(_normalize_py, dictionary) if w]
    if not words:
        return F.lit(None).cast("string")
    # A cleaned word starts and ends with a visible character, so trimming the
    # content cannot change what it contains.
    # The array of one binds the lower-cased text, so it is made once and not for every word.
    found = F.transform(
        F.array(lower_simple(content)),
        lambda text: F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(0)),
    )
    return F.when(content.isNotNull(), F.get(found, F.lit(0)))
