"""Strict decoding of one JSON object into typed fields.

``from_json`` alone is lenient: it takes trailing text and coerces numbers to
strings. The text is therefore parsed inside two different wrappers, which no
trailing text can satisfy at once, and every field is read as a VARIANT so its
JSON type can be tested. Keys match without regard to case and the last
non-null occurrence wins, but each occurrence must have the right type.

The parse results are plain columns, not one struct: the optimizer inlines a
struct into each of its readers and would parse again for every field.

Known gap: a row that has both a case-folded (or repeated) key and an unrelated
field whose nested object repeats a key counts as malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.functions.pinning import pinned

#: Strict grammar; the reader's own limits lie beyond what a frame or a record can hold.
_OPTIONS = {
    "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
    "maxNestingDepth": "10000", "maxNumLen": "2147483647", "maxStringLen": "2147483647",
}
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_ZERO_TIME = "0001-01-01T00:00:00Z"
_FOLDED = "lower(translate({k}, 'ſ', 's'))"

#: Helper columns that ``with_parsed`` adds.
PARSED = ["_listed", "_held", "_null_literal", "_plain"]


def with_parsed(df: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """Add the parse results that the readers below work on.

    ``_plain`` says that every key which folds to one of the fields is spelled
    exactly and occurs once, so the struct decode has the answer.
    """
    v = F.col(text)
    variants = ", ".join(f"{f}: variant" for f in fields)
    texts = ", ".join(f"{f}: string" for f in fields)
    names = ", ".join(f"'{f}'" for f in fields)
    return (
        df.withColumns(
            {
                "_listed": pinned(F.from_json(F.concat(F.lit("["), v, F.lit("]")), f"array<struct<{texts}>>", _OPTIONS)),
                "_held": pinned(F.from_json(F.concat(F.lit('{"p":'), v, F.lit("}")), f"struct<p: struct<{variants}>>", _OPTIONS)),
                "_null_literal": F.btrim(v, F.lit(" \t\r\n")) == "null",
                "_keys": pinned(F.coalesce(F.json_object_keys(v), F.map_keys(F.from_json(v, "map<string, string>", _OPTIONS)), F.array().cast("array<string>"))),
            }
        )
        .withColumn(
            "_plain",
            pinned(
                F.expr(  # the usual row has nothing but known keys and needs no look at each
                    f"CASE WHEN size(_keys) = size(array_intersect(_keys, array({names}))) THEN true "
                    f"ELSE size(filter(_keys, k -> {_FOLDED.format(k='k')} IN ({names}))) = "
                    f"size(array_intersect(_keys, array({names}))) END"
                )
            ),
        )
        .drop("_keys")
    )


def shape_ok() -> Column:
    """One JSON object (or the literal ``null``) and nothing else."""
    return F.coalesce(F.expr("_null_literal OR (size(_listed) = 1 AND _held.p IS NOT NULL)"), F.lit(False))


def _options() -> str:
    return ", ".join(f"'{k}', '{v}'" for k, v in _OPTIONS.items())


def _entries(text: str, field: str) -> str:
    decoded = f"from_json({text}, 'map<string, variant>', map({_options()}))"
    return f"filter(map_entries({decoded}), e -> {_FOLDED.format(k='e.key')} = '{field}')"


def field_types_ok(text: str, field: str, allowed: list[str]) -> Column:
    """Every occurrence of the field is null or has one of the allowed types."""
    types = ", ".join(f"'{t}'" for t in [*allowed, "VOID"])
    return F.expr(
        f"CASE WHEN _plain THEN coalesce(schema_of_variant(_held.p.{field}), 'VOID') IN ({types}) "
        f"ELSE coalesce(forall({_entries(text, field)}, e -> schema_of_variant(e.value) IN ({types})), false) END"
    )


def string_field(text: str, field: str) -> Column:
    """Value of a string field; NULL when absent or JSON null."""
    given = f"filter({_entries(text, field)}, e -> schema_of_variant(e.value) <> 'VOID')"
    return F.expr(
        f"CASE WHEN _plain THEN try_variant_get(_held.p.{field}, '$', 'string') "
        f"ELSE try_variant_get(try_element_at({given}, -1).value, '$', 'string') END"
    )


def uint64_field(text: str, field: str) -> tuple[Column, Column]:
    """(is legal, value): digits only, at most 2^64 - 1; absent or null reads as 0."""
    # VARIANT turns 1.0 into a decimal without its fraction, so the raw text decides.
    raw = (
        f"CASE WHEN _plain THEN get(_listed, 0).{field} "
        f"ELSE try_element_at(filter(map_entries(from_json({text}, 'map<string, string>', map({_options()}))), "
        f"e -> {_FOLDED.format(k='e.key')} = '{field}' AND e.value IS NOT NULL), -1).value END"
    )
    value = f"try_cast(({raw}) AS decimal(20,0))"
    legal = f"({raw}) IS NULL OR (({raw}) RLIKE '^[0-9]+$' AND coalesce({value} <= 18446744073709551615BD, false))"
    types = field_types_ok(text, field, ["BIGINT", "DECIMAL(20,0)", "DECIMAL(19,0)"])
    return F.expr(legal) & types, F.coalesce(F.expr(value), F.lit(0).cast("decimal(20,0)"))


def instant(value: Column) -> Column:
    """Timestamp of an RFC 3339 text, NULL for any other. The usual text ends in Z and is read as it stands."""
    zone = r"([+-])(\d{2}):(\d{2})$"
    hours, minutes = (F.regexp_extract(value, zone, k).try_cast("int") for k in (2, 3))
    local = F.try_to_timestamp(F.regexp_replace(value, zone, "Z"))
    # the session's own reader stops at 18 hours
    ahead = (hours * 60 + minutes).cast("bigint") * F.when(F.regexp_extract(value, zone, 1) == "-", -60_000_000).otherwise(60_000_000)
    elsewhere = F.when((hours < 24) & (minutes < 60), F.timestamp_micros(F.unix_micros(local) - ahead))
    return F.when(value.rlike(_RFC3339), F.when(F.endswith(value, F.lit("Z")), F.try_to_timestamp(value)).otherwise(elsewhere))


def unless_zero(at: Column) -> Column:
    """The year-1 zero of a timestamp that was never set reads as NULL."""
    return F.when(at != F.to_timestamp(F.lit(_ZERO_TIME)), at)
