"""Chat formatting by prefix-target expansion.

A conversation is written once, turn after turn, as ``<turn>role\\ntext</turn>\\n``. ``&`` and ``<`` inside roles and
texts become ``&amp;`` and ``&lt;`` (and a line feed in a role ``&#10;``), so no text can hold a mark of the template,
and undoing it gives every character back. Every assistant turn becomes one example: its context is the formatted text
before the reply, its target the reply, the only trainable part. Examples point into the formatted conversation by code
point offsets, so that a conversation of n turns needs n examples and one text instead of n growing copies;
``with_texts`` copies contexts out for those who want them.

Only DataFrame functions are used. Rows are ordered by (turn, role, text), nulls first; repeated rows are turns of their
own. Null roles and texts are empty. Rows with a null conv_id form one conversation. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def format_conversations(conversations: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, targets (array of start and end, in code points, by turn)."""
    rows = conversations.select(
        "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", F.char_length(head)).withColumn("piece", F.concat(head, escape(F.col("text")), F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    end = F.sum(F.char_length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    turn = F.struct(F.row_number().over(order).alias("at"), "piece", (end - F.char_length("piece") + F.col("head")).alias("start"), (end - F.lit(len(CLOSE))).alias("end"), (F.col("role") == trainable_role).alias("trained"))
    turns = F.array_sort(F.collect_list("t"))
    return rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("targets"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (its number), context_end and target_end in the formatted text.

    The context is everything before context_end, the loss mask covers context_end to target_end.
    """
    return formatted.select("conv_id", F.posexplode("targets").alias("example", "t")).select(
        "conv_id", "example", F.col("t.start").alias("context_end"), F.col("t.end").alias("target_end"))


def with_texts(formatted: DataFrame) -> DataFrame:
    """The examples with their context and target copied out, still escaped."""
    return formatted.select("conv_id", "formatted", F.posexplode("targets").alias("example", "t")).select(
        "conv_id", "example",
        F.expr("substring(formatted, 1, cast(t.start as int))").alias("context"),
        F.expr("substring(formatted, cast(t.start as int) + 1, cast(t.end - t.start as int))").alias("target"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and turns (role and text as they were before formatting), from the output."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    turns = F.transform(body, lambda b: F.struct(
        _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substr(b, F.char_length(F.substring_index(b, "\n", 1)) + 2)).alias("text")))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))


def formatted_digest(conversations: DataFrame) -> DataFrame:
    """Per conversation what the formatted output and its examples hold: turns, targets under the loss mask, length.

    Turns are read back from the formatted text, the loss text is put together from the targets of the examples. Both
    become digests where they are made, so nothing but digests is brought together.
    """
    formatted = format_conversations(conversations)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns = read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    target = F.struct("example", unescape(F.col("target")).alias("text"))
    trained = with_texts(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(target)).alias("trained"))
    loss = F.array_join(F.transform("trained", lambda t: t["text"]), "")
    targets = trained.select("conv_id", F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"))
    both = turns.unionByName(targets, allowMissingColumns=True).groupBy("conv_id")
    return both.agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.coalesce(F.max("loss_chars"), F.lit(0)).alias("loss_chars"), F.coalesce(F.max("loss_sha256"), F.sha2(F.lit(""), 256)).alias("loss_sha256"),
        F.max("formatted_chars").alias("formatted_chars"))
