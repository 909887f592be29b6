"""Chat formatting with Spark expressions only.

Turns are collected in segments of ``SEGMENT`` turn numbers and the segments by
conversation, so a very long conversation meets as few rows, each sorted before.
The sorted turn structs are cut into runs of one role; a run's texts are merged
with array functions into one block

    <s>[ROLE]role[/ROLE]text[SEP]text</s>

and the blocks concatenated. A control string inside a text or a role gets a
backslash before its last bracket (one more if backslashes are there already),
which takes nothing from the text and is undone exactly.

Defined results: null text and null role are empty; null turns sort first, equal
turns by role, then text; repeated rows are turns of their own; rows with a null
conversation form one conversation; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = 64

OPEN, ROLE_OPEN, ROLE_CLOSE, NEXT, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "[SEP]", "</s>"
#: A control string without its last bracket; INST marks are kept out of texts for templates that use them.
_CONTROL = r"(</?s|\[/?ROLE|\[/?INST|\[SEP)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL + r"(\\*)([>\]])", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL + r"\\(\\*)([>\]])", "$1$2$3")


def collected_turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turns): each conversation's sorted (turn, role, text) structs."""
    rows = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    segment = F.floor(F.col("t.turn") / SEGMENT)
    parts = rows.groupBy("conv_id", segment.alias("segment")).agg(F.sort_array(F.collect_list("t")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "part"))).alias("parts"))
    return whole.select("conv_id", F.flatten("parts.part").alias("turns"))


def format_chats(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant"
) -> DataFrame:
    """(conv_id, formatted, pieces) of each conversation.

    ``pieces`` is the loss mask: consecutive parts of ``formatted`` with whether a
    model learns them (whole escaped texts of role ``learn``); together they are
    ``formatted``.
    """
    turns = collected_turns(rows, conv_col, turn_col, role_col, text_col)
    t = F.col("turns")
    starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i)["role"] != F.element_at(t, F.greatest(i - 1, F.lit(1)))["role"]))
    turns = turns.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns") + 1))
    runs = F.transform(F.arrays_zip(F.col("starts").alias("b"), ends.alias("e")), lambda r: F.slice(F.col("turns"), r["b"], r["e"] - r["b"]))
    turns = turns.select("conv_id", runs.alias("runs"))

    def block(run: Column) -> Column:
        role = F.element_at(run, 1)["role"]
        head = F.concat(F.lit(OPEN + ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE))
        told = F.transform(run, lambda x: escape(x["text"]))
        learnt = role == learn
        # learnt texts are pieces of their own; the others are one piece with their marks
        own = F.flatten(F.transform(told, lambda x, i: F.array(_piece(F.when(i == 0, head).otherwise(F.lit(NEXT)), False), _piece(x, True))))
        rest = F.array(_piece(F.concat(head, F.array_join(told, NEXT), F.lit(CLOSE)), False))
        return F.when(learnt, F.concat(own, F.array(_piece(F.lit(CLOSE), False)))).otherwise(rest)

    turns = turns.select("conv_id", F.flatten(F.transform("runs", block)).alias("pieces"))
    return turns.select("conv_id", F.array_join("pieces.text", "").alias("formatted"), "pieces")


def _piece(text: Column, learnt: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(learnt).alias("learnt"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that ``formatted`` was made from, in order."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.split(b, r"\[/ROLE\]", 2)[1], r"\[SEP\]", -1),
                lambda x: F.struct(unescape(F.substring(F.split(b, r"\[/ROLE\]", 2)[0], len(OPEN + ROLE_OPEN) + 1, 2**31 - 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from :func:`format_chats`' output."""
    read = formatted.select("conv_id", "formatted", "pieces", read_turns(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("pieces", lambda p: p["learnt"]), lambda p: unescape(p["text"])), "")
    read = read.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), learnt.alias("learnt"))
    return read.select(
        "conv_id", "n_turns",
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
