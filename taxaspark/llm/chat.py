"""Chat formatting by prefix-target expansion. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings: a reply stands between <s> and </s>, any other turn between [INST] and [/INST].
REPLY, OTHER = ("<s>", "</s>"), ("[INST]", "[/INST]")
# A control string in a text gets a backslash after its first character, or one more if it has some.
_ESCAPE = r"([<\[])(\\*/?(?:s>|INST\]))"
_UNESCAPE = r"([<\[])\\(\\*/?(?:s>|INST\]))"
_TURN = r"(?s)(?:<s>|\[INST\])(.*?)(?:</s>|\[/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def escape_role(role: Column) -> Column:
    """A role also must not end its line."""
    return escape(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", reply_role: str = "assistant") -> DataFrame:
    """One example per reply: all turns before it as context, and the reply, whose text alone is trainable.

    Columns: ``conv``, target (the reply's place in its conversation, from 1), formatted, loss_start and loss_end
    (code points of the trainable, escaped text in ``formatted``), last (the example that holds the whole
    conversation). Turns after the last reply are nobody's context; so that the output still holds them, such a
    conversation ends with an example without loss (loss_start and loss_end null).

    Turns are put in order of ``turn``, nulls last, equal ones by role and text; equal rows stay separate turns. A
    null text or role is empty, a null conversation id is one conversation, an empty table gives no example. Other
    columns are not read. A conversation is gathered once, which is no more than the row of its last example; the
    examples are cut from it one after the other.
    """
    said = turns.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")
    )
    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_last(), "r", "x")
    is_reply = F.col("r") == reply_role
    head = F.concat(F.when(is_reply, F.lit(REPLY[0])).otherwise(F.lit(OTHER[0])), escape_role(F.col("r")), F.lit("\n"))
    tail = F.when(is_reply, F.lit(REPLY[1])).otherwise(F.lit(OTHER[1]))
    rendered = said.select("c", "t", "r", "x", is_reply.alias("reply"), head.alias("head"), escape(F.col("x")).alias("body"), tail.alias("tail"))
    placed = rendered.select(
        "c", "reply", F.row_number().over(order).alias("place"), F.concat("head", "body", "tail").alias("segment"),
        F.sum(F.length("head") + F.length("body") + F.length("tail")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.length("body").alias("body_chars"), F.length("tail").alias("tail_chars"),
        F.lead(F.lit(True), 1, False).over(order).alias("more"),
    )
    wanted = F.col("reply") | ~F.col("more")
    loss_end = F.when(F.col("reply"), F.col("end") - F.col("tail_chars"))
    target = F.struct("place", "end", (loss_end - F.col("body_chars")).alias("loss_start"), loss_end.alias("loss_end"), (~F.col("more")).alias("last"))
    whole = placed.groupBy("c").agg(
        F.array_sort(F.collect_list(F.struct("place", "segment"))).alias("segments"), F.array_sort(F.collect_list(F.when(wanted, target))).alias("targets")
    )
    whole = whole.select("c", F.array_join(F.col("segments.segment"), "").alias("whole"), F.explode("targets").alias("e"))
    return whole.select(
        F.col("c").alias(conv), F.col("e.place").alias("target"), F.substring(F.col("whole"), F.lit(1), F.col("e.end").cast("int")).alias("formatted"),
        "e.loss_start", "e.loss_end", "e.last",
    )


def trainable_text(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    """The text under the loss mask, unescaped; null without loss."""
    return unescape(F.substring(formatted, (loss_start + 1).cast("int"), (loss_end - loss_start).cast("int")))


def parsed_turns(formatted: Column) -> Column:
    """Formatted text → array of (role, text), unescaped."""

    def read(body: Column) -> Column:
        name = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(name).alias("role"), unescape(F.substring(body, F.length(name) + 2, F.length(body))).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)), read)
