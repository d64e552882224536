"""Operator 8, chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation's turns are gathered in order (they are one document, so the group is as large as what must be written in one
piece anyway), every assistant turn becomes an example of its own, with all turns before it as context and its reply alone trainable.
Turns after the last reply, or all turns where there is none, form an example without a trainable part, so that nothing is lost.
Sizes follow from the method: a conversation of n replies writes its first turns n times.

The template of a turn is ``<|turn|>role`` line end, text, ``<|end|>`` line end. In a text, ``<`` and ``[`` become ``\\l`` and ``\\i`` where a control string
starts, and each backslash ``\\b``; in a role a line end is ``\\n`` besides. Replacing these back in the order l, i, n, b gives the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

TURN, END = "<|turn|>", "<|end|>\n"
#: What starts a control string: <| <s> </s> << [INST] [/INST]
_ANGLE, _SQUARE = r"<(?=\||/?s>|<)", r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(F.regexp_replace(t, _ANGLE, r"\\l"), _SQUARE, r"\\i")


def unescape(text: Column) -> Column:
    for mark, plain in (("\\l", "<"), ("\\i", "["), ("\\b", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable_role: str = "assistant") -> DataFrame:
    """One row for each example: conv_id, example (from 0), formatted, loss_start, loss_chars (code points of ``formatted``; 0 if nothing is trainable).

    A null role or text is empty. Turns of one number follow in order of role and text; a repeated row is a turn again; a null number comes first. Rows without
    conversation id form one conversation. Further columns are left out; an empty table gives no rows.
    """
    t = only(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = t.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    head = lambda x: F.concat(F.lit(TURN), _escape_role(x["role"]), F.lit("\n"))
    marked = conv.select("conv_id", F.transform("t", lambda x: F.struct(head(x).alias("head"), escape(x["text"]).alias("body"), (x["role"] == trainable_role).alias("train"))).alias("t"))
    ends = F.filter(F.transform("t", lambda x, i: F.when(x["train"] | (i == F.size("t") - 1), i + 1)), lambda i: i.isNotNull())
    each = marked.select("conv_id", "t", F.posexplode(ends).alias("example", "end"))
    whole = lambda x: F.concat(x["head"], x["body"], F.lit(END))
    last = F.element_at("t", F.col("end"))
    parts = each.select("conv_id", "example", F.array_join(F.transform(F.slice("t", 1, F.col("end") - 1), whole), "").alias("context"), last.alias("last"))
    start = F.length("context") + F.length("last.head")
    return parts.select("conv_id", F.col("example").cast("long").alias("example"), F.concat("context", whole(F.col("last"))).alias("formatted"), F.when(F.col("last.train"), start).otherwise(0).cast("long").alias("loss_start"), F.when(F.col("last.train"), F.length("last.body")).otherwise(0).cast("long").alias("loss_chars"))


def read_chats(examples: DataFrame) -> DataFrame:
    """Conversations read back from examples: conv_id, turns (role and text, in order), loss_text (trainable texts in order), formatted_chars (of all examples)."""
    loss = F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))
    conv = examples.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted"))["formatted"].alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    # every turn starts with TURN and ends with END, neither of which an escaped text holds
    pieces = F.transform(F.slice(F.split("longest", r"<\|end\|>\n", -1), 1, F.size(F.split("longest", r"<\|end\|>\n", -1)) - 1), lambda x: F.substring(x, len(TURN) + 1, 2**31 - 1))
    parsed = F.transform(pieces, lambda x: F.struct(_unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.regexp_replace(x, r"\A[^\n]*\n", "")).alias("text")))
    return conv.select("conv_id", parsed.alias("turns"), F.array_join(F.transform("losses", lambda x: unescape(x["loss"])), "").alias("loss_text"), "formatted_chars")
