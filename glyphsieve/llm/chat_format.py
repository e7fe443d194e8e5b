"""Chat formatting with Spark expressions only.

    <|im_start|>role LF text <|im_sep|> text <|im_end|> LF ...

Adjacent turns of one role share a block; <|im_sep|> keeps their border, so the turns can be read back.  Inside
texts and roles a backslash is doubled and <| becomes <\\|, so no marker can come from a text; in roles a line
feed becomes \\n.  Every expression is linear in the length of a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)  # at doubled backslashes; what is left holds single ones only
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask.

    mask has an entry per turn in order, (lead, chars, loss): so many code points of markup, then so many of
    escaped text, and whether that text is trained on.  After the last turn only its end marker follows.
    Defined cases: turns sort by turn, ties by role and text, null turns first; null text or role counts as
    empty; a row with a null conversation is a conversation of its own, so such rows never meet in one task;
    repeated rows are turns of their own; an empty table gives no rows.  Other columns are not read.  A conversation
    is one string, so it must fit in a row.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select(F.col(conv_col).alias("conv_id"), F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("own"), turn.alias("t"))
    sorted_ = keyed.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    begins = lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])
    sorted_ = sorted_.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), begins))

    def run(start: Column, i: Column) -> Column:
        """Adjacent turns of one role as one struct: its role, its texts in order."""
        some = F.slice("turns", start + 1, F.coalesce(F.get("starts", i + 1), F.size("turns")) - start)
        role = F.get("turns", start)["role"]
        return F.struct(_escape_role(role).alias("role"), (role == loss_role).alias("loss"), F.transform(some, lambda t: escape(t["text"])).alias("texts"))

    runs = sorted_.select("conv_id", F.transform("starts", run).alias("runs"))
    block = lambda r: F.concat(F.lit(START), r["role"], F.lit("\n"), F.array_join(r["texts"], SEP), F.lit(END + "\n"))
    formatted = F.array_join(F.transform("runs", block), "")

    def entries(r: Column, i: Column) -> Column:
        opened = F.when(i == 0, F.lit(0)).otherwise(len(END) + 1) + len(START) + F.length(r["role"]) + 1
        return F.transform(r["texts"], lambda x, j: F.struct(F.when(j == 0, opened).otherwise(len(SEP)).cast("long").alias("lead"), F.length(x).cast("long").alias("chars"), r["loss"].alias("loss")))

    return runs.select("conv_id", formatted.alias("formatted"), F.flatten(F.transform("runs", entries)).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, mask -> conv_id, formatted, turns (role, text, loss), parsed from the formatted string.

    The mask must tell the same lengths as the text, turn by turn; otherwise the row raises an error.
    """
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.size(F.split("formatted", r"<\|im_start\|>")))
    blocks = F.transform(blocks, lambda b: F.regexp_replace(b, r"<\|im_end\|>\n\z", ""))

    def turns(block: Column) -> Column:
        role = _unescape_role(F.substring_index(block, "\n", 1))
        body = F.regexp_replace(block, r"\A[^\n]*\n", "")
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), t.alias("raw")))

    raw = formatted.select("conv_id", "formatted", "mask", F.flatten(F.transform(blocks, turns)).alias("raw"))
    same = (F.size("raw") == F.size("mask")) & F.forall(F.arrays_zip("raw", "mask"), lambda z: F.length(z["raw"]["raw"]) == z["mask"]["chars"])
    out = F.transform(F.arrays_zip("raw", "mask"), lambda z: F.struct(z["raw"]["role"].alias("role"), unescape(z["raw"]["raw"]).alias("text"), z["mask"]["loss"].alias("loss")))
    return raw.select("conv_id", "formatted", F.when(same, out).otherwise(F.raise_error(F.lit("the mask does not fit the text"))).alias("turns"))
