"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, neighbouring
turns of one role become a block, and the blocks are concatenated:

    ### user:
    first text<same/>second text</turn>
    ### assistant:
    answer</turn>

Inside roles and texts the control strings are replaced by two-character codes
that start with a backslash, and every backslash by a code of its own, so that
no control string is left there and the codes can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, HEADER_END, SAME, END = "### ", ":\n", "<same/>", "</turn>\n"
#: (control string, code); the backslash comes first when escaping and last when undoing.
CODES = (("\\", "\\e"), ("###", "\\h"), ("</turn>", "\\t"), ("<same/>", "\\s"))


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role_in(code: Column) -> Column:
    return unescape(F.replace(code, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, segments, formatted.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. segments
    is array<struct<text, loss>>: the output cut at the edges of the loss mask,
    which covers the texts of the role ``learn`` and no template. formatted is
    their concatenation.

    Null text or role: empty string. Null turn: before all others. Rows of equal
    turn are ordered by role, then text, and repeated rows are kept. Null
    conv_id: one conversation. No rows: no rows. A conversation is one value of
    the output, so its turns meet in one task; Spark's limit for it is 2 GB.
    """
    clean = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"))
    chats = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    turn = F.col("_turns")
    starts = F.filter(F.sequence(F.lit(1), F.size(turn)), lambda i: (i == 1) | (F.get(turn, i - 1)["role"] != F.get(turn, i - 2)["role"]))
    chats = chats.withColumn("_starts", starts)

    def block(at: Column, k: Column) -> Column:
        until = F.coalesce(F.get(F.col("_starts"), k + 1), F.size(turn) + 1)
        return F.struct(F.get(turn, at - 1)["role"].alias("role"), F.transform(F.slice(turn, at, until - at), lambda t: t["text"]).alias("texts"))

    chats = chats.withColumn("_blocks", F.transform("_starts", block))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(b: Column) -> Column:
        head = F.concat(F.lit(START), _role_out(b["role"]), F.lit(HEADER_END))
        body = F.flatten(F.transform(b["texts"], lambda t, k: F.array(segment(F.when(k == 0, head).otherwise(F.lit(SAME)), F.lit(False)), segment(escape(t), b["role"] == learn))))
        return F.concat(body, F.array(segment(F.lit(END), F.lit(False))))

    chats = chats.select("conv_id", F.flatten(F.transform("_blocks", segments)).alias("segments"))
    return chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.split(formatted, "</turn>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = _role_in(F.substr(head, F.lit(len(START) + 1), F.length(head) - len(START) - 1))
        return F.transform(F.split(F.substr(block, F.length(head) + 2), "<same/>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, without escapes."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digest(chats: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations."""
    read = chats.select("conv_id", read_turns(F.col("formatted")).alias("_turns"), learnt_text(F.col("segments")).alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
