r"""Chat formatting as a relational plan: turn structs are collected, sorted, merged by role and concatenated.

Everything is Spark expressions. A conversation becomes

    <|im_start|>ROLE<|im_sep|>TEXT<|turn|>TEXT<|im_end|>

one block after the other: adjacent turns of one role share a block, with <|turn|> between their texts, so the single
turns can be read back. Control strings inside roles and texts get one more backslash after their first character
("<|" becomes "<\|", "<\|" becomes "<\\|"), which is undone by taking one away; "</s>", "<s>", "[INST]", "[/INST]",
"<<SYS>>" and "<</SYS>>" of other templates are escaped likewise.

A conversation is one result row, so its turns meet in one place; nothing else does. Turns are sorted by turn, role and
text, nulls first, so ties have one order; null roles and texts are empty; rows with a null id form one conversation; repeated
rows all stay; an empty table gives no rows; other columns of the input are not read, whatever their names. The work grows with
n ** 1.5 of a conversation's turns at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunked, cut_from, let, sums_before

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|turn|>", "<|im_end|>"
#: A control string's first character, the backslashes that were put after it, and its rest.
CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def merge_turns(turns: Column) -> Column:
    """Sorted array<struct<turn, role, text>> to array<struct<role, texts>>: adjacent turns of one role together.

    A block starts where the role changes; each start takes the slice up to the next, so the work is linear in the turns.
    """

    def blocks(t: Column, starts: Column) -> Column:
        upto = lambda k: F.coalesce(F.get(starts, k + 1), F.size(t) + 1)
        return F.transform(starts, lambda i, k: F.struct(F.get(t, i - 1)["role"].alias("role"), F.transform(F.slice(t, i, upto(k) - i), lambda x: x["text"]).alias("texts")))

    changed = lambda t, i: (i == 1) | (F.get(t, i - 1)["role"] != F.get(t, F.greatest(i - 2, F.lit(0)))["role"])
    return let(turns, lambda t: let(F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: changed(t, i)), lambda starts: blocks(t, starts)))


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, formatted, loss_mask): loss_mask has the [start, end) code points of each text whose role is in loss_roles."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sorted_ = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    merged = sorted_.select(id_col, merge_turns(F.col("turns")).alias("blocks"))
    safe = merged.select(id_col, F.transform("blocks", lambda b: F.struct(escape(b["role"]).alias("role"), F.transform(b["texts"], escape).alias("texts"), b["role"].isin(*loss_roles).alias("loss"))).alias("blocks"))
    body = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit(SEP), F.array_join(b["texts"], TURN), F.lit(END)))
    flat = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, j: F.struct((F.when(j == 0, F.length(b["role"]) + len(START) + len(SEP)).otherwise(len(TURN))).alias("lead"), F.length(t).alias("size"), F.when(j == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("tail"), b["loss"].alias("loss")))))
    def mask(parts: Column, starts: Column) -> Column:
        places = F.transform(parts, lambda t, i: F.struct((F.get(starts, i) + t["lead"]).cast("int").alias("start"), (F.get(starts, i) + t["lead"] + t["size"]).cast("int").alias("end"), t["loss"].alias("loss")))
        return F.transform(F.filter(places, lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))

    placed = let(flat, lambda parts: let(sums_before(F.transform(parts, lambda t: t["lead"] + t["size"] + t["tail"])), lambda starts: mask(parts, starts)))
    return safe.select(id_col, F.array_join(body, "").alias("formatted"), placed.alias("loss_mask"))


def read_chats(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted, turns, loss_texts) read back: turns as array<struct<role, text>>, and the text under the loss mask."""
    blocks = F.split("formatted", r"<\|im_start\|>")
    blocks = F.slice(blocks, F.lit(2), F.size(blocks))
    parts = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(1), F.length(b) - len(END)), r"<\|im_sep\|>", 2))
    turns = F.flatten(F.transform(parts, lambda p: F.transform(F.split(p[1], r"<\|turn\|>", -1), lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")))))
    loss = let(chunked(F.col("formatted")), lambda chunks: F.transform("loss_mask", lambda s: unescape(cut_from(chunks, s["start"], s["end"]))))
    return formatted.select(id_col, "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def digest(read: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what was read back."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
