"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only the
text of that reply is trainable. A turn is written as ``### Role: text</turn>`` and a line break.
Control strings inside texts are escaped by one more backslash (``###`` before a role name becomes
``#\\##``, ``</turn>`` becomes ``<\\/turn>``; strings that already hold such backslashes get one more),
so a text can be read back exactly and never opens or closes a turn. Roles other than the four named
ones are written as ``=role`` with ``\\``, ``:`` and ``<`` escaped; a null role is ``?``.

The expansion is quadratic in the turns of one conversation, by its definition; its rows come one by
one from the conversation's text, which is built once. A conversation is one string, so it is limited
by what a string holds (2 GB) and goes to one task; that is no cap on turns.

Turns are ordered by `turn` (null first), ties by role, then by the written text; repeated rows stay.
A null text is empty. Rows without conv_id form one conversation. A conversation that does not end
with a reply has one last row that trains nothing, so that no turn is lost; an empty table gives no
rows. Other columns of the input are not read; their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
END = "</turn>\n"
MARKED = "(System|User|Assistant|Tool|=|\\?)"


def guarded(text: Column) -> Column:
    """`text` with its control strings escaped."""
    heads = F.regexp_replace(text, rf"#(\\*)## {MARKED}", r"#\\$1## $2")
    return F.regexp_replace(heads, r"<(\\*)/turn>", r"<\\$1/turn>")


def unguarded(text: Column) -> Column:
    ends = F.regexp_replace(text, r"<\\(\\*)/turn>", r"<$1/turn>")
    return F.regexp_replace(ends, rf"#\\(\\*)## {MARKED}", "#$1## $2")


def _swap(value: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


ESCAPES = [("\\", "\\0"), (":", "\\1"), ("<", "\\2")]


def head(role: Column) -> Column:
    name = F.when(role.isNull(), F.lit("?"))
    for plain, shown in NAMES.items():
        name = name.when(role == plain, F.lit(shown))
    return F.concat(F.lit("### "), name.otherwise(F.concat(F.lit("="), _swap(role, ESCAPES))), F.lit(": "))


def role_of(name: Column) -> Column:
    role = F.when(name == "?", F.lit(None).cast("string"))
    for plain, shown in NAMES.items():
        role = role.when(name == shown, F.lit(plain))
    return role.otherwise(_swap(F.substr(name, F.lit(2)), [(new, old) for old, new in reversed(ESCAPES)]))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text, read back: array of (role, text)."""
    pieces = F.filter(F.split(formatted, END), lambda piece: piece != "")
    at = lambda piece: F.instr(piece, ": ")
    return F.transform(
        pieces,
        lambda piece: F.struct(role_of(F.substr(piece, F.lit(5), at(piece) - 5)).alias("role"), unguarded(F.substr(piece, at(piece) + 2)).alias("text")),
    )


def reply_of(text: Column, start: Column, stop: Column) -> Column:
    """What stands under the loss mask of an example, unescaped."""
    return unguarded(F.substr(text, start + 1, stop - start))


def examples(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_stop, last): one row per turn of the role `trained`.

    `text` ends with the reply; code points from loss_start to before loss_stop are trainable. `example`
    counts from 1. `last` marks the row that holds the whole conversation; where no reply ends it, that
    row has an empty mask at its end.
    """
    role = F.col("role").cast("string")
    rows = conversations.select("conv_id", "turn", role.alias("role"), head(role).alias("head"), guarded(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("said"))
    rows = rows.select("conv_id", "turn", "role", F.length("head").alias("opening"), F.concat("head", "said", F.lit(END)).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    size = F.length("piece").cast("bigint")
    rows = rows.select("conv_id", "role", "opening", "piece", F.row_number().over(order).alias("pos"), F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    masks = F.struct("pos", (F.col("stop") - size + F.col("opening")).alias("start"), (F.col("stop") - len(END)).alias("end"), "stop")
    talks = rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x.piece), "").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("role") == trained, masks))).alias("masks"),
        F.max("stop").alias("size"),
    )
    rest = F.struct(F.lit(None).cast("int").alias("pos"), F.col("size").alias("start"), F.col("size").alias("end"), F.col("size").alias("stop"))
    ended = F.coalesce(F.get(F.col("masks"), F.size("masks") - 1)["stop"] == F.col("size"), F.lit(False))
    shown = talks.select("conv_id", "whole", "size", F.posexplode(F.when(ended, F.col("masks")).otherwise(F.array_append("masks", rest))).alias("at", "mask"))
    return shown.select(
        "conv_id",
        (F.col("at") + 1).alias("example"),
        F.substr("whole", F.lit(1), F.col("mask.stop").cast("int")).alias("text"),
        F.col("mask.start").alias("loss_start"),
        F.col("mask.end").alias("loss_stop"),
        (F.col("mask.stop") == F.col("size")).alias("last"),
    )


def digest(shown: DataFrame) -> DataFrame:
    """What `examples` wrote, read back per conversation: turns, text under the masks, sizes."""
    read = shown.select(
        "conv_id",
        "example",
        F.when(F.col("last"), F.col("text")).alias("whole"),  # the others are its beginnings: the rows that are grouped stay linear
        F.length("text").cast("bigint").alias("chars"),
        (F.col("loss_stop") > F.col("loss_start")).alias("masked"),
        reply_of(F.col("text"), F.col("loss_start").cast("int"), F.col("loss_stop").cast("int")).alias("reply"),
    )
    read = read.groupBy("conv_id").agg(
        F.max("whole").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: x.reply), "").alias("loss"),
        F.sum("chars").alias("example_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    turns = turns_of(F.col("whole"))
    line = lambda t: F.concat(F.coalesce(t.role, F.lit("")), F.lit("\n"), t.text, F.lit("\n"))
    return read.select(
        "conv_id",
        F.size(turns).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("whole").cast("bigint").alias("formatted_chars"),
        "n_examples",
        "example_chars",
    )


def planted(conversations: DataFrame, text: str, conv_id: int = -7) -> DataFrame:
    """`conversations` and one more: a user turn, then an assistant turn, both saying `text`."""
    more = conversations.sparkSession.range(2).select(
        F.lit(conv_id).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
