"""Chat formatting from an event log: partition by conversation, sort by sequence, fold, render.

The log has one row per event.  ``message`` opens a message, ``delta`` appends streamed text to it,
``edit`` replaces its text, ``regenerate`` discards its text and starts anew with its own.  The fold
uses window and array functions only.

The template writes a turn as ``### role``, a line feed, the text, ``</turn>`` and a line feed.  In
roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l``, ``#`` becomes ``\\h``, and in roles
a line feed becomes ``\\n``; so no control string can occur inside them, and the reverse is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
OPEN, CLOSE = "### ", "</turn>\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of an event log (conv_id, seq, event, message_id, role, text).

    Events of a conversation are taken by seq, nulls first.  Each ``message`` event opens a message of
    its own, even under an id seen before; other events belong to the latest message of their id and
    are dropped if none is open.  A message keeps the place and role of its opening event.  Events that
    tie in seq apply in the order message, edit, regenerate, delta, then by text; repeated rows are
    repeated events.  Null texts are empty, null roles too; rows with a null conv_id form one
    conversation.  Unknown events have no effect.  Extra columns are dropped.
    """
    rank = F.when(F.col("event") == MESSAGE, 0).when(F.col("event") == EDIT, 1).when(F.col("event") == REGENERATE, 2).when(F.col("event") == DELTA, 3)
    log = events.select("conv_id", "seq", "message_id", rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("rank is not null")
    within = Window.partitionBy("conv_id", "message_id").orderBy("seq", "rank", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    log = log.repartition("conv_id").withColumn("opened", F.sum((F.col("rank") == 0).cast("int")).over(within)).where("opened > 0")
    folded = log.groupBy("conv_id", "message_id", "opened").agg(F.sort_array(F.collect_list(F.struct(F.col("rank") > 0, "seq", "rank", "text", "role"))).alias("e"))
    restart = F.array_max(F.transform(F.col("e"), lambda x, i: F.when(x["rank"] < 3, i).otherwise(0)))
    tail = F.slice(F.col("e"), restart + 1, F.size("e"))
    return folded.select("conv_id", F.col("e")[0]["seq"].alias("seq"), F.col("e")[0]["role"].alias("role"), F.array_join(F.transform(tail, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (start, end of each trained text, code points), n_turns.

    Messages (conv_id, seq, role, text) go by seq, then role and text.
    """
    size = lambda c: F.char_length(c).cast("long")
    rows = messages.select("conv_id", "seq", "role", F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size("head") + size("body") + len(CLOSE)).over(order), F.lit(0).cast("long")) + size("head"))
    turn = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("role") == TRAINED, F.col("at") + size("body")).alias("end"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["end"].isNotNull()), lambda x: F.struct(x["at"].alias("start"), x["end"].alias("end")))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_mask"), F.size("t").cast("long").alias("n_turns"))


def format_chats(events: DataFrame) -> DataFrame:
    """Fold an event log and render it; an empty log gives an empty table."""
    return render(fold_events(events))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text)."""
    pieces = F.split(formatted, CLOSE, -1)
    part = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    role = lambda p: F.substring_index(part(p), "\n", 1)
    text = lambda p: F.substr(part(p), F.char_length(role(p)) + 2)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(_unescape_role(role(p)).alias("role"), unescape(text(p)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
