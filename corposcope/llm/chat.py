"""Conversations from an event log, rendered as training text; DataFrame functions only.

A log has events (conv_id, seq, kind, turn, slot, role, text). ``message``
opens the message at (turn, slot), ``delta`` adds to it, ``edit`` replaces what
it says, ``regenerate`` drops what it said and every later message that was
opened before. In order of seq, folding gives the final messages.

A rendered message is ``<|role|>`` newline text ``<|end|>`` newline. In roles
and texts the characters & < > [ ] are written as character references, so
neither this template's marks nor any other control string in angle or square
brackets can come from a text, and reading back gives the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The escaped characters with their references, the ampersand first.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"))
END = "<|end|>\n"


def escape(x: Column) -> Column:
    for plain, written in REFERENCES:
        x = F.replace(x, F.lit(plain), F.lit(written))
    return x


def unescape(x: Column) -> Column:
    for plain, written in reversed(REFERENCES):
        x = F.replace(x, F.lit(written), F.lit(plain))
    return x


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log of finished rows (conv_id, turn, role, text): each is opened and streamed in two deltas.

    Rows that share conv_id and turn stand side by side in slots, by role and text.
    """
    t = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    slot = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", t)) - 1
    rows = conversations.select("conv_id", "turn", "role", t.alias("text"), slot.alias("slot"))
    event = lambda at, kind, text: F.struct(F.lit(at).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    text = F.col("text")
    events = F.array(event(0, "message", F.lit("")), event(1, "delta", F.substring(text, F.lit(1), half)), event(2, "delta", F.substring(text, half + 1, F.length(text))))
    return rows.select("conv_id", "turn", "slot", "role", F.explode(events).alias("e")).select("conv_id", (F.coalesce(F.col("turn"), F.lit(-1)) * 4 + F.col("e.seq")).alias("seq"), F.col("e.kind").alias("kind"), "turn", "slot", "role", F.col("e.text").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, slot, role, text) of an event log.

    The last non-null role of a message's events counts, none gives "". Null
    texts add nothing. Events of equal seq apply in the order message,
    regenerate, edit, delta, then by text. Null turns come first.
    """
    step = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    e = events.select("conv_id", "turn", "slot", F.struct("seq", step.alias("step"), F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    # A message's events meet first; a conversation is gathered only from whole messages.
    folded = e.groupBy("conv_id", "turn", "slot").agg(
        F.collect_list("e").alias("es"),
        F.max(F.when(F.col("e.step") < 3, F.struct("e.seq", "e.step"))).alias("reset"),
        F.max(F.when(F.col("e.step") == 1, F.col("e.seq"))).alias("regenerated"),
    )
    alive = F.filter(F.sort_array("es"), lambda x: F.col("reset").isNull() | (F.struct(x["seq"], x["step"]) >= F.col("reset")))
    messages = folded.select(
        "conv_id", "turn", "slot", "regenerated", F.col("reset.seq").alias("opened"),
        F.coalesce(F.try_element_at(F.filter(F.transform(F.sort_array("es"), lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(alive, lambda x: x["text"]), "").alias("text"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("regenerated").over(earlier)
    return messages.withColumn("cut", cut).filter(F.col("cut").isNull() | (F.col("opened") >= F.col("cut"))).select("conv_id", "turn", "slot", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) of whole conversations.

    spans has (turn_start, start, end) for each message in order, in code points of
    ``formatted``: the loss mask covers start to end, which is the text of an
    assistant's message and nothing for others.
    """
    said = escape(F.col("text"))
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    m = messages.select("conv_id", "turn", "slot", F.concat(head, said, F.lit(END)).alias("rendered"), F.length(head).alias("head"), F.when(F.col("role") == "assistant", F.length(said)).otherwise(0).alias("loss"))
    before = Window.partitionBy("conv_id").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0).cast("long"))
    m = m.withColumn("turn_start", at)
    part = F.struct("turn", "slot", "rendered", F.struct("turn_start", (F.col("turn_start") + F.col("head")).alias("start"), (F.col("turn_start") + F.col("head") + F.col("loss")).alias("end")).alias("span"))
    whole = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("formatted"), F.transform("parts", lambda p: p["span"]).alias("spans"))


def format_log(events: DataFrame) -> DataFrame:
    """Folds an event log and renders it. An empty log gives no rows; other columns are ignored.

    Null texts are empty. A conversation, however long, is gathered as one row and rendered as one string of one task.
    """
    return render(fold(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars) read from ``formatted`` and its mask alone.

    turns is an array of (role, text). loss_texts are the texts under the mask.
    """
    cut = F.split("formatted", r"<\|end\|>\n", -1)
    # The generator computes the parts once, outside the lambdas that use them.
    parts = formatted.select("conv_id", "spans", F.length("formatted").cast("long").alias("formatted_chars"), F.explode(F.array(F.struct(F.slice(cut, 1, F.size(cut) - 1).alias("p")))).alias("s")).select("conv_id", "spans", "formatted_chars", F.col("s.p").alias("parts"))
    role = lambda p: F.substring(F.substring_index(p, "|>\n", 1), F.lit(3), F.length(p))
    text = lambda p: F.substring(p, F.length(F.substring_index(p, "|>\n", 1)) + 4, F.length(p))
    turns = F.transform("parts", lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text")))
    masked = F.zip_with("parts", "spans", lambda p, s: F.when(s["end"] > s["start"], unescape(F.substring(p, (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).otherwise(F.lit("")))
    return parts.select("conv_id", turns.alias("turns"), masked.alias("loss_texts"), "formatted_chars")
