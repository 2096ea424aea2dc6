"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events of conversations: ``message`` starts a turn, ``delta`` appends to a turn's text,
``edit`` replaces it, and ``regenerate`` throws a turn's text and all later turns away and starts it anew.
Logs are partitioned by conversation and turn and sorted by sequence. A running count tells which message
an event belongs to, and one fold over the events of a message gives its text: what follows the last
event that sets the text anew. Events before a regeneration of their turn or an earlier one are left out.
Final messages are gathered by conversation, in order of their first events.

They are rendered between control marks; the characters that begin marks are escaped in texts
and roles, so what a text holds is never read as a mark, and the rendering is reversible.

    <|begin|><|turn:user|>text<|end|><|turn:assistant|>text<|end|>

``loss`` flags the rendering's segments: the text of assistant turns alone is learned from.

Defined results: null text and null role are empty; an event without kind is a message; events of equal
sequence are taken in order of turn, kind, role and text; a null turn or sequence comes first, and no
regeneration reaches a null turn; a delta or edit of a turn that does not stand starts it; a role that an
event leaves empty stays that of its message, or of the one that it regenerates; several messages of one
turn number are turns of their own; repeated rows are events of their own; a null conversation is a
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN = "<|begin|>"
HEAD = "<|turn:"
HEAD_END = "|>"
END = "<|end|>"
#: What stands for the characters that marks begin and end with; the escape character comes first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def conversation_events(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table of turns, as a log of one message event a row."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("sequence"),
        F.lit("message").alias("kind"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turns): the final (role, text) of every message of a log (conv_id, sequence, kind, turn, role, text).

    Each message is a turn, also if several have one number; deltas, edits and regenerations go to the
    latest message of their number. Only conversations with regenerations are joined to those.
    """
    order = ("sequence", "turn", "kind", "role", "text")
    log = events.select("conv_id", "sequence", "turn", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("kind", "message"), ("role", ""), ("text", ""))))
    again = log.where("kind = 'regenerate'").groupBy(F.col("conv_id").alias("c")).agg(F.collect_list(F.struct(*order)).alias("again"))
    log = log.join(again, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    gone = F.exists("again", lambda g: (F.struct(*order) < g) & (F.col("turn") >= g["turn"]))
    log = log.withColumn("gone", F.coalesce(gone, F.lit(False))).drop("c", "again")

    of_turn = Window.partitionBy("conv_id", "turn").orderBy(F.asc_nulls_first("sequence"), "kind", "role", "text")
    begins = F.col("kind").isin("message", "regenerate") & ~F.col("gone")
    earlier_role = F.last(F.nullif("role", F.lit("")), ignorenulls=True).over(of_turn.rowsBetween(Window.unboundedPreceding, -1))
    log = log.withColumns({"message": F.count_if(begins).over(of_turn.rowsBetween(Window.unboundedPreceding, 0)), "earlier_role": earlier_role})
    log = log.where("not gone").withColumn("role", F.when((F.col("kind") == "regenerate") & (F.col("role") == ""), F.coalesce("earlier_role", "role")).otherwise(F.col("role")))
    parts = F.array_sort(F.collect_list(F.struct("sequence", "kind", "role", "text")))
    messages = log.groupBy("conv_id", "turn", "message").agg(parts.alias("parts"))
    resets = F.transform("parts", lambda p, i: F.when(p["kind"] != "delta", i).otherwise(0))  # the fold begins at the last of them
    texts = F.slice("parts", F.array_max(resets) + 1, F.size("parts"))
    roles = F.filter("parts", lambda p: p["role"] != "")
    message = F.struct(
        F.get("parts", F.lit(0))["sequence"].alias("sequence"), "turn", "message",
        F.coalesce(F.get(roles, F.size(roles) - 1)["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(texts, lambda p: p["text"]), "").alias("text"),
    )
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(conversations: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments): the rendering, and its segments (length, loss) in order."""
    head = lambda t: F.concat(F.lit(HEAD), escape(t["role"]), F.lit(HEAD_END))
    ready = conversations.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("text"), (t["role"] == learned).alias("loss"))).alias("parts"),
    )
    body = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    first = F.array(F.struct(F.lit(len(BEGIN)).alias("length"), F.lit(False).alias("loss")))
    rest = F.transform(
        "parts",
        lambda p: F.array(
            F.struct(F.char_length(p["head"]).alias("length"), F.lit(False).alias("loss")),
            F.struct(F.char_length(p["text"]).alias("length"), p["loss"].alias("loss")),
            F.struct(F.lit(len(END)).alias("length"), F.lit(False).alias("loss")),
        ),
    )
    return ready.select("conv_id", F.concat(F.lit(BEGIN), body).alias("formatted"), F.concat(first, F.flatten(rest)).alias("segments"))


def parse(formatted: DataFrame) -> DataFrame:
    """The columns of ``formatted`` with ``turns``, the (role, text) read back from the rendering alone."""
    body = F.substr("formatted", F.lit(len(BEGIN) + 1))
    pieces = F.split(body, END.replace("|", r"\|"))
    heads = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last end mark is empty
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), HEAD_END, 1)
    text = lambda p: F.substr(p, F.locate(HEAD_END, p) + len(HEAD_END))
    return formatted.withColumn("turns", F.transform(heads, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text"))))


def learned_text(formatted: DataFrame) -> DataFrame:
    """The columns of ``formatted`` with ``learned``, the unescaped text of all segments under the loss mask.

    A segment is found by its place: the marks part the rendering into as many pieces as there are
    segments, so the mask's pieces are taken by number, and their lengths are checked.
    """
    marks = BEGIN + "|" + HEAD + "[^<>]*" + HEAD_END + "|" + END
    pieces = F.split("formatted", "(?:" + marks.replace("|>", r"\|>").replace("<|", r"<\|") + ")")
    # pieces: before BEGIN, between BEGIN and the first head, then text and gap in turn
    texts = F.filter(F.transform("segments", lambda s, i: F.when(i % 3 == 2, F.struct(s["length"].alias("length"), s["loss"].alias("loss"), i.alias("i")))), lambda s: s.isNotNull())
    taken = F.transform(
        F.filter(texts, lambda s: s["loss"]),
        lambda s: F.get("pieces", 2 * F.floor(s["i"] / 3).cast("int") + 2),
    )
    lengths = F.aggregate(F.filter("segments", lambda s: s["loss"]), F.lit(0), lambda n, s: n + s["length"])
    joined = F.array_join("taken", "")
    checked = F.when(F.char_length(joined) == lengths, unescape(joined)).otherwise(F.raise_error(F.lit("the loss mask does not fit the rendering")))
    with_pieces = formatted.withColumn("pieces", pieces).withColumn("taken", taken)
    return with_pieces.withColumn("learned", checked).drop("pieces", "taken")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the rendering and its mask."""
    back = learned_text(parse(formatted))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
