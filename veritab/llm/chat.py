"""Operator 4: chat formatting from a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col


@dataclass(frozen=True)
class ChatTemplate:
    """Markers of a turn, roles whose text is trained on, and the automaton of
    allowed turn orders: (state, role) -> state; a missing entry is an error
    from which nothing leads back. ``final`` states may end a conversation."""

    start: str = "<|im_start|>"
    header_end: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "begin"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("begin", "system"): "briefed", ("begin", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})


TEMPLATE = ChatTemplate()
ERROR = "error"
NEWLINE = "<|nl|>"


def escape(c: Column) -> Column:
    """No ``<|`` is left: a backslash goes between ``<`` and the bar, behind
    those that are there already."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """A role stands on one line; a newline in it becomes a control string of
    its own, which escaped text can't hold."""
    return F.replace(escape(c), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(NEWLINE), F.lit("\n")))


def format_chats(turns: DataFrame, template: ChatTemplate = TEMPLATE, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, formatted, segments, valid, state`` per conversation.

    ``segments`` is an array of (text, loss); their texts in order are
    ``formatted``. A turn gives its header, its escaped text (loss for the
    template's loss roles) and its end marker. ``state`` is where the
    automaton ends, ``valid`` whether it may end there; conversations out of
    order are formatted all the same, so a filter on ``valid`` is the caller's.

    Turns are ordered by turn, then role, then text (nulls first); repeated
    rows are repeated turns. A null role or text is empty, a null id is a
    conversation of its own. An empty table gives no rows. A conversation is
    one output value and is gathered as such; nothing else is grouped.
    """
    rows = turns.select(col(conv_col).alias("conv_id"), F.struct(
        col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"),
        F.coalesce(col(text_col), F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])

    def step(state: Column, t: Column) -> Column:
        return F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), t["role"])), F.lit(ERROR))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def emit(t: Column) -> Column:
        return F.array(
            segment(F.concat(F.lit(template.start), escape_role(t["role"]), F.lit(template.header_end)), F.lit(False)),
            segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.end), F.lit(False)))

    return (talks.withColumn("segments", F.flatten(F.transform("turns", emit)))
            .withColumn("state", F.aggregate("turns", F.lit(template.first), step))
            .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                    "segments", F.col("state").isin(*template.final).alias("valid"), "state"))


def parse_chat(formatted: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    parts = F.split(formatted, "\\Q" + template.end + "\\E", -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(template.start) + 1), F.length(part))
        at = F.instr(body, F.lit(template.header_end))
        return F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substring(body, at + len(template.header_end), F.length(body))).alias("text"))

    return F.transform(whole, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digest(formatted: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Counts and digests read back from the output of ``format_chats``."""
    back = formatted.withColumn("back", parse_chat(F.col("formatted"), template)).withColumn(
        "loss_text", loss_text(F.col("segments")))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
