"""Chat formatting from a declarative template, with turn order checked by a finite-state machine. Native only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn, the roles under the loss, and the moves of the machine as (state, role) -> state."""

    start: str = "<|im_start|>"
    header_end: str = "\n"
    end: str = "<|im_end|>"
    between: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    accepting: tuple[str, ...] = ("user", "assistant")


def escape(text: Column, role: bool = False) -> Column:
    """Texts hold no control string afterwards: ``\\`` is doubled and ``<|`` becomes ``<\\|``; in roles line ends too."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    """The inverse of ``escape``: doubled backslashes split the text, and the rest is replaced in between."""
    def part(p: Column) -> Column:
        p = F.replace(p, F.lit("\\|"), F.lit("|"))
        return F.replace(p, F.lit("\\n"), F.lit("\n")) if role else p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def format_chats(
    turns: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row a conversation: (conv, segments, formatted, state, valid).

    ``segments`` are (text, loss) in order; joined they give ``formatted``. Turns are ordered by number, ties by role
    and text, a null number first; repeated rows stay. A null role or text is empty; a null conversation id is a
    conversation. An order of roles that the machine refuses gives the state ``refused`` and ``valid`` false, and is
    formatted all the same. A conversation is one row, so it must fit into a task, long texts too. An empty table gives
    an empty result; extra columns are not read, whatever their names.
    """
    t = template or ChatTemplate()
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}>{role}", to)])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    grouped = turns.groupBy(F.col(conv_col).alias("_conv")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")))).alias("_turns"))

    def pieces(turn: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(t.start), escape(turn["role"], True), F.lit(t.header_end)), F.lit(False)),
            piece(escape(turn["text"]), turn["role"].isin(*t.loss_roles)),
            piece(F.lit(t.end + t.between), F.lit(False)))

    move = lambda state, turn: F.coalesce(
        F.element_at(moves, F.concat(state, F.lit(">"), turn["role"])), F.lit("refused"))
    return grouped.select(
        F.col("_conv").alias(conv_col),
        F.flatten(F.transform("_turns", pieces)).alias("segments"),
        F.aggregate("_turns", F.lit("start"), move).alias("state"),
    ).select(
        conv_col, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "state", F.col("state").isin(*t.accepting).alias("valid"))


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    t = template or ChatTemplate()
    parts = F.split(formatted, "\\Q" + t.start + "\\E", -1)
    tail = len(t.end + t.between)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, t.header_end, 1)
        body = F.substr(part, F.length(role) + F.lit(len(t.header_end) + 1),
                        F.length(part) - F.length(role) - F.lit(len(t.header_end) + tail))
        return F.struct(unescape(role, True).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
