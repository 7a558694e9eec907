"""Chat formatting by a finite-state machine over roles, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What stands around a turn, whose texts are learnt, and which role may follow which state.

    A turn is `open` + role + newline + text + `close`. `mark` begins both of these; within roles
    and texts it is escaped, and so is the newline within roles.
    """

    mark: str = "<|"
    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    learnt: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant",
    })
    final: tuple[str, ...] = ("assistant",)

    @property
    def broken(self) -> str:
        """`mark` as it stands in a text: a backslash after its first character."""
        return self.mark[0] + "\\" + self.mark[1:]


LINE = "<\\n>"


def escaped(text: Column, t: ChatTemplate, line: bool = False) -> Column:
    """Reversible: backslashes are doubled, so a single one after the mark's first character is ours."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(t.mark), F.lit(t.broken))
    return F.replace(out, F.lit("\n"), F.lit(LINE)) if line else out


def unescaped(text: Column, t: ChatTemplate, line: bool = False) -> Column:
    if line:
        text = F.replace(text, F.lit(LINE), F.lit("\n"))
    return F.replace(F.replace(text, F.lit(t.broken), F.lit(t.mark)), F.lit("\\\\"), F.lit("\\"))


def last_state(roles: Column, template: ChatTemplate) -> Column:
    """The machine's state after these roles, from its start; null once a role has no move from the state that it is in."""

    def move(state: Column, role: Column) -> Column:
        out = F.lit(None).cast("string")
        for (old, by), new in template.moves.items():
            out = F.when((state == old) & (role == by), F.lit(new)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(template.start), move)


def text_segments(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row for each segment: conv, at, role, part, segment, begin (in characters of the conversation), loss.

    Each turn gives three segments: the opening with the role, the text, the close. Only the text
    of a learnt role is under the loss. Turns are ordered by turn (null first), then role, then text; null roles
    and texts are empty. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), "role", "text")
    rows = turns.select(conv, turn, role.alias("role"), text.alias("text"))
    opening = F.concat(F.lit(template.open), escaped(F.col("role"), template, line=True), F.lit("\n"))
    rows = rows.withColumn("opening", opening).withColumn("body", escaped(F.col("text"), template))
    size = F.length("opening") + F.length("body") + F.lit(len(template.close))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("before", before)
    loss = F.col("role").isin(*template.learnt)
    part = lambda segment, begin, under: F.struct(segment.alias("segment"), begin.alias("begin"), under.alias("loss"))
    body, end = F.col("before") + F.length("opening"), F.col("before") + F.length("opening") + F.length("body")
    parts = F.array(part(F.col("opening"), F.col("before"), F.lit(False)), part(F.col("body"), body, loss), part(F.lit(template.close), end, F.lit(False)))
    return rows.select(conv, "at", "role", F.posexplode(parts).alias("part", "_x")).select(conv, "at", "role", "part", "_x.segment", "_x.begin", "_x.loss")


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row for each conversation: conv, formatted, loss_spans (start and length in characters), valid.

    All conversations are formatted; `valid` says if the machine, run over the roles in order, ends in a final
    state. An empty table gives an empty result; a null conversation id is an id like others. A
    conversation is one string, so it has to fit a task; nothing here grows faster than it.
    """
    parts = text_segments(turns, template, conv, turn)
    sorted_parts = F.sort_array(F.collect_list(F.struct("at", "part", "role", "segment", "begin", "loss")))
    rows = parts.groupBy(conv).agg(sorted_parts.alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: p["segment"]), "")
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["begin"].alias("start"), F.length(p["segment"]).cast("long").alias("length")))
    roles = F.transform(F.filter("parts", lambda p: p["part"] == 0), lambda p: p["role"])
    valid = F.coalesce(last_state(roles, template).isin(*template.final), F.lit(False))
    return rows.select(conv, formatted.alias("formatted"), spans.alias("loss_spans"), valid.alias("valid"))


def read_chats(chats: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back: conv, turns (role, text) and learnt, the unescaped text under the loss mask."""
    pieces = F.filter(F.split("formatted", "\\Q" + template.close + "\\E"), lambda p: p != "")
    head = len(template.open)
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, head + 1, 2**31 - 1), "\n", 1), template, line=True).alias("role"),
        unescaped(F.substr(p, F.instr(p, "\n") + 1), template).alias("text"),
    ))
    masked = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    learnt = F.array_join(F.transform(masked, lambda m: unescaped(m, template)), "")
    return chats.select(conv, "formatted", "valid", turns.alias("turns"), learnt.alias("learnt"))
