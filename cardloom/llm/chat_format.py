"""Operator 10: chat formatting with a declarative template, a role automaton and per-segment loss flags.

Built-in functions only. A conversation is one record: its turns are gathered, ordered by turn (then role and
text, so that ties and repeated rows have one order), checked by a finite-state machine over the roles and written
as segments. Texts can't forge turns: whatever the template, the characters that its control strings begin with are
written otherwise inside texts and roles, and can be restored.

Null text and null role count as empty. A conversation is one record however long its texts. Other columns may have any
names and are left out. Roles outside the automaton make a conversation invalid; it is still
formatted and says so in `valid`. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles that are learnt from, and the automaton: (state, role) to state."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "asked", ("start", "user"): "user", ("asked", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    })
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = (self.open, self.after_role, self.close)
        if not all(marks) or any("\\" in m for m in marks):
            raise ValueError("control strings must not be empty or hold a backslash")
        if any(m[-k:] == self.open[:k] for m in marks for k in range(1, len(self.open))):
            raise ValueError("no control string may end as the opening one begins")

    def codes(self, role: bool = False) -> dict[str, str]:
        """What is written for the escape sign and for each character that begins a control string: the sign and a
        letter that no control string holds."""
        specials = dict.fromkeys(["\\", self.open[0], self.close[0], *([self.after_role[0]] if role else [])])
        letters = (c for c in map(chr, range(0x61, 0x10000)) if c not in self.open + self.after_role + self.close)
        return {c: "\\" + next(letters) for c in specials}


def escape(text: Column, template: Template | None = None, role: bool = False) -> Column:
    """No character is left that begins a control string (in a role: the mark behind it too); unescape() restores all."""
    for c, code in (template or Template()).codes(role).items():  # the escape sign first
        text = F.replace(text, F.lit(c), F.lit(code))
    return text


def unescape(text: Column, template: Template | None = None, role: bool = False) -> Column:
    for c, code in reversed((template or Template()).codes(role).items()):
        text = F.replace(text, F.lit(code), F.lit(c))
    return text


def _valid(roles: Column, template: Template) -> Column:
    table = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}>{role}", to)))
    last = F.aggregate(
        roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), role)), F.lit("error"))
    )
    return last.isin(*template.ends)


def format_chats(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, valid, segments array<struct<text, loss>> and formatted (their concatenation)."""
    t = template or Template()
    turns = df.select(
        F.col(f"`{conv}`").alias("c"),
        F.struct(
            F.col(f"`{turn}`").alias("n"),
            F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    chats = turns.groupBy("c").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    segment = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    never = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        segment(F.concat(F.lit(t.open), escape(x["role"], t, role=True), F.lit(t.after_role)), never),
        segment(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
        segment(F.lit(t.close), never),
    )))
    out = chats.select(F.col("c").alias(conv), _valid(F.col("turns.role"), t).alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(df: DataFrame, template: Template | None = None, formatted: str = "formatted", name: str = "turns") -> DataFrame:
    """Parses formatted conversations: adds turns array<struct<role, text>>, unescaped."""
    t = template or Template()
    parts = F.filter(F.split(F.col(formatted), _quoted(t.open), -1), lambda x, i: i > 0)
    role_of = lambda x: F.substring_index(x, t.after_role, 1)
    turns = F.transform(parts, lambda x: F.struct(
        unescape(role_of(x), t, role=True).alias("role"),
        unescape(F.substr(x, F.length(role_of(x)) + len(t.after_role) + 1, F.length(x) - F.length(role_of(x)) - len(t.after_role) - len(t.close)), t).alias("text"),
    ))
    return df.withColumn(name, turns)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"
