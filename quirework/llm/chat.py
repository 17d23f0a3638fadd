"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A template names, for each role, the strings that open and close its turn and whether its text is trained on. Control
strings inside a text get one escape character in front, and reading back takes exactly one away, so any text survives.
The closing string stands behind a space that the template adds, so a text that ends in the escape character can't
hide it. The machine's transitions give the first turn at which the order of roles breaks a rule; a conversation that
breaks one is formatted all the same and says so in valid and error_turn.

Everything is DataFrame expressions. Turns are gathered by conversation, which is what the result has a row for: the
rows of one conversation meet in one task, rows of different ones don't.

Defined results: a null text is empty; a null role is an empty role, written in the generic form; a null conv_id is one
conversation of its own. Turns are ordered by (turn, role, text), null turns first, so ties are stable; repeated rows
are turns of their own. Texts of any length are kept whole; a conversation, formatted, has to fit in a row of Spark's
(2 GB). An empty table gives no conversations. Further columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Template:
    """turns: role to (opening, closing) string. other: the same for any role not listed, whose name is written before other_name. trained: roles under the loss. moves: (state, role) to next state; a state is the last role, or start."""

    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str] = ("[TURN]", "[/TURN]")
    other_name: str = "[SAYS]"
    trained: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str], ...] = (("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    final: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def controls(self) -> list[str]:
        return sorted({x for pair in (*self.turns.values(), self.other) for x in pair} | {self.other_name}, key=lambda x: (-len(x), x))

    def control_pattern(self) -> str:
        return "|".join(re.escape(x) for x in self.controls())


def escaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"({t.control_pattern()})", (re.escape(t.escape) + "$1"))


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"{re.escape(t.escape)}({t.control_pattern()})", "$1")


def segments_of(role: Column, text: Column, t: Template) -> Column:
    """array<struct<text, loss>> of one turn."""
    seg = lambda value, loss: F.struct(value.alias("text"), F.lit(loss).alias("loss"))
    own = escaped(text, t)
    turn = lambda first, last, loss: F.array(seg(first, False), seg(own, loss), seg(last, False))
    out = turn(F.concat(F.lit(t.other[0] + " "), escaped(role, t), F.lit(f" {t.other_name} ")), F.lit(" " + t.other[1]), False)
    for name, (start, end) in t.turns.items():
        out = F.when(role == name, turn(F.lit(start + " "), F.lit(" " + end), name in t.trained)).otherwise(out)
    return out


def role_errors(turns: Column, t: Template) -> Column:
    """The 0-based place of the first turn that the machine refuses; the number of turns if it ends in a state that isn't final; null if all is well."""
    moves = F.create_map(*[x for a, b in t.moves for x in (F.lit(f"{a}>{b}"), F.lit(b))])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.element_at(moves, F.concat(acc["state"], F.lit(">"), turn["role"]))
        return F.struct(F.coalesce(to, F.lit("error")).alias("state"), (acc["n"] + 1).alias("n"), F.when(acc["bad"].isNull() & to.isNull(), acc["n"]).otherwise(acc["bad"]).alias("bad"))

    return F.aggregate(turns, start, step, lambda acc: F.when(acc["bad"].isNotNull(), acc["bad"]).when(~acc["state"].isin(*t.final), acc["n"]))


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments (array of text and loss), valid, error_turn: a row for each conv_id.

    conversations: conv_id, turn, role, text.
    """
    t = template or Template()
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    parts = F.flatten(F.transform("turns", lambda x: segments_of(x["role"], x["text"], t)))
    return chats.select("conv_id", parts.alias("segments"), role_errors(F.col("turns"), t).alias("error_turn")).withColumn("valid", F.col("error_turn").isNull())


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_chats(chat: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> from a formatted string: what format_chats was given, in order."""
    t = template or Template()
    pairs = [(name, *pair) for name, pair in t.turns.items()]
    spell = "|".join(f"{re.escape(a)} ((?s:.*?)) {re.escape(b)}" for _, a, b in pairs)
    other = rf"{re.escape(t.other[0])} ((?s:.*?)) {re.escape(t.other_name)} ((?s:.*?)) {re.escape(t.other[1])}"
    pattern = rf"\G(?:{spell}|{other})"
    whole = F.regexp_extract_all(chat, F.lit(pattern), F.lit(0))

    def parse(x: Column) -> Column:
        inner = lambda a, b: F.substring(x, F.lit(len(a) + 2), F.length(x) - len(a) - len(b) - 2)
        body = inner(*t.other)
        at = F.instr(body, f" {t.other_name} ")
        # The name's own control strings are escaped, so the first one with spaces around it is the template's.
        out = F.struct(unescaped(F.substring(body, F.lit(1), at - 1), t).alias("role"), unescaped(F.substring(body, at + len(t.other_name) + 2, F.length(body)), t).alias("text"))
        for name, a, b in pairs:
            out = F.when(x.startswith(a), F.struct(F.lit(name).alias("role"), unescaped(inner(a, b), t).alias("text"))).otherwise(out)
        return out

    return F.transform(whole, parse)


def chat_digests(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, error_turn, all read back from format_chats' output."""
    t = template or Template()
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
    both = chats.select("*", formatted(F.col("segments")).alias("chat"), learned.alias("learned")).select("*", read_chats(F.col("chat"), t).alias("back"))
    lines = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return both.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("chat").cast("long").alias("formatted_chars"), "valid", F.col("error_turn").cast("long").alias("error_turn"),
    )
