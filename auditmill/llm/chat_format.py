"""Chat formatting: a finite-state machine over roles, and a declarative template that emits text segments with loss flags.

The machine reads a conversation's roles and goes from state to state. Each move tells whether the turn was due, and the state that it leads to tells
whether the turn's text bears loss. A turn that isn't due is marked, and the machine goes on from the state that the role leads to at any time. The
template gives each role its opening and closing marks. Marks are control strings. In texts,
a backslash becomes two, and a control string gets one after its first character; so no text holds a mark, and reading back undoes
both. Everything is DataFrame expressions over one conversation's array of turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """A role's marks, each of which begins and ends with one of its control strings or with white space."""

    open: str
    close: str


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    parts: dict[str, Part] = field(default_factory=lambda: {"system": Part("<<SYS>>\n", "\n<</SYS>>"), "user": Part("[INST] ", " [/INST]"), "assistant": Part("[OUT] ", "</s>")})
    #: Any other role: its name stands between open and name_end.
    other: Part = Part("[ROLE] ", " [/ROLE]")
    name_end: str = "[/NAME] "
    controls: tuple[str, ...] = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[/NAME]")
    #: The machine: from a state, by a role, to a state. What is missing is no turn that is due: from there, `anyway` has the role's state, or else
    #: `aside` is next. States in `final` may end a conversation; texts of turns that lead to states in `learned` bear loss.
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "instructed", ("start", "user"): "asked", ("instructed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    anyway: dict[str, str] = field(default_factory=lambda: {"system": "instructed", "user": "asked", "assistant": "answered"})
    aside: str = "aside"
    final: tuple[str, ...] = ("answered",)
    learned: tuple[str, ...] = ("answered",)


TEMPLATE = Template()


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in t.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column, t: Template = TEMPLATE) -> Column:
    out = text
    for c in t.controls:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def segments(role: Column, text: Column, loss: Column, t: Template = TEMPLATE) -> Column:
    """A turn's array of (text, loss)."""
    seg = lambda c, own=F.lit(False): F.struct(c.alias("text"), own.alias("loss"))
    made = F.array(seg(F.concat(F.lit(t.other.open), escape(role, t), F.lit(t.name_end))), seg(escape(text, t), loss), seg(F.lit(t.other.close)))
    for name, p in t.parts.items():
        made = F.when(role == name, F.array(seg(F.lit(p.open)), seg(escape(text, t), loss), seg(F.lit(p.close)))).otherwise(made)
    return made


#: Turns that the machine reads between two appends to its record, so that a long conversation is not copied with each turn.
_STRIDE = 64


def moves(roles: Column, t: Template = TEMPLATE) -> Column:
    """The machine's record of an array of roles: for each turn (state, due)."""
    legal = F.create_map(*(F.lit(x) for (a, b), c in t.moves.items() for x in (f"{a}:{b}", c)))
    else_ = F.create_map(*(F.lit(x) for pair in t.anyway.items() for x in pair))

    def move(acc: Column, role: Column) -> Column:
        to = F.try_element_at(legal, F.concat(acc["state"], F.lit(":"), role))
        own = F.struct(F.coalesce(to, F.try_element_at(else_, role), F.lit(t.aside)).alias("state"), to.isNotNull().alias("due"))
        return _with(own, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["made"], F.array(x)).alias("made")))

    none = F.array().cast("array<struct<state:string,due:boolean>>")
    begin = lambda state: F.struct(state.alias("state"), none.alias("made"))

    def stride(acc: Column, at: Column) -> Column:
        part = F.aggregate(F.slice(roles, at, F.lit(_STRIDE)), begin(acc["state"]), move)
        return _with(part, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["parts"], F.array(x["made"])).alias("parts")))

    whole = F.struct(F.lit(t.start).alias("state"), F.array().cast("array<array<struct<state:string,due:boolean>>>").alias("parts"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(roles), F.lit(1)), F.lit(_STRIDE)), lambda i: i <= F.size(roles))
    return F.aggregate(starts, whole, stride, lambda acc: F.flatten(acc["parts"]))


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def format_chats(turns: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, segments (text and loss flag, in order), formatted (the segments' texts joined), bad_turn (the first turn that
    the machine has no move for, the number of turns if they end too soon, else null), of each conversation of turns (conv_id, turn, role, text).

    A null text or role is empty. Turns go by turn number (nulls first), then role and text; repeated rows are turns of their own. A null
    conv_id is a conversation like any other. Turn order that the machine rejects is formatted all the same: bad_turn tells. A
    text bears loss if its turn leads the machine to a state that is learned, due or not. Other columns are not used. A conversation is one row of the result and is gathered in one task, as its digest and text have to be."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    read = chats.select("conv_id", "turns", moves(F.transform("turns", lambda x: x["role"]), t).alias("moves"))
    late = F.filter(F.transform("moves", lambda m, i: F.when(~m["due"], i)), lambda i: i.isNotNull())
    ends = F.element_at("moves", -1)["state"].isin(*t.final)
    bad = F.coalesce(F.try_element_at(late, F.lit(1)), F.when(~ends, F.size("turns")))
    loss = lambda i: F.get("moves", i)["state"].isin(*t.learned)
    body = F.flatten(F.transform("turns", lambda x, i: segments(x["role"], x["text"], loss(i), t)))
    made = F.concat(F.array(F.struct(F.lit(t.begin).alias("text"), F.lit(False).alias("loss"))), body)
    out = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), made.alias("segments"), bad.alias("bad_turn"))
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "bad_turn")


def read_back(formatted: Column, t: Template = TEMPLATE) -> Column:
    """The array of (role, text) that formatted was made from."""
    parts = [*t.parts.items(), (None, t.other)]
    pattern = "(?s)" + "|".join(f"{re.escape(p.open)}.*?{re.escape(p.close)}" for _, p in parts)
    found = F.regexp_extract_all(F.substr(formatted, F.lit(len(t.begin) + 1)), F.lit(pattern), F.lit(0))

    def turn(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(t.other.open) + 1), F.length(x) - len(t.other.open) - len(t.other.close))
        name = F.substring_index(inner, t.name_end, 1)
        out = F.struct(unescape(name, t).alias("role"), unescape(F.substr(inner, F.length(name) + len(t.name_end) + 1), t).alias("text"))
        for role, p in t.parts.items():
            inner = F.substr(x, F.lit(len(p.open) + 1), F.length(x) - len(p.open) - len(p.close))
            out = F.when(x.startswith(p.open), F.struct(F.lit(role).alias("role"), unescape(inner, t).alias("text"))).otherwise(out)
        return out

    return F.transform(found, turn)


def digests(chats: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from format_chats' formatted texts and loss flags; and the
    machine's verdict: bad_turn, valid."""
    back = chats.select("conv_id", "segments", "formatted", "bad_turn", read_back(F.col("formatted"), t).alias("back"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = back.select("conv_id", F.size("back").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "bad_turn")
    return out.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
                      "bad_turn", F.col("bad_turn").isNull().alias("valid"))
