"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Everything is DataFrame and SQL functions. A template names each role's marks, what follows what, and which
roles are learnt. Control strings inside texts are escaped, so that the
formatted text can be read back turn by turn.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BAD = "start", "bad"
SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Role:
    """Marks around a role's text, and whether its text is learnt."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of a conversation, of its roles and of roles that aren't declared (before, between role and text, after), and the machine.

    ``follows`` has for each state (``start``, or the role of the turn before) the roles that may come; a
    conversation whose last role is in ``ends`` is complete. Control strings are the marks
    without the spaces at their ends. A control string's first character stands nowhere else in any
    of them, and none begins with another, so that marks are told apart wherever they meet texts.
    """

    roles: Mapping[str, Role]
    follows: Mapping[str, tuple[str, ...]]
    ends: tuple[str, ...]
    begin: str = "<s>"
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [self.begin, *self.other, *(m for r in self.roles.values() for m in (r.before, r.after))]
        controls = tuple(dict.fromkeys(m.strip(" ") for m in marks))
        object.__setattr__(self, "controls", controls)
        firsts = {c[:1] for c in controls}
        if any(len(c) < 2 or "\\" in c or firsts & set(c[1:]) for c in controls) or any(a != b and b.startswith(a) for a in controls for b in controls):
            raise ValueError("control strings need a first character of their own, two characters at least, no backslash, and none may begin with another")
        if {r for x in self.follows.values() for r in x} - set(self.roles) or set(self.follows) - {START, *self.roles}:
            raise ValueError("the machine names a role that the template doesn't declare")


DEFAULT = Template(
    roles={"system": Role("[SYS] ", " [/SYS]"), "user": Role("[INST] ", " [/INST]"), "assistant": Role("[ANS] ", " </s>", loss=True)},
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def escape(text: Column, template: Template) -> Column:
    """The text without control strings: backslashes are doubled, and one is set behind the first character of each control string."""
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({starts})", r"$1\\")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given; also of several escaped texts joined."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(pieces: list[tuple[Column, bool]]) -> Column:
    return F.array(*(F.struct(text.alias("text"), F.lit(loss).alias("loss")) for text, loss in pieces)).cast(SEGMENTS)


def turn_segments(role: Column, text: Column, template: Template = DEFAULT) -> Column:
    """The segments (text, loss) of one turn. Null roles and texts are empty."""
    role, body = F.coalesce(role, F.lit("")), escape(F.coalesce(text, F.lit("")), template)
    before, between, after = map(F.lit, template.other)
    found = _segments([(before, False), (escape(role, template), False), (between, False), (body, False), (after, False)])
    for name, r in template.roles.items():
        found = F.when(role == name, _segments([(F.lit(r.before), False), (body, r.loss), (F.lit(r.after), False)])).otherwise(found)
    return found


def render(turns: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, turn_col, role_col, segments) for every row of ``turns``; no row moves."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    return turns.select(id_col, turn_col, role.alias(role_col), turn_segments(role, F.col(text_col), template).alias("segments"))


def turn_order(turns: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", block: int = 64) -> DataFrame:
    """(key, valid, first_bad_turn, complete) of every conversation; key is a struct of the id, so that a null id is one as any other.

    Only turns and roles are shuffled. ``block`` turns at a time become a function from each state to the state
    behind them; functions of blocks are composed, so that a very long conversation is
    folded by many tasks. Turns of equal number go by role.
    """
    states = [START, *template.roles, BAD]
    at = {s: k for k, s in enumerate(states)}
    steps = {r: [at[r] if r in template.follows.get(s, ()) else at[BAD] for s in states] for r in template.roles}
    ints = lambda xs: F.array(*map(F.lit, xs))
    table = ints([at[BAD]] * len(states))
    role = F.coalesce(F.col(role_col), F.lit(""))
    for name, step in steps.items():
        table = F.when(role == name, ints(step)).otherwise(table)
    reached = "struct<state:int,bad:boolean,turn:{}>".format(turns.schema[turn_col].dataType.simpleString())

    def move(x: Column, step: Column, turn: Column) -> Column:
        state = F.element_at(step, x["state"] + 1)
        return F.struct(state.alias("state"), (state == at[BAD]).alias("bad"), F.when(x["bad"], x["turn"]).when(state == at[BAD], turn).alias("turn")).cast(reached)

    begin = F.array(*(F.struct(F.lit(k).alias("state"), F.lit(s == BAD).alias("bad"), F.lit(None).alias("turn")) for s, k in at.items())).cast(f"array<{reached}>")
    rows = turns.select(F.struct(F.col(id_col).alias("id")).alias("key"), F.floor(F.col(turn_col) / block).alias("part"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), table.alias("step")).alias("row"))
    parts = rows.groupBy("key", "part").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    parts = parts.select("key", F.struct("part", F.aggregate("rows", begin, lambda f, r: F.transform(f, lambda x: move(x, r["step"], r["turn"]))).alias("f")).alias("p"))

    def through(x: Column, p: Column) -> Column:
        y = F.element_at(p["f"], x["state"] + 1)
        return F.struct(y["state"].alias("state"), y["bad"].alias("bad"), F.when(x["bad"], x["turn"]).otherwise(y["turn"]).alias("turn")).cast(reached)

    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    last = whole.select("key", F.aggregate("parts", F.element_at(begin, 1), through).alias("x"))
    return last.select("key", (~F.col("x.bad")).alias("valid"), F.col("x.turn").alias("first_bad_turn"), F.col("x.state").isin([at[e] for e in template.ends]).alias("complete"))


def assemble(rendered: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """(key, segments) of whole conversations, by turn (then role, then text). One conversation is one value, of 2 GB at most."""
    row = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col("segments").alias("segments"))
    whole = rendered.select(F.struct(F.col(id_col).alias("id")).alias("key"), row.alias("row")).groupBy("key").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    turns = F.flatten(F.transform("rows", lambda r: r["segments"]))
    return whole.select("key", F.concat(_segments([(F.lit(template.begin), False)]), turns).alias("segments"))


def formatted(segments: Column) -> Column:
    """The text of all segments."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learnt(segments: Column) -> Column:
    """The unescaped text of the segments under the loss mask."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def read_back(text: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    before, between, after = template.other
    pairs = [(r.before, r.after) for r in template.roles.values()]
    pattern = "|".join(f"{re.escape(a)}(?s:.*?){re.escape(b)}" for a, b in [*pairs, (before, after)])

    def inner(turn: Column, a: str, b: str) -> Column:
        return F.substr(turn, F.lit(len(a) + 1), F.length(turn) - len(a) - len(b))

    def parsed(turn: Column) -> Column:
        body = inner(turn, before, after)
        role = F.substring_index(body, between, 1)
        rest = F.substr(body, F.length(role) + len(between) + 1)
        known = reduce(lambda x, r: F.when(turn.startswith(r[1].before), F.struct(F.lit(r[0]).alias("role"), unescape(inner(turn, r[1].before, r[1].after)).alias("text"))).otherwise(x),
                       template.roles.items(), F.struct(unescape(role).alias("role"), unescape(rest).alias("text")))
        return known

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parsed)


def format_conversations(turns: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, segments, valid, first_bad_turn, complete) for every conversation of ``turns`` (a row a turn).

    segments: (text, loss) in order. valid: the machine never stopped; where it did, first_bad_turn is the turn. Invalid
    conversations are formatted as all others, and roles that the template doesn't declare (null: empty) have marks of their own.
    Null and empty texts are empty turns; a null turn comes first, turns of equal number go by role and text, and repeated rows
    are turns of their own. Null ids are one conversation. Other columns, whatever their
    names, are ignored; an empty table gives an empty result. Texts of any length are whole.
    """
    whole = assemble(render(turns, template, id_col, turn_col, role_col, text_col), template, id_col, turn_col, role_col)
    # both sides lie by key already, and the texts aren't moved again
    order = turn_order(turns, template, id_col, turn_col, role_col)
    return whole.join(order, "key").select(F.col("key.id").alias(id_col), "segments", "valid", "first_bad_turn", "complete")
