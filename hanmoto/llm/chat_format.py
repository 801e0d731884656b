"""Chat formatting by a declarative template (native DataFrame code only).

A finite-state machine over roles checks turn order. Each turn gives three text segments (opening marker, text, closing marker);
only the text of trained roles carries loss. Control strings inside roles and texts are escaped, so that formatted text can be read
back exactly.

Defined results: turns are ordered by turn, role, text, nulls first, and repeated rows stay; a null text or role is empty; a null
conversation id is a conversation; unknown roles are formatted like others but make the conversation invalid; an empty table gives
an empty table; other columns are ignored. A conversation becomes one row, so it must fit in memory as its text does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``escapes``: control string -> letter; it is written as a backslash and that letter, a backslash as two.

    Every control string that could end a text or a role must be in the escapes, and none may contain a backslash.
    The opening marker is ``open + role + separator``. ``moves``: state -> roles that may follow; a role's name is the next state.
    """

    open: str = "### "
    separator: str = ": "
    close: str = "</turn>"
    end: str = "\n"
    escapes: dict[str, str] = field(default_factory=lambda: {"</turn>": "t", "### ": "h"})
    role_escapes: dict[str, str] = field(default_factory=lambda: {"</turn>": "t", "### ": "h", ": ": "c"})
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escape(text: Column, escapes: dict[str, str]) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, letter in escapes.items():
        out = F.replace(out, F.lit(control), F.lit("\\" + letter))
    return out


def unescape(text: Column, escapes: dict[str, str]) -> Column:
    """Doubled backslashes are split off first; what is left has single-letter escapes only, so the order of replacement is free."""

    def plain(part: Column) -> Column:
        for control, letter in escapes.items():
            part = F.replace(part, F.lit("\\" + letter), F.lit(control))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def state_after(roles: Column, template: Template) -> Column:
    """The machine's state after all roles; ``error`` once a role isn't allowed."""

    def step(state: Column, role: Column) -> Column:
        allowed = F.lit(False)
        for s, following in template.moves.items():
            allowed |= (state == s) & role.isin(*following)
        return F.when(allowed, role).otherwise(F.lit("error"))

    return F.aggregate(roles, F.lit("start"), step)


def format_chats(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: ``conv_id, valid, segments`` (array of text, loss) and ``formatted``."""
    row = F.struct("turn", "role", "text")
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def parts(t: Column) -> Column:
        role, text = F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit(""))
        head = F.concat(F.lit(template.open), escape(role, template.role_escapes), F.lit(template.separator))
        seg = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(text, template.escapes), role.isin(*template.trained)), seg(F.lit(template.close + template.end), F.lit(False)))

    chats = chats.withColumn("segments", F.flatten(F.transform("turns", parts)))
    chats = chats.withColumn("valid", state_after(F.transform("turns", lambda t: F.coalesce(t["role"], F.lit(""))), template).isin(*template.final))
    return chats.select("conv_id", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_chats(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Reads ``format_chats`` output back: adds ``turns`` (array of role, text) and ``loss_text``, both unescaped."""

    def turn(part: Column) -> Column:
        rest = F.substring(part, F.lit(len(template.open) + 1), F.length(part))
        role = F.substring_index(rest, template.separator, 1)
        text = F.substring(rest, F.length(role) + F.lit(len(template.separator) + 1), F.length(rest))
        return F.struct(unescape(role, template.role_escapes).alias("role"), unescape(text, template.escapes).alias("text"))

    pieces = F.split("formatted", f"\\Q{template.close}{template.end}\\E")  # quoted; control strings hold no backslash
    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template.escapes))
    return formatted.withColumn("turns", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)).withColumn("loss_text", F.array_join(trained, ""))
