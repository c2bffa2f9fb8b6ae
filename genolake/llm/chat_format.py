"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative template turns a
conversation into text segments, each with a loss flag. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn's text, and who speaks under the loss mask.

    `before` holds {role}. Every control string begins with `mark`; in texts and roles a backslash is doubled and then
    a mark is broken by one (`<|` to `<\\|`), which `unescape` undoes. In roles a line feed becomes `<\\n`, as the template
    ends a role with one."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    mark: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state. A role that a state doesn't list is an error, from which there is no way back.
    start: str = "begin"
    accept: tuple[str, ...] = ("assistant", "user")
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    broken = template.mark[0] + "\\" + template.mark[1:]
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(template.mark), F.lit(broken))


def unescape(text: Column, template: Template = CHATML) -> Column:
    broken = template.mark[0] + "\\" + template.mark[1:]
    return F.replace(F.replace(text, F.lit(broken), F.lit(template.mark)), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column, template: Template = CHATML) -> Column:
    return F.replace(escape(role, template), F.lit("\n"), F.lit(template.mark[0] + "\\n"))


def unescape_role(role: Column, template: Template = CHATML) -> Column:
    return unescape(F.replace(role, F.lit(template.mark[0] + "\\n"), F.lit("\n")), template)


def _next_state(state: Column, role: Column, template: Template) -> Column:
    out = F.lit("error")
    for name, moves in template.turns.items():
        for said, to in moves.items():
            out = F.when((state == name) & (role == said), F.lit(to)).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Returns (conv_id, segments array<struct<text, loss>>, formatted, valid, end_state), a row per conv_id of turns
    (conv_id, turn, role, text; other columns are ignored).

    Turns go by turn number, nulls first, then role, then text; rows that repeat a turn are turns of their own. A null text
    or role is empty; an empty text still is a turn. A conversation whose order the machine refuses is formatted too, with
    valid false. Rows with a null conv_id form one conversation. An empty table gives no rows. A conversation is one output
    row, so its text is held by one task, like a document's."""
    head, tail = template.before.split("{role}")
    said = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = turns.select("conv_id", said.alias("said")).groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    of_turn = lambda t: F.array(
        segment(F.concat(F.lit(head), escape_role(t["role"], template), F.lit(tail)), F.lit(False)),
        segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.after), F.lit(False)),
    )
    state = F.aggregate("said", F.lit(template.start), lambda s, t: _next_state(s, t["role"], template))
    chats = chats.select("conv_id", F.flatten(F.transform("said", of_turn)).alias("segments"), state.alias("end_state"))
    return chats.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("end_state").isin(*template.accept).alias("valid"), "end_state")


def read_chats(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>. No escaped text holds a mark, so each stands for itself."""
    head, tail = template.before.split("{role}")
    parts = F.filter(F.split(formatted, _literal(template.after)), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(head) + 1), F.length(p))
    return F.transform(
        F.transform(parts, lambda p: F.struct(body(p).alias("body"), F.instr(body(p), tail).alias("at"))),
        lambda x: F.struct(
            unescape_role(F.substring(x["body"], F.lit(1), x["at"] - 1), template).alias("role"),
            unescape(F.substring(x["body"], x["at"] + len(tail), F.length(x["body"])), template).alias("text"),
        ),
    )


def _literal(text: str) -> str:
    """A regular expression for the text itself."""
    return "".join(c if c.isalnum() or c in "_\n" else "\\" + c for c in text)


def loss_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
