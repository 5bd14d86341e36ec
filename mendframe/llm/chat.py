"""Chat formatting by a finite-state machine over roles and a declarative template (DataFrame functions only).

A template gives each role an opening and a closing mark and says whether the role's text is trained on. Turns are
sorted by turn; the machine walks over their roles and notes the first turn out of order (`error_at`), yet every turn
is formatted. Segments carry a loss flag each; `loss_spans` holds the places of flagged texts in the formatted string.

Texts are escaped so that none of the template's marks can occur inside one: backslashes are doubled, and a mark gets a
backslash after its first character. Unescaping drops a single backslash and halves a double one, left to right.

Defined cases: null texts and null roles are empty strings; roles the template doesn't know are written with the
generic mark that names them, without loss; turns that tie are ordered by role, then text, and repeated rows all stay;
an empty table gives an empty result; further columns are ignored; a null conv_id is one conversation of its own.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    opening: str
    closing: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """Marks by role; `other` names the role between its opening mark and `named`. order: state -> role -> state."""

    parts: dict[str, Part]
    other: Part
    named: str
    order: dict[str, dict[str, str]]
    final: tuple[str, ...]

    def marks(self) -> list[str]:
        marks = [m for p in (*self.parts.values(), self.other) for m in (p.opening, p.closing)] + [self.named]
        return sorted(set(marks), key=lambda m: (-len(m), m))


INSTRUCTIONS = Template(
    parts={"system": Part("<<SYS>>", "<</SYS>>", False), "user": Part("[INST]", "[/INST]", False), "assistant": Part("<s>", "</s>", True)},
    other=Part("<role>", "</role>", False),
    named="<text>",
    order={
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    final=("answered",),
)


def quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\[](){}.*+?^$|/<>-" else c for c in text)


def mark_pattern(template: Template) -> str:
    """A regular expression of any mark: its first character and the rest are two groups' worth of lookahead."""
    return "|".join(f"{quoted(m[0])}(?={quoted(m[1:])})" for m in template.marks())


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, F.lit(f"(\\\\|{mark_pattern(template)})"), F.lit("$1\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("\\\\(\\\\?)"), F.lit("$1"))


def _machine(template: Template, roles: Column) -> Column:
    """struct(state, error_at): the state after all turns and the index of the first turn out of order, or null."""
    steps = {f"{state} {role}": then for state, turn in template.order.items() for role, then in turn.items()}
    table = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])
    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("error_at"), F.lit(0).alias("at"))

    def step(held: Column, role: Column) -> Column:
        then = F.element_at(table, F.concat(held["state"], F.lit(" "), role))
        # after a turn out of order the machine goes on from the state that the turn's role leads to by itself
        return F.struct(
            F.coalesce(then, F.when(role == "user", "asked").when(role == "assistant", "answered").otherwise(held["state"])).alias("state"),
            F.coalesce(held["error_at"], F.when(then.isNull(), held["at"])).cast("int").alias("error_at"),
            (held["at"] + 1).alias("at"),
        )

    return F.aggregate(roles, start, step)


def _segment(turn: Column, template: Template) -> Column:
    text = escape(turn["text"], template)
    kinds = [(turn["role"] == role, F.lit(p.opening), F.lit(p.closing), p.loss) for role, p in template.parts.items()]
    opening = F.concat(F.lit(template.other.opening), escape(turn["role"], template), F.lit(template.named))
    closing, loss = F.lit(template.other.closing), F.lit(template.other.loss)
    for is_role, first, last, flag in reversed(kinds):
        opening, closing, loss = F.when(is_role, first).otherwise(opening), F.when(is_role, last).otherwise(closing), F.when(is_role, F.lit(flag)).otherwise(loss)
    return F.array(
        F.struct(opening.alias("text"), F.lit(False).alias("loss")),
        F.struct(text.alias("text"), loss.alias("loss")),
        F.struct(closing.alias("text"), F.lit(False).alias("loss")),
    )


def segments(conversations: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """conv_id, valid boolean, error_at int and segments array<struct<text, loss>> of each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    walked = grouped.withColumn("machine", _machine(template, F.transform("turns", lambda t: t["role"])))
    return walked.select(
        "conv_id",
        (F.col("machine.error_at").isNull() & F.col("machine.state").isin(*template.final)).alias("valid"),
        F.col("machine.error_at").alias("error_at"),
        F.flatten(F.transform("turns", lambda t: _segment(t, template))).alias("segments"),
    )


def format_chats(conversations: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """conv_id, valid, error_at, formatted string and loss_spans array<struct<start, length>> (code points, from 0)."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(held: Column, part: Column) -> Column:
        n = F.length(part["text"]).cast("long")
        span = F.struct(held["at"].alias("start"), n.alias("length"))
        return F.struct((held["at"] + n).alias("at"), F.when(part["loss"], F.concat(held["spans"], F.array(span))).otherwise(held["spans"]).alias("spans"))

    return segments(conversations, template).select(
        "conv_id", "valid", "error_at",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.aggregate("segments", start, add)["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column, template: Template = INSTRUCTIONS) -> Column:
    """array<struct<role, text>> parsed from a formatted string."""
    openings = {p.opening: role for role, p in template.parts.items()}
    every = [*template.parts.values(), template.other]
    first = "|".join(quoted(o) for o in sorted((p.opening for p in every), key=lambda m: -len(m)))
    last = "|".join(quoted(c) for c in sorted((p.closing for p in every), key=lambda m: -len(m)))
    pattern = F.lit(f"(?s)({first})(.*?)(?:{last})")
    roles = F.create_map(*[F.lit(x) for pair in openings.items() for x in pair])
    named = F.lit(template.named)

    def turn(opening: Column, body: Column) -> Column:
        role = F.element_at(roles, opening)
        return F.struct(
            unescape(F.coalesce(role, F.substring_index(body, template.named, 1))).alias("role"),
            unescape(F.when(role.isNull(), F.substring(body, F.locate(template.named, body) + F.length(named), F.length(body))).otherwise(body)).alias("text"),
        )

    return F.zip_with(F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2)), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped: the flagged texts in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
