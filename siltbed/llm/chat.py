"""Chat formatting by a declarative template and a finite-state machine over roles.

A template names the header and footer of a turn, a label for each known
role, which roles are trained on, and the moves of the machine.  Texts are
escaped (``\\`` as ``\\b``, ``#`` as ``\\h``, ``<`` as ``\\l``; in role names also ``:``
as ``\\c``), so no control string can appear inside one and unescaping gives
it back.

Defined cases: null texts and roles are empty; equal turns are ordered by
role and text; a role without a label is written in angle brackets, escaped;
an unknown or misplaced role makes the conversation invalid, which is
reported and not dropped; an empty table gives an empty result; other columns
are ignored.  A conversation is one row, so it must fit in one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    before: str = "### "
    after_role: str = ": "
    footer: str = "</turn>\n"
    labels: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    trained: tuple[str, ...] = ("assistant",)
    #: state, role, next state
    moves: tuple[tuple[str, str, str], ...] = (("start", "system", "briefed"), ("start", "user", "asked"), ("briefed", "user", "asked"), ("asked", "assistant", "answered"), ("answered", "user", "asked"))


def escape(c: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _label(role: Column, t: Template) -> Column:
    out = F.concat(F.lit("<"), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(">"))
    for name, label in reversed(t.labels):
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def _role(label: Column, t: Template) -> Column:
    inner = F.substring(label, F.lit(2), F.length(label) - 2)
    out = unescape(F.replace(inner, F.lit("\\c"), F.lit(":")))
    for name, written in reversed(t.labels):
        out = F.when(label == written, F.lit(name)).otherwise(out)
    return out


def format_chat(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, valid, first_bad_turn (place from 0, else null)."""
    t = template or Template()
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    no, yes = F.lit(False), F.lit(True)
    part = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(part(F.concat(F.lit(t.before), _label(x["role"], t), F.lit(t.after_role)), no), part(escape(x["text"]), F.when(x["role"].isin(*t.trained), yes).otherwise(no)), part(F.lit(t.footer), no)),
        )
    )
    moves = F.create_map(*[F.lit(x) for state, name, to in t.moves for x in (f"{state}>{name}", to)])
    machine = F.aggregate(
        F.sequence(F.lit(0), F.size("turns") - 1),
        F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("bad")),
        lambda s, i: F.struct(
            F.coalesce(F.try_element_at(moves, F.concat(s["state"], F.lit(">"), F.get(F.col("turns"), i)["role"])), F.lit("failed")).alias("state"),
            F.coalesce(s["bad"], F.when(F.try_element_at(moves, F.concat(s["state"], F.lit(">"), F.get(F.col("turns"), i)["role"])).isNull(), i)).alias("bad"),
        ),
        lambda s: s["bad"],
    )
    out = one.select("conv_id", segments.alias("segments"), machine.alias("first_bad_turn"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", F.col("first_bad_turn").isNull().alias("valid"), "first_bad_turn")


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>>, parsed from the formatted string alone."""
    t = template or Template()
    pieces = F.split(formatted, f"\\Q{t.footer}\\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parse(p: Column) -> Column:
        label = F.substring_index(p, t.after_role, 1)
        text = F.substring(p, F.length(label) + len(t.after_role) + 1, F.length(p))
        return F.struct(_role(F.substring(label, F.lit(len(t.before) + 1), F.length(label)), t).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, parse)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, read back from the output."""
    turns = formatted.withColumn("turns", read_turns(F.col("formatted"), template))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
