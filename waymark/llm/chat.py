"""Chat formatting from a declarative template, in column functions only (operator 1).

A finite-state machine over roles, given as (state, role, next state) triples,
tells whether a conversation's turns are in order and where they first are not;
every conversation is formatted either way.  The template names the text before
and after a turn and the roles whose bodies are learned.  Each turn gives three
segments (opening, body, closing), each with its own loss flag.

Control strings inside texts are escaped reversibly: a backslash becomes two, a
``<|`` becomes ``<\\|``, and a line break inside a role becomes ``\\n``; so ``<|``
stands in the output only where the template put it.

A conversation's turns are gathered into its one row, since the row is what is
asked for; nothing else is gathered.

Nulls and odd rows: a null text or role is empty; rows without a conversation id
form one conversation with a null id; null turns come first; rows with equal
turns are ordered by role, then text, and repeated rows stay.  The machine
rejects roles that it has no triple for, the empty one included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles are learned, and which role may follow which."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    ends: tuple[str, ...] = ("answered",)
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "briefed"), ("start", "user", "asked"), ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )


CHAT = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undoes both forms: between pairs of backslashes, the two other escapes are single."""
    plain = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def first_fault(roles: Column, template: Template = CHAT) -> Column:
    """Position of the first turn that the machine has no move for, or the number of turns if it stops too early; null if all is well."""
    moves = F.create_map(*(F.lit(x) for state, role, to in template.moves for x in (f"{state}\n{role}", to)))
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault"))

    def step(acc: Column, role: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), role))
        fault = F.coalesce(acc["fault"], F.when(to.isNull(), acc["at"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"), fault.alias("fault"))

    def close(acc: Column) -> Column:
        return F.coalesce(acc["fault"], F.when(~acc["state"].isin(*template.ends), acc["at"]))

    return F.aggregate(roles, begin, step, close)


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, segments, formatted, first_fault) from rows of (conv_id, turn, role, text).

    ``segments`` is an array of (text, loss); ``formatted`` joins their texts.
    """
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t")
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments_of(t: Column) -> Column:
        opening = F.concat(F.lit(template.before_role), escape_role(t["role"]), F.lit(template.after_role))
        parts = ((opening, F.lit(False)), (escape(t["text"]), t["role"].isin(*template.learned)), (F.lit(template.after_text), F.lit(False)))
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts))

    roles = F.transform("turns", lambda t: t["role"])
    return chats.select("conv_id", F.flatten(F.transform("turns", segments_of)).alias("segments"), first_fault(roles, template).alias("first_fault")).select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "first_fault"
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The (role, text) turns of a formatted conversation."""
    pieces = F.split(formatted, _quoted(template.after_text), -1)
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, len(template.before_role) + 1, F.char_length(p)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, template.after_role, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, F.char_length(role) + len(template.after_role) + 1, F.char_length(p))).alias("text"))

    return F.transform(bodies, turn)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|<>" else c for c in text)


def digest(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """What is read back from the output: turns, learned text, and their digests."""
    back = formatted.select("conv_id", "formatted", "first_fault", read_turns(F.col("formatted"), template).alias("turns"), learned_text(F.col("segments")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"), F.col("first_fault").isNull().alias("in_order"),
    )
