"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings round a turn, the roles under the loss, and the turns that may follow one another.

    Texts may not hold the opening two characters "<|" of control strings:
    where one holds "<", some backslashes and "|", one backslash more goes in.
    Backslashes and line ends of a role are written as two characters.
    """

    begin: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    follows: tuple[tuple[str, str], ...] = (("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))


def escape(text: Column) -> Column:
    """text without "<|", reversibly."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """What escape() was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation of turns (conv_id long, turn long, role string, text string).

    conv_id; segments, in order, of text and whether the loss counts it, whose
    texts joined are the formatted conversation; formatted; valid: whether the
    roles follow one another as the template says and end under the loss;
    broken: position (from 0) of the first turn that may not follow, or null.

    Turns are ordered by turn, null first, then role and text, so repeated
    rows stand side by side and ties are settled. A null role or text is
    empty. Rows with a null conv_id are one conversation. Nothing is dropped:
    a conversation out of order is formatted and marked. An empty table gives
    an empty one; other columns aren't read.
    """
    t = template or Template()
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    may = F.array(*(F.lit(f"{a}\n{b}") for a, b in t.follows))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.begin), _role_out(x["role"]), F.lit(t.middle))
        piece = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(escape(x["text"]), x["role"].isin(*t.loss)), piece(F.lit(t.end), F.lit(False)))

    before = F.concat(F.array(F.lit("")), F.transform("turns", lambda x: x["role"]))
    steps = F.transform("turns", lambda x, i: F.when(~F.array_contains(may, F.concat(F.get(before, i), F.lit("\n"), x["role"])), i))
    made = chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), F.array_min(steps).alias("broken"), F.element_at("turns", -1)["role"].isin(*t.loss).alias("_ended"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), (F.col("broken").isNull() & F.col("_ended")).alias("valid"), "broken")


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) parsed back from the formatted strings alone."""
    t = template or Template()
    quoted = [f"\\Q{x}\\E" for x in (t.begin, t.middle, t.end)]
    pattern = f"(?s){quoted[0]}(.*?){quoted[1]}(.*?){quoted[2]}"
    roles, texts = (F.regexp_extract_all("formatted", F.lit(pattern), F.lit(i)) for i in (1, 2))
    return formatted.select("conv_id", F.arrays_zip(F.transform(roles, _role_in).alias("role"), F.transform(texts, unescape).alias("text")).alias("turns"))


def chat_digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, broken), read back from the output of format_chats."""
    t = template or Template()
    made = format_chats(turns, t)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    quoted = [f"\\Q{x}\\E" for x in (t.begin, t.middle, t.end)]
    pattern = f"(?s){quoted[0]}(.*?){quoted[1]}(.*?){quoted[2]}"
    roles, texts = (F.regexp_extract_all("formatted", F.lit(pattern), F.lit(i)) for i in (1, 2))
    back = F.arrays_zip(F.transform(roles, _role_in).alias("role"), F.transform(texts, unescape).alias("text"))
    whole = F.array_join(F.transform(back, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = made.select("conv_id", F.size(roles).cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "broken")
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid", "broken")
