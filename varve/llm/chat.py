"""Chat formatting with DataFrame functions only: a role machine, a declarative template, segments and loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles bear loss, and which role may follow which.

    A turn is ``open`` role ``middle`` text ``close``. The strings in ``controls`` (with the marks) are escaped inside
    texts and roles: "~" becomes "~0" and the k-th control string "~k", so that no control string is left and
    ``unescape`` gives the text back. ``follow`` maps a state (the last role, "" at the start) to allowed roles.
    """

    open: str = "<s>[TURN] "
    middle: str = " [/TURN]\n"
    close: str = "</s>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    follow: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.controls) > 9 or any("~" in c or not c for c in self.controls):
            raise ValueError("at most nine control strings, none empty or with ~")
        if not any(c in self.open for c in self.controls) or not any(c in self.close for c in self.controls) or not any(c in self.middle for c in self.controls):
            raise ValueError("each mark of a turn must hold a control string")


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for k, control in enumerate(template.controls, 1):
        out = F.replace(out, F.lit(control), F.lit(f"~{k}"))
    return out


def unescape(text: Column, template: Template) -> Column:
    out = text
    for k, control in reversed(list(enumerate(template.controls, 1))):
        out = F.replace(out, F.lit(f"~{k}"), F.lit(control))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def format_chats(turns: DataFrame, template: Template | None = None, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: key, formatted, segments (array of role, part, text as written, loss; in order), n_turns, valid_order.

    A turn is three segments: the mark before its text ("open"), its "text", and the mark after it ("close"). Only texts of
    loss roles bear loss. Turns go by turn number; ties by role, then text; a null turn goes first. Null texts and roles are empty.
    Repeated rows are turns of their own. Rows with a null key form one conversation. ``valid_order`` is the verdict
    of the role machine: every role allowed after the one before, the last one in ``template.last``. No row is dropped.
    A conversation is one row of the result, so its turns meet in one task; there is no other grouping.
    """
    t = template or Template()
    rows = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    part = lambda x, name, text, loss: F.struct(x["role"].alias("role"), F.lit(name).alias("part"), text.alias("text"), loss.alias("loss"))
    segment = lambda x: F.array(
        part(x, "open", F.concat(F.lit(t.open), escape(x["role"], t), F.lit(t.middle)), F.lit(False)),
        part(x, "text", escape(x["text"], t), x["role"].isin(*t.loss_roles)),
        part(x, "close", F.lit(t.close), F.lit(False)),
    )
    moves = F.array(*[F.lit(f"{a}\0{b}") for a, after in t.follow.items() for b in after])
    start = F.struct(F.lit("").alias("state"), F.lit(True).alias("ok"))
    end = F.aggregate("turns", start, lambda s, x: F.struct(x["role"].alias("state"), (s["ok"] & F.array_contains(moves, F.concat(s["state"], F.lit("\0"), x["role"]))).alias("ok")))
    rows = rows.select("key", F.flatten(F.transform("turns", segment)).alias("segments"), end.alias("end"), F.size("turns").cast("long").alias("n_turns"))
    return rows.select(
        F.col("key").alias(key),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        "n_turns",
        (F.col("end.ok") & F.col("end.state").isin(*t.last)).alias("valid_order"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: array of (role, text, loss), unescaped."""
    t = template or Template()
    parts = F.filter(F.split(formatted, f"\\Q{t.open}\\E"), lambda x: x != "")
    role = lambda x: unescape(F.substring_index(x, t.middle, 1), t)
    first = lambda x: F.char_length(F.substring_index(x, t.middle, 1)) + F.lit(len(t.middle) + 1)
    body = lambda x: F.substr(x, first(x), F.char_length(x) - first(x) + F.lit(1 - len(t.close)))
    return F.transform(parts, lambda x: F.struct(role(x).alias("role"), unescape(body(x), t).alias("text"), role(x).isin(*t.loss_roles).alias("loss")))
