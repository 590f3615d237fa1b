"""Chat formatting by event-sourced reconstruction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

#: Templates of rendering: (before a message, after it, at the end).
TEMPLATES = {"chatml": ("<|im_start|>{role}\n", "<|im_end|>\n", ""), "plain": ("{role}: ", "\n\n", "")}


class Fold:
    """The state of one conversation: messages in order, folded from events.

    create: a new message with its first text. delta: text goes onto the message. edit: the text replaces the message's; what
    came after a user's edited message is void, as in a chat client. regenerate: the message is emptied to be streamed again,
    and what came after it is void. delete: the message goes. Events for a message that isn't there: create, delta
    and edit begin it, at the end; the others do nothing. Unknown kinds do nothing.
    """

    def __init__(self) -> None:
        self.messages: dict[str, list] = {}

    def apply(self, kind: str | None, message: str, role: str | None, text: str | None) -> None:
        m = self.messages.get(message)
        if kind == "delete":
            self.messages.pop(message, None)
        elif kind == "regenerate":
            if m:
                m[1] = []
                self.void_after(message)
        elif kind in ("create", "delta", "edit"):
            if m is None or kind == "create" and m is not None and not m[1]:
                self.messages[message] = m = m or [role or "user", []]
                if role:
                    m[0] = role
            elif kind in ("create", "edit"):
                m[1] = []
                if m[0] == "user":
                    self.void_after(message)
            m[1].append(text or "")

    def void_after(self, message: str) -> None:
        names = [*self.messages]
        for x in names[names.index(message) + 1 :]:
            del self.messages[x]

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


_MARKS = re.compile(r"<\|(?=im_start\|>|im_end\|>)")
_BLANK_LINE = re.compile(r"\n(?=\n)")


def render(messages: list[tuple[str, str]], template: str = "chatml", generation_prompt: bool = False) -> str:
    """The conversation's text. Nothing in a message forges a turn: the template's own marks, in a text or a role, are broken by a
    blank (in the plain template the marks are blank lines), and a role's line ends and colons become blanks."""
    before, after, end = TEMPLATES[template]
    safe = (lambda t: _MARKS.sub("<| ", t)) if template == "chatml" else (lambda t: _BLANK_LINE.sub("\n ", t).removesuffix("\n"))
    name = lambda r: safe(re.sub(r"[\n\r:]", " ", r))
    text = "".join(before.format(role=name(r)) + safe(t) + after for r, t in messages)
    return text + (before.format(role="assistant") if generation_prompt else "") + end


def reconstruct(events: DataFrame, *, template: str = "chatml") -> DataFrame:
    """(conv_id, n_messages, last_role, rendered) from events (conv_id, seq, message_id, kind, role, text).

    The log is partitioned by conversation, sorted by sequence, and folded as it streams by: of a conversation only its messages
    are held, not its events. Rows of the same seq come in the order of message_id, kind and text; an event that repeats exactly, with
    its seq, counts once. Null conv_id or message_id: a conversation, or message, of its own. Null seq: before all others. Null
    role: 'user'. Null text: ''. A conversation all of whose messages are deleted: no messages and an empty text. Empty table:
    no row. Other columns of ``events`` aren't read.
    """
    order = ["seq", "message_id", "kind", "role", "text"]
    e = events.select(col("conv_id"), col("seq"), col("message_id").cast("string").alias("message_id"), *[col(x).cast("string").alias(x) for x in order[2:]])
    kind_of_id = e.schema["conv_id"].dataType
    out = T.StructType([T.StructField("conv_id", kind_of_id), T.StructField("n_messages", T.LongType()), T.StructField("last_role", T.StringType()), T.StructField("rendered", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, now, last, state, arrow = False, None, None, Fold(), None

        def rows(done: list) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["conv_id", "n_messages", "last_role", "rendered"])

        def close() -> tuple:
            m = state.final()
            return now, len(m), m[-1][0] if m else None, render(m, template)

        for batch in batches:
            arrow, done = batch.column(0).type, []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not began or row[0] != now:
                    if began:
                        done.append(close())
                    began, now, last, state = True, row[0], None, Fold()
                if row != last:
                    state.apply(row[3], row[2], row[4], row[5])
                last = row
            if done:
                yield rows(done)
        if began:
            yield rows([close()])

    return e.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, out)


def as_log(turns: DataFrame, *, delta_chars: int = 64, revised: bool = False) -> DataFrame:
    """The events of a table (conv_id, turn, role, text), as a server would have streamed them: a message is created, then grows
    by deltas of ``delta_chars`` characters. seq orders them by turn and place; texts stay whole. A null turn comes first. Different rows
    of one turn are messages of their own, by role and text; a row that repeats counts once.

    With ``revised`` the log also has what came to nothing, and folding must undo it: users' messages of odd turns begin as the
    reversed text, are replied to, and edited; assistants' messages are streamed reversed, followed up, and generated again; of all
    other messages a copy is created and deleted.
    """
    t = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tie", F.dense_rank().over(W.partitionBy("conv_id", "turn").orderBy("role", "text")))
    none, own = F.lit(None).cast("string"), F.concat_ws(".", "turn", "tie")
    event = lambda kind, role, text, ident=own: F.struct(ident.alias("message_id"), kind.alias("kind"), role.alias("role"), text.alias("text"))

    def stream(text: Column, first: str) -> Column:
        n = F.greatest(F.ceil(F.length(text) / delta_chars), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: event(F.when(j == 0, first).otherwise("delta"), F.col("role"), F.substr(text, j * delta_chars + 1, F.lit(delta_chars))))

    text, role, other = F.col("text"), F.col("role"), F.concat(own, F.lit(".x"))
    events = stream(text, "create")
    if revised:
        lit = F.lit
        edited = F.array(event(lit("create"), role, F.reverse(text)), event(lit("create"), lit("assistant"), text, other), event(lit("delta"), none, text, other), event(lit("edit"), none, text))
        again = F.concat(stream(F.reverse(text), "create"), F.array(event(lit("create"), lit("user"), text, other), event(lit("regenerate"), none, none)), stream(text, "delta"))
        gone = F.concat(events, F.array(event(lit("create"), role, text, other), event(lit("delete"), none, none, other)))
        events = F.when((role == "user") & (F.col("turn") % 2 == 1), edited).when(role == "assistant", again).otherwise(gone)
    t = t.select("conv_id", "turn", "tie", F.posexplode(events).alias("j", "e"))
    return t.select("conv_id", F.struct("turn", "tie", "j").alias("seq"), "e.message_id", "e.kind", "e.role", "e.text")
