"""Chat formatting from an event log.

The log has one row per event of a conversation: a message is opened with its
role, its text arrives as deltas, later events edit it, regenerate it or take
it back. Events are dealt by conversation and message, sorted by sequence, and
folded one message at a time; messages are then rendered as segments of the
conversation's formatted text, each with its span under the loss mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The template of a turn, and strings that models use as control.
BEGIN, ROLE, ROLE_END, END = "<s>", "[ROLE]", "[/ROLE]", "</s>"
CONTROLS = [BEGIN, END, ROLE, ROLE_END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|endoftext|>"]
ESCAPE = "\\"
#: Kinds of events: a new message, more of its text, its text replaced, its
#: text begun anew, the message taken back.
OPEN, DELTA, EDIT, REGENERATE, RETRACT = "open", "delta", "edit", "regenerate", "retract"
EVENT_COLUMNS = ["conv_id", "message_id", "seq", "kind", "role", "text"]


def escape(text: str) -> str:
    """Doubles the escape character and puts one behind the first character of
    each control string, so that none is left and all can be restored."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROLS:
        if c in text:
            text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, i = [], 0
    while (j := text.find(ESCAPE, i)) >= 0:
        out.append(text[i:j])
        out.append(text[j + 1:j + 2])
        i = j + 2
    return "".join(out) + text[i:]


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where its text begins and ends in it."""
    head = BEGIN + ROLE + escape(role) + ROLE_END
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(segment: str) -> tuple[str, str]:
    """The role and the text of a segment."""
    head, _, rest = segment.removeprefix(BEGIN + ROLE).partition(ROLE_END)
    return unescape(head), unescape(rest[:rest.rindex(END)])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by message and sequence to messages. Holds one message.

    A message takes its place from its first event. Deltas add text; an edit
    replaces it; a regeneration drops it, and the following deltas begin it
    anew; a retraction takes the message back until it is opened again. The
    first role that is not null counts until the message is opened again."""
    at, seq, role, text, alive = None, None, None, [], False
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        rows = {n: [r[i] for r in done] for i, n in enumerate(("conv_id", "message_id", "seq", "role", "text"))}
        done.clear()
        return pa.RecordBatch.from_pydict({
            "conv_id": pa.array(rows["conv_id"], pa.int64()), "message_id": pa.array(rows["message_id"], pa.string()),
            "seq": pa.array(rows["seq"], pa.int64()), "role": pa.array(rows["role"], pa.string()),
            "text": pa.array(rows["text"], pa.string())})

    def close() -> None:
        if at is not None and alive:
            done.append((*at, seq, role or "", "".join(text)))

    for batch in batches:
        for conv, message, s, kind, r, t in zip(*(batch.column(c).to_pylist() for c in EVENT_COLUMNS)):
            if at != (conv, message):
                close()
                at, seq, role, text, alive = (conv, message), s, None, [], False
            if kind == RETRACT:
                alive, text = False, []
                continue
            if kind == OPEN:
                if not alive:
                    role, text = None, []
                alive = True
            elif kind in (EDIT, REGENERATE):
                text, alive = [], True
            else:
                alive = True
            role = r if role is None else role
            if t:
                text.append(t)
        if done:
            yield flush()
    close()
    if done:
        yield flush()


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id, message_id, seq, kind, role, text`` to one row per message
    that is left: ``conv_id, message_id, seq, role, text``. Messages, not
    conversations, are the unit, so a conversation of very many messages is
    folded by many tasks. Events of equal sequence go by kind (opening first),
    then role and text; a null text is empty."""
    rank = F.when(F.col("kind") == OPEN, 0).otherwise(1)
    rows = events.select(*EVENT_COLUMNS, rank.alias("rank"))
    dealt = rows.repartition("conv_id", "message_id").sortWithinPartitions(
        "conv_id", "message_id", "seq", "rank", "kind", "role", "text")
    return dealt.select(*EVENT_COLUMNS).mapInArrow(_fold, "conv_id long, message_id string, seq long, role string, text string")


def _render(trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = (batch.column(c).to_pylist() for c in ("role", "text"))
            out = [render(r or "", t or "") for r, t in zip(roles, texts)]
            spans = [(a, b) if r == trained else (0, 0) for r, (_, a, b) in zip(roles, out)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "seq", "message_id")), pa.array([x[0] for x in out], pa.string()),
                 pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32()),
                 pa.array([r == trained for r in roles], pa.bool_())],
                names=["conv_id", "seq", "message_id", "segment", "loss_start", "loss_stop", "trained"])
    return run


def format_chats(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """Messages to segments: ``conv_id, seq, message_id, segment, loss_start,
    loss_stop, trained``. A conversation's formatted text is its segments in
    the order of ``seq`` and ``message_id``; the loss mask of a segment is
    ``[loss_start, loss_stop)``, the escaped text of a ``trained`` turn."""
    return messages.mapInArrow(_render(trained), "conv_id long, seq long, message_id string, segment string, "
                                                 "loss_start int, loss_stop int, trained boolean")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments to digests; holds one segment and two running hashes."""
    at, turns, loss, n, chars, size = None, None, None, 0, 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "conv_id": pa.array([at[0]], pa.int64()), "n_turns": pa.array([n], pa.int64()),
            "turns_sha256": [turns.hexdigest()], "loss_chars": pa.array([chars], pa.int64()),
            "loss_sha256": [loss.hexdigest()], "formatted_chars": pa.array([size], pa.int64())})

    for batch in batches:
        out = []
        for conv, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_stop"))):
            if at != (conv,):
                if at is not None:
                    out.append(row())
                at, turns, loss, n, chars, size = (conv,), sha256(), sha256(), 0, 0, 0
            role, text = parse(segment)
            masked = unescape(segment[a:b])
            turns.update(f"{role}\n{text}\n".encode())
            loss.update(masked.encode())
            n, chars, size = n + 1, chars + len(masked), size + len(segment)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if at is not None:
        yield row()


def read_back(segments: DataFrame) -> DataFrame:
    """Segments parsed again, one row per conversation: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``. The digest of a
    conversation runs over its turns in order, so one task streams through
    each conversation; it holds a segment at a time."""
    dealt = segments.select("conv_id", "seq", "message_id", "segment", "loss_start", "loss_stop")
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message_id")
    return dealt.select("conv_id", "segment", "loss_start", "loss_stop").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns (``conv_id, turn, role, text``) as a log:
    each turn opens a message and streams its text.

    Turns of a null ``conv_id`` are one conversation. Rows of one conversation
    that share a turn are messages of their own, in the order of role and
    text; rows that are equal in all four columns are as many messages. Null
    roles and texts are empty; a null turn comes first."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2 ** 62))).alias("seq"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "seq").orderBy("role", "text"))
    rows = rows.withColumn("message_id", F.lpad(nth.cast("string"), 12, "0"))
    none = F.lit(None).cast("string")
    opened = F.struct(F.lit(OPEN).alias("kind"), F.col("role").alias("role"), none.alias("text"))
    streamed = F.struct(F.lit(DELTA).alias("kind"), none.alias("role"), F.col("text").alias("text"))
    events = rows.select("conv_id", F.concat_ws(" ", "seq", "message_id").alias("message_id"), "seq",
                         F.explode(F.array(opened, streamed)).alias("e"))
    return events.select("conv_id", "message_id", "seq", "e.kind", "e.role", "e.text")
