"""Chat formatting with a grammar round trip.

Each turn is rendered, read again by a deterministic parser and compared with its source.  Where a text
holds a control string, its occurrences are escaped and the turn is rendered again, until what is read
is what was written.

Grammar of a rendered conversation (one segment per turn, nothing between)::

    user       "[INST] " text " [/INST]"
    assistant  " " text " </s>"
    others     "[ROLE] " role " [TEXT] " text " [/ROLE]"

A control string after one or more backslashes is text; one of the backslashes is the escape.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

#: The control strings of the template.
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[TEXT]"]
CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a turn, and start and length of its text in it."""
    if role == "user":
        head, tail = "[INST] ", " [/INST]"
    elif role == "assistant":
        head, tail = " ", " </s>"
    else:
        head, tail = f"[ROLE] {role} [TEXT] ", " [/ROLE]"
    return head + text + tail, len(head), len(text)


class Unreadable(ValueError):
    pass


def _field(segment: str, at: int, closer: str) -> tuple[str, int]:
    """Text from ``at`` to the first real control string, which must be ``closer`` after a space."""
    out = []
    for m in CONTROL.finditer(segment, at):
        if m[1]:
            out += [segment[at:m.start()], m[1][1:], m[2]]
            at = m.end()
            continue
        if m[2] != closer or m.start() <= at - 1 or segment[m.start() - 1] != " ":
            raise Unreadable(f"{m[2]} at {m.start()}")
        out.append(segment[at:m.start() - 1])
        return "".join(out), m.end()
    raise Unreadable("no end")


def parse(rendered: str, at: int = 0) -> tuple[str, str, int]:
    """(role, text, position after the turn) of the turn that begins at ``at``."""
    if rendered.startswith("[INST] ", at):
        text, end = _field(rendered, at + 7, "[/INST]")
        return "user", text, end
    if rendered.startswith("[ROLE] ", at):
        role, end = _field(rendered, at + 7, "[TEXT]")
        if rendered[end:end + 1] != " ":
            raise Unreadable("no space")
        text, end = _field(rendered, end + 1, "[/ROLE]")
        return role, text, end
    if rendered.startswith(" ", at):
        text, end = _field(rendered, at + 1, "</s>")
        return "assistant", text, end
    raise Unreadable("no turn begins here")


def parse_all(rendered: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(rendered):
        role, text, at = parse(rendered, at)
        out.append((role, text))
    return out


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """Render, reparse and compare; escape what conflicts until both are identical."""
    raw = (role, text)
    for attempt in (lambda x: x, escape):
        own_role = attempt(role)
        segment = render(own_role if own_role not in ("user", "assistant") else role, attempt(text))
        try:
            *read, end = parse(segment[0])
        except Unreadable:
            continue
        if tuple(read) == raw and end == len(segment[0]):
            return segment
    raise Unreadable(f"turn of {role!r} does not survive the round trip")


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv, turn, segment, loss_start, loss_length``.

    A conversation is the segments of its turns in order, nothing between.  The loss mask covers the text
    of assistant turns: ``loss_length`` code points of the segment from ``loss_start`` (length 0 in others).
    A null role or text is empty, and a role named in the grammar is taken as such.  Repeated rows are
    turns of their own; an empty table gives no rows; other columns are not read.
    """
    source = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                       F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches):
        for batch in batches:
            rows = [(s, start, length if r == "assistant" else 0) for r, (s, start, length) in
                    ((r.as_py(), format_turn(r.as_py(), t.as_py())) for r, t in zip(batch.column("role"), batch.column("text")))]
            segment, start, length = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("turn"), pa.array(segment, pa.string()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64())], [conv, turn, "segment", "loss_start", "loss_length"])

    return map_batches(source, run, f"`{conv}` {types['conv']}, `{turn}` {types['turn']}, segment string, "
                                    "loss_start long, loss_length long")


def rendered_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation with its whole text, for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(f"`{turn}`").alias("turn"), "segment")))
    return (turns.groupBy(conv).agg(parts.alias("parts"))
            .select(conv, F.concat_ws("", F.transform("parts", lambda x: x["segment"])).alias("rendered")))


def read_back(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Digests per conversation, read from its segments by the parser.

    Returns ``conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.  The rows of a conversation
    pass in order through a digest that is carried on, so none of them is held in memory as a whole.
    Rows of the same turn go by their segments.
    """
    kind = turns.schema[conv].dataType.simpleString()
    ordered = (turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), "segment", "loss_start", "loss_length")
               .repartition("conv").sortWithinPartitions("conv", "turn", "segment"))

    def run(batches):
        out, current, state = [], None, None

        def flush():
            if state:
                n, all_text, chars, loss, formatted = state
                out.append((current, n, all_text.hexdigest(), chars, loss.hexdigest(), formatted))

        def batch_of():
            columns = list(zip(*out)) or [()] * 6
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            out.clear()
            return done

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for own, segment, start, length in zip(*(batch.column(c).to_pylist() for c in ("conv", "segment", "loss_start", "loss_length"))):
                if state is None or own != current:
                    flush()
                    current, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, _ = parse(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if length or role == "assistant":
                    masked, _ = _field(segment[start:start + length] + " </s>", 0, "</s>")
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(segment)
            yield batch_of()
        flush()
        if out:
            yield batch_of()

    return map_batches(ordered, run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
