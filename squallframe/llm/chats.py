"""Chat formatting: a template is a black box; spans of turns come from rendering growing prefixes."""
from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """A backslash goes between < and | (and after the ones already there), so no control string is left."""
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def marked(turns: list[Turn]) -> str:
    """The default template: each turn between control strings, its role on the first line."""
    return "".join(f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of ``marked``; anything else in it is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def added(before: str, after: str) -> tuple[str, int]:
    """What a longer prefix adds, and how many characters of the shorter one's output it changed."""
    if after.startswith(before):
        return after[len(before) :], 0
    same = len(os.path.commonprefix([before, after]))
    return after[same:], len(before) - same


def locate(template: Template, history: list[Turn], turn: Turn, before: str | None = None, after: str | None = None) -> tuple[str, int, int, int]:
    """(piece, text start, text end, characters rewritten) of a turn after a history.

    ``before`` and ``after`` are the outputs without and with the turn, where they are known.
    Two more outputs, with the texts ``a`` and ``b``, show what stands around the text whatever it is.  A template that
    shows no text gets an empty span.
    """
    before = template(history) if before is None else before
    piece, rewritten = added(before, template([*history, turn]) if after is None else after)
    a, _ = added(before, template([*history, (turn[0], "a")]))
    b, _ = added(before, template([*history, (turn[0], "b")]))
    head = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
    if a == b or head + tail > len(piece):
        return piece, 0, 0, rewritten
    return piece, head, len(piece) - tail, rewritten


FORMATTED = "conv_id long, place long, role string, piece string, start long, text_start long, text_end long, rewritten long"


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def format_chats(rows: DataFrame, template: Template = marked, history: int | None = None) -> DataFrame:
    """A row per turn, in order: its piece of the output and where that starts, the text's span in the output, and
    how many characters of the earlier output this turn rewrote.

    ``rows`` has conv_id, turn, role, text; more columns are not looked at.  Turns go by number (null first), ties by role and
    text; null roles and texts are empty; null ids are one conversation; repeated rows are turns of their own.  The output
    of a conversation is the pieces joined, as long as no turn rewrites anything; a piece that rewrites starts where the
    outputs part, and what stands before the first turn is of its piece.

    Each prefix of a conversation is rendered whole and compared with the output before, whatever the template does; work grows with
    the square of a conversation's length, and one conversation at a time is held.  A caller who knows that a template formats a
    turn by at most ``history`` earlier ones can say so: it is then rendered after those alone, and conversations stream.
    """
    schema = schema_of(FORMATTED)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, past, place, start, before = object(), deque(maxlen=history), 0, 0, ""
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != own:
                    own, place, start, before = conv, 0, 0, ""
                    past.clear()
                turn = (role or "", text or "")
                after = template([*past, turn])
                piece, head, tail, rewritten = locate(template, list(past), turn, before, after)
                if history is None:
                    start = len(before) - rewritten
                before = after if history is None else None
                out.append((conv, place, turn[0], piece, start, start + head, start + tail, rewritten))
                past.append(turn)
                place, start = place + 1, start + len(piece)
            columns = zip(*out) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(render, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(pieces: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row per conversation, read back from the output of ``format_chats`` in its own partitions and order.

    The digests go on from piece to piece, so no conversation is held whole.  The loss mask is the span of the texts of
    ``loss_role``.
    """
    schema = schema_of(DIGEST)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None

        def row():
            n, turns, loss_chars, loss, chars = state
            return own, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            out = []
            names = ("conv_id", "place", "piece", "start", "text_start", "text_end")
            for conv, place, piece, start, lo, hi in zip(*(batch.column(c).to_pylist() for c in names)):
                if place == 0:
                    if state:
                        out.append(row())
                    own, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == loss_role:
                        masked = unescape(piece[lo - start : hi - start])
                        state[2] += len(masked)
                        state[3].update(masked.encode())
                state[4] += len(piece)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(), schema)], schema=schema)

    return pieces.select("conv_id", "place", "piece", "start", "text_start", "text_end").mapInArrow(read, DIGEST)
