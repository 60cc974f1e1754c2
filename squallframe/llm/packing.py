"""Packing documents into fixed windows by minimum bin slack."""
from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallframe.llm.chats import schema_of
from squallframe.llm.common import number_rows, short_batches
from squallframe.session import settle

PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long"
SPACES = re.compile(r"\s\s")
SPECIAL = "<|endoftext|>"
HELD = 1 << 18  # tokens that a task holds before it hands pieces on


class Encoder:
    """Token ids of the byte-level vocabulary, the same as its tokenizer file gives without added tokens.

    The vocabulary as ranks encodes several times faster.  Its pattern's look-ahead only matters where two white-space
    characters meet, so other texts go without.  A text that holds the special token's string goes to the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=table, special_tokens={})
        self.tokenizer, self.exact = tokenizer, None

    def __call__(self, text: str) -> list[int]:
        if SPECIAL in text:
            if self.exact is None:  # few texts need it
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.tokenizer)
            return self.exact.encode(text, add_special_tokens=False).ids
        return (self.full if SPACES.search(text) else self.plain).encode_ordinary(text)


def public_encoder() -> Encoder:
    import public_tokenizers as P

    return Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def pieces(docs: DataFrame, key: str, text: str, encoder=public_encoder, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Each document's ids, closed by ``end_id``, cut at multiples of the window: (key, start, length, ids_crc32, doc_tokens).

    A null or empty text gives the end id alone.  ``keep_ids`` adds the ids themselves.  Repeated rows give pieces of their own, null keys
    stay, an empty table gives an empty result; keys have to be whole numbers, and other columns are not looked at.  A text is
    encoded whole, one at a time, and its pieces are handed on as they come, so a very long one takes the memory of its ids.
    """
    ddl = PIECES
    schema = schema_of(ddl)
    if keep_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(list(zip(*rows))[: len(PIECES.split(", "))], schema)]
        if keep_ids:  # one flat array and where each piece ends in it
            parts = [r[-1] for r in rows]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int32())))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        held, tokens = [], 0
        for batch in batches:
            for k, body in zip(batch.column(0), batch.column(1)):
                ids = encode(body.as_py() or "")
                ids.append(end_id)
                ids = np.array(ids, dtype="<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    held.append((k.as_py(), start, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32) if keep_ids else None))
                    tokens += len(part)
                    if tokens >= HELD:
                        yield made(held)
                        held, tokens = [], 0
        if held:
            yield made(held)

    return short_batches(docs).select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, ddl)


@dataclass(frozen=True)
class Pattern:
    """``times`` windows, each filled with the same multiset of lengths."""

    times: int
    content: dict[int, int]  # length -> how many


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the given lengths, each at most as often as counted, whose sum comes closest to ``room``.

    Bit s of ``reach`` says that the sum s can be made.  Lengths join from the longest down, by powers of two of their
    count; the reach before each step is kept, and walking back over the steps tells what was used.
    """
    reach, steps, wanted, full = 1, [], (1 << room), (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach & wanted:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= (reach << (length * part)) & full
            left, part = left - part, part * 2
        if reach & wanted:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not (before >> total) & 1:
            used[length] = used.get(length, 0) + part
            total -= length * part
    return used


def plan(histogram: dict[int, int], window: int) -> list[Pattern]:
    """Patterns that use up the histogram of lengths: minimum bin slack.

    The longest length left opens a window, ``fill`` finds the best company, and the pattern repeats as often as the counts
    allow.  Work depends on the number of different lengths, at most the window, and not on how many pieces there are.
    """
    counts, out = {k: n for k, n in histogram.items() if n}, []
    while counts:
        first = max(counts)
        counts[first] -= 1
        content = fill({k: n for k, n in counts.items() if n}, window - first)
        counts[first] += 1
        content[first] = content.get(first, 0) + 1
        times = min(counts[k] // n for k, n in content.items())
        for k, n in content.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append(Pattern(times, content))
    return out


def seats(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length the stretches of its pieces by number: columns first piece, first window, pieces a window, offset."""
    taken, window, out = {}, 0, {}
    for p in patterns:
        offset = 0
        for length in sorted(p.content, reverse=True):
            n = p.content[length]
            out.setdefault(length, []).append((taken.get(length, 0), window, n, offset))
            taken[length] = taken.get(length, 0) + n * p.times
            offset += n * length
        window += p.times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(cut: DataFrame, window: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces with the columns of ``pieces``.

    Equal pieces (repeated rows) get places of their own, and an empty table gives an empty result.  Columns beside those of ``pieces``
    and ``ids`` go along, but for ``__number``, sequence_id and offset, which are replaced.

    Pieces are numbered within their length; only the histogram of lengths, at most ``window`` numbers, comes to the driver,
    and the seats it plans go back.  Every piece then finds its window by its number alone, whatever the length of the list.
    """
    cut = settle(cut.drop("__number", "sequence_id", "offset"))
    numbered = number_rows(cut, ["length"], ["key", "start", "ids_crc32", "doc_tokens"], "__number")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = seats(plan(histogram, window))
    names = [c for c in numbered.columns if c != "__number"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (batch.column(c).to_numpy() for c in ("length", "__number"))
            seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = lengths == length
                first, win, per, off = places[int(length)][np.searchsorted(places[int(length)][:, 0], numbers[at], "right") - 1].T
                seq[at] = win + (numbers[at] - first) // per
                offset[at] = off + (numbers[at] - first) % per * length
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name in names)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, used): whole windows from packed pieces that kept their ids; a group holds one window at most.

    A window is padded to its full length unless what it holds is a power of two long.
    """
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    out = parts.select("sequence_id", ids.alias("ids")).withColumn("used", F.size("ids"))
    pad = F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, 0).otherwise(F.lit(window) - F.col("used"))
    return out.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), pad.cast("int"))))
