"""Removal of word sequences that occur more than once: count-min sketches choose the windows that are grouped exactly."""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallframe.session import settle

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))  # odd, so they can be undone modulo 2^64
INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in BASES)
ROWS = 2
SLICE_BITS = 20


class Powers:
    """Powers of both bases and of their inverses, as far as any text so far has needed them."""

    def __init__(self):
        self.up, self.down = [np.ones(1, U)] * 2, [np.ones(1, U)] * 2

    def reach(self, n: int):
        if len(self.up[0]) < n:
            n = max(n, 2 * len(self.up[0]))
            for r in range(2):
                self.up[r] = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, BASES[r])]), dtype=U)
                self.down[r] = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, INVERSES[r])]), dtype=U)
        return self


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rolling(sums: np.ndarray, size: int, down: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``size`` words from the running sums: equal runs, equal hashes, wherever they stand."""
    return (sums[size:] - sums[:-size]) * down[: len(sums) - size]


def sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over all runs of ``size``, by doubling."""
    n, have = len(x) - size + 1, 1
    while 2 * have <= size:
        x, have = pick(x[:-have], x[have:]), 2 * have
    return pick(x[:n], x[size - have : size - have + n])


@dataclass(frozen=True)
class Windows:
    """How texts become windows, and windows become cells of the sketch.

    A window's anchor is the least hash among its runs of ``gram`` words.  Windows of equal words have equal anchors, at
    as many places of the corpus as the windows stand, so a count of anchor places never lies below the count of a window, and there are
    only about two anchors for each ``window - gram + 2`` words to be counted.
    """

    window: int = 35
    gram: int = 11
    cell_bits: int = 25

    def read(self, text: str | None, powers: Powers):
        """(words, running sums, hashes of grams) of a whole text; None in place of arrays if it holds no window."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        n = len(words)
        if n < self.window:
            return words, None, None
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, n)
        powers.reach(n + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(h * powers.up[0][:n], dtype=U)])
        return words, (h, sums), mixed(rolling(sums, self.gram, powers.down[0]))

    def least(self, grams: np.ndarray) -> np.ndarray:
        return sliding(grams, self.window - self.gram + 1, np.minimum)

    def anchors(self, grams: np.ndarray) -> np.ndarray:
        """Values of all places that are the anchor of some window; ties in a window all count."""
        reach = self.window - self.gram + 1
        least = self.least(grams)
        edge = np.zeros(reach - 1, U)
        return grams[sliding(np.concatenate([edge, least, edge]), reach, np.maximum) == grams]

    def cells(self, row: int, anchors: np.ndarray) -> np.ndarray:
        return (mixed(anchors + U(row)) >> U(64 - self.cell_bits)).astype(np.int64)

    def keys(self, hashed, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for the words of the windows at the given starts."""
        h, sums = hashed
        other = np.concatenate([np.zeros(1, U), np.cumsum(h * powers.up[1][: len(h)], dtype=U)])
        return rolling(sums, self.window, powers.down[0])[at].view(np.int64), rolling(other, self.window, powers.down[1])[at].view(np.int64)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def sketch(texts: DataFrame, spec: Windows) -> list[np.ndarray]:
    """For each row of the count-min sketch the bits of the cells that were counted twice or more.

    Each task counts its anchors in cells that stop at two, and sends slices of them, four cells a byte; slices of the same
    place are added up as they stream by.  The merged bits have a fixed size, ROWS x 2^cell_bits / 8 bytes, and come
    to the driver to be broadcast.  A task covers all that one core reads, so that few sketches have to be merged.
    """
    schema = pa.schema([("line", pa.int32()), ("slice", pa.int32()), ("cells", pa.binary())])
    ddl = "line int, slice int, cells binary"
    bits = min(SLICE_BITS, spec.cell_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, powers, held, n = np.zeros((ROWS, 1 << spec.cell_bits), np.uint8), Powers(), [], 0

        def flush():
            anchors = np.concatenate(held)
            for row in range(ROWS):
                at, times = np.unique(spec.cells(row, anchors), return_counts=True)
                cells[row][at] = np.minimum(2, cells[row][at] + np.minimum(times, 2)).astype(np.uint8)

        for batch in batches:
            for text in batch.column(0):
                _, _, grams = spec.read(text.as_py(), powers)
                if grams is not None:
                    held.append(spec.anchors(grams))
                    n += len(held[-1])
                    if n > 1 << 20:
                        flush()
                        held, n = [], 0
        if held:
            flush()
        for row in range(ROWS):
            for s, part in enumerate(cells[row].reshape(-1, 1 << bits)):
                if part.any():
                    quads = part.reshape(-1, 4)
                    packed = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
                    yield batch_of(schema, [row], [s], [zlib.compress(packed.tobytes(), 1)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None
        for batch in batches:
            for row, s, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (row, s) != own:
                    if own:
                        yield batch_of(schema, [own[0]], [own[1]], [np.packbits(total >= 2, bitorder="little").tobytes()])
                    own, total = (row, s), np.zeros(1 << bits, np.uint8)
                quads = np.frombuffer(zlib.decompress(packed), np.uint8)
                total = np.minimum(2, total + np.stack([quads & 3, quads >> 2 & 3, quads >> 4 & 3, quads >> 6], axis=1).ravel())
        if own:
            yield batch_of(schema, [own[0]], [own[1]], [np.packbits(total >= 2, bitorder="little").tobytes()])

    cores = texts.sparkSession.sparkContext.defaultParallelism
    parts = texts.coalesce(cores).mapInArrow(count, ddl)
    merged = parts.repartition("line", "slice").sortWithinPartitions("line", "slice").mapInArrow(merge, ddl)
    out = [np.zeros((1 << spec.cell_bits) // 8, np.uint8) for _ in range(ROWS)]
    for r in merged.toLocalIterator():
        size = (1 << bits) // 8
        out[r["line"]][r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["cells"], np.uint8)
    return out


def estimated(spec: Windows, twice: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    """Which windows of a text may stand elsewhere too: the least count over the sketch's rows is two or more."""
    least = spec.least(grams)
    may = np.ones(len(least), bool)
    for row in range(ROWS):
        at = spec.cells(row, least)
        may &= (twice[row][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return may


def remove_repeated(docs: DataFrame, key: str, text: str, window: int = 35, most_cell_bits: int = 25) -> DataFrame:
    """Every document without the words of windows that stand more than once: (key, n_words, n_removed, kept).

    A window is so many consecutive words of one document; all windows are judged on the input.  kept has the words left, joined
    by one space; a null text has no words.  Repeated rows are documents of their own, so all their windows are repeated.  Other
    columns are not looked at.

    Three passes read the texts: one fills the sketch, one sends the windows that the sketch takes for repeated to be
    grouped by 128 bits of their words, and one removes.  The second sends back only what the sketch got wrong, windows that stand
    once, under a hash of their text.  The sketch has four cells an anchor, up to 2^most_cell_bits cells a row; beyond that it
    lets more single windows through to the grouping, which stays exact.
    """
    spark = docs.sparkSession
    gram = max(1, window // 3)
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    wanted = 4 * (chars // 6) * 2 // (window - gram + 2)
    spec = Windows(window, gram, max(16, min(most_cell_bits, int(wanted).bit_length())))
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("body", F.xxhash64("text"))
    shared = spark.sparkContext.broadcast(sketch(known.select("text"), spec))
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("body", pa.int64())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, twice = Powers(), shared.value
        for batch in batches:
            held, n = [], 0
            for text, body in zip(batch.column(0), batch.column(1).to_pylist()):
                _, hashed, grams = spec.read(text.as_py(), powers)
                if grams is None:
                    continue
                at = np.flatnonzero(estimated(spec, twice, grams))
                if len(at):
                    k1, k2 = spec.keys(hashed, at, powers)
                    held.append((k1, k2, np.full(len(at), body, np.int64)))
                    n += len(at)
                if n > 1 << 17:
                    yield batch_of(schema, *map(np.concatenate, zip(*held)))
                    held, n = [], 0
            if held:
                yield batch_of(schema, *map(np.concatenate, zip(*held)))

    grouped = known.select("text", "body").mapInArrow(candidates, "k1 long, k2 long, body long").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("body"))
    single = grouped.where("n = 1").groupBy("body").agg(F.collect_list("k1").alias("single"))  # at most a text's windows
    single = settle(single)

    out_schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    kind = docs.schema[key].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, twice = Powers(), shared.value
        for batch in batches:
            rows = []
            for body, wrong in zip(batch.column(1), batch.column(2)):
                words, hashed, grams = spec.read(body.as_py(), powers)
                n = len(words)
                at = np.flatnonzero(estimated(spec, twice, grams)) if grams is not None else ()
                if len(at) and wrong.is_valid:
                    at = at[~np.isin(spec.keys(hashed, at, powers)[0], wrong.values.to_numpy())]
                if len(at):
                    steps = np.zeros(n + 1, np.int64)
                    steps[at] += 1
                    steps[at + window] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
                rows.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
            if rows:
                rest = [pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *rest], names=["key", *out_schema.names])

    joined = known.join(single, "body", "left").select("key", "text", "single")
    return joined.mapInArrow(clean, f"key {kind}, n_words long, n_removed long, kept string")

