"""Exact Jaccard links of word n-gram sets: signature trees over blocks that share a rare n-gram."""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from squallframe.llm.common import components, joined_components, short_batches
from squallframe.llm.substrings import Powers, mixed, rolling
from squallframe.session import settle

U = np.uint64
ID = pa.decimal128(38, 0)  # 126 bits of a hash of the whole set
LEAF, FAN = 32, 8
FIRST = 16  # of a set's blocks that its rows name, so that a pair is taken in one of those it shares
BLOCK = 4096  # rows of a block that are held at a time; longer ones are cut and met in pairs
HOT, SALTS = 1024, 64  # rows from which a star is met in several groups, and how many
MOST_CELLS, MOST_FLAGS = 22, 27  # bits of the places in the frequency sketch and in a filter of flags
PROBES = 4  # bits of a value in such a filter
ROLES = FOUND, STAR, LEADER, HOT_STAR = range(4)  # what a filter says of a text or star, in the lowest two bits of its hash


@dataclass(frozen=True)
class Spec:
    """Shingles of so many words; sets link when percent * union <= 100 * intersection."""

    shingle: int = 4
    percent: int = 85

    def prefix(self, n):
        """Two sets that link share one of their first so many shingles, in any order common to all."""
        return n - (self.percent * n + 99 - (self.percent * n + 99) % 100) / 100 + 1 if isinstance(n, Column) else n - -(-self.percent * n // 100) + 1

    def linked(self, both, n, m):
        return 100 * both >= self.percent * (n + m - both)


def shingles(text: bytes | None, spec: Spec, powers: Powers) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text with fewer words is one shingle, a text without words none."""
    words = (text or b"").lower().split()  # of bytes these take only A-Z and ASCII white space
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, n)
    powers.reach(n + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(h * powers.up[0][:n], dtype=U)])
    size = min(n, spec.shingle)
    tokens = mixed(rolling(sums, size, powers.down[0]) + U(spec.shingle - size))
    tokens.sort()
    return tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])]


def texts_of(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """The last column's texts as bytes."""
    return (t.as_py() for t in batch.column(batch.num_columns - 1).cast(pa.binary()))


def set_id(tokens: np.ndarray) -> bytes:
    """16 bytes, little-endian, of a number below 2^126: equal sets, equal ids."""
    return (xxhash.xxh3_128_intdigest(tokens.tobytes()) >> 2).to_bytes(16, "little")


def id_array(ids: list[bytes]) -> pa.Array:
    return pa.Array.from_buffers(ID, len(ids), [None, pa.py_buffer(b"".join(ids))])


def place(values: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    return (mixed(values + U(salt)) >> U(64 - bits)).astype(np.int64)


# --- bounded tables that go to every task


def gathered(parts: DataFrame, bits: int, dtype, add, finish, out) -> np.ndarray:
    """Merge slices (slice, cells) that tasks have sent: slices of one place are added up as they stream by, and the finished
    ones, 2^bits numbers of type ``out`` at most, make one array.  Their bound is that of the broadcast, so one job fetches them."""
    step = min(16, bits)
    schema = pa.schema([("slice", pa.int32()), ("cells", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([zlib.compress(finish(total).tobytes(), 1)])], schema=schema)

        for batch in batches:
            for s, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = np.frombuffer(zlib.decompress(packed), dtype)
                if s != own:
                    if own is not None:
                        yield row()
                    own, total = s, cells
                else:
                    total = add(total, cells)
        if own is not None:
            yield row()

    merged = np.zeros((1 << bits) if out != np.bool_ else (1 << bits) // 8, np.uint8)
    size = len(merged) >> (bits - step)
    rows = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, cells binary")
    for r in rows.collect():
        merged[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(zlib.decompress(r["cells"]), np.uint8)
    return merged


def slices(cells: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
    for s, part in enumerate(cells.reshape(count, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=["slice", "cells"])


def few_parts(df: DataFrame) -> DataFrame:
    """One task per core, so that few tables have to be merged."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def flags(values: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of at most 2^MOST_FLAGS bits for one column of longs: it lets every value through, and few others."""
    bits = max(16, min(MOST_FLAGS, (32 * rows).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for probe in range(PROBES):
                at = place(batch.column(0).to_numpy().view(U), bits, probe)
                np.bitwise_or.at(cells, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from slices(cells, 1 << (bits - 16))

    parts = few_parts(values).mapInArrow(mark, "slice int, cells binary")
    return gathered(parts, bits, np.uint8, np.bitwise_or, lambda x: x, np.bool_), bits


def flagged(table: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    hit = np.ones(len(values), bool)
    for probe in range(PROBES):
        at = place(values, bits, probe)
        hit &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def lookup(values: DataFrame, rows: int):
    """A function of a column of longs: false where the value is not in ``values``, and nearly always only there."""
    known = values.sparkSession.sparkContext.broadcast(flags(values, rows))

    @F.pandas_udf("boolean")
    def seen(value: pd.Series) -> pd.Series:
        return pd.Series(flagged(*known.value, value.to_numpy().view(U)))

    return seen


# --- passes over the texts


def each_set(batches: Iterator[pa.RecordBatch], spec: Spec, wanted=None) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """(id, hash of the text, shingles) of the non-empty sets that a task reads, the same set only once.

    ``wanted``, if given, tells from an array of text hashes which texts to look at.
    """
    powers, seen, read = Powers(), set(), set()
    for batch in batches:
        bodies = batch.column(batch.num_columns - 1).cast(pa.binary())
        hashes = np.fromiter((text_hash(t.as_py()) for t in bodies), np.int64, len(bodies))
        look = np.ones(len(hashes), bool) if wanted is None else wanted(hashes)
        for at in np.flatnonzero(look):
            if int(hashes[at]) in read:
                continue
            read.add(int(hashes[at]))
            tokens = shingles(bodies[int(at)].as_py(), spec, powers)
            if len(tokens):
                own = set_id(tokens)
                if own not in seen:
                    seen.add(own)
                    yield own, int(hashes[at]), tokens


def batched(rows: Iterator[tuple], names: list[str], arrays, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples to record batches; ``arrays`` makes a column from a list of its values."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([make(list(c)) for make, c in zip(arrays, zip(*held))], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([make(list(c)) for make, c in zip(arrays, zip(*held))], names=names)


def longs(values: list) -> pa.Array:
    return pa.array(np.concatenate(values) if values and isinstance(values[0], np.ndarray) else values, pa.int64())


def identify(docs: DataFrame, spec: Spec, bits: int) -> tuple[DataFrame, np.ndarray]:
    """docs (key, text) as (key, n, id), and how frequent shingles are, in one pass over the texts.

    The second is, for each cell of a hashed table, the number of binary digits of how many of the texts' shingles fall into it;
    each task adds its cells as rows of their own.
    """
    kind = docs.schema["key"].dataType.simpleString()
    empty = to_arrow_type(docs.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, cells = Powers(), np.zeros(1 << bits, np.int32)
        names = ["key", "n", "id", "slice", "cells"]
        for batch in batches:
            n, ids = [], []
            for text in texts_of(batch):
                tokens = shingles(text, spec, powers)
                n.append(len(tokens))
                ids.append(set_id(tokens))
                cells[place(tokens, bits)] += 1  # two shingles of a text in one cell count once: an order needs no exact counts
            rows = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), id_array(ids), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        for s in slices(cells, 1 << (bits - min(16, bits))):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, empty), pa.nulls(1, pa.int64()), pa.nulls(1, ID), s.column(0), s.column(1)], names=names)

    both = settle(docs.select("key", "text").mapInArrow(run, f"key {kind}, n long, id decimal(38,0), slice int, cells binary"))

    def digits(x: np.ndarray) -> np.ndarray:
        return np.frexp(x.astype(np.float64))[1].astype(np.uint8)

    table = gathered(both.where("slice is not null").select("slice", "cells"), bits, np.int32, np.add, digits, np.uint8)
    return both.where("slice is null").select("key", "n", "id"), table


def unpacked(body: pa.Scalar) -> np.ndarray:
    return np.frombuffer(body.as_buffer(), U)


def verified(found: DataFrame, pairs: DataFrame, spec: Spec) -> DataFrame:
    """Of the candidate pairs (a, b) those that link, by the whole sets in ``found`` (id, set), shingle by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = unpacked(x), unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(spec.linked(both, len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = found.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = found.select(F.col("id").alias("b"), F.col("set").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return settle(met.mapInArrow(run, "a decimal(38,0), b decimal(38,0)"))


# --- the signature tree


def signature_bits(n: int) -> int:
    """Bits of a set's bitmap: a power of two from eight times its size on; narrower ones pass many pairs that are far from a link."""
    return max(256, min(1 << 16, 1 << (8 * n - 1).bit_length()))


def bitmap(tokens: np.ndarray) -> bytes:
    bits = np.zeros(signature_bits(len(tokens)), np.uint8)
    bits[(tokens & U(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps at a smaller width: the bit of a shingle is its hash modulo the width."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)


class Tree:
    """Rows in order of size; a node holds its range of rows, sizes, the OR of the bitmaps, and the most shingles that
    a row has beyond its bits, which collisions may hide."""

    def __init__(self, n: np.ndarray, maps: np.ndarray):
        self.n, self.maps = n, maps
        self.ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [self._nodes(LEAF)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self._nodes(LEAF * FAN ** len(self.levels)))

    def _nodes(self, size: int):
        out = []
        for at in range(0, len(self.n), size):
            s = slice(at, min(at + size, len(self.n)))
            out.append((s, self.n[s].min(), self.n[s].max(), np.bitwise_or.reduce(self.maps[s], axis=0), (self.n[s] - self.ones[s]).max()))
        return out


def possible(x, y, spec: Spec) -> bool:
    """Whether rows of two nodes may link: the most that they can overlap, by bits in common and by size, suffices."""
    common = int(np.bitwise_count(x[3] & y[3]).sum())
    most = min(common + x[4], common + y[4], x[2], y[2])
    return spec.linked(most, max(x[1], most), max(y[1], most))


def leaf_pairs(s: Tree, x, t: Tree, y, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    a, b = x[0], y[0]
    common = np.bitwise_count(s.maps[a][:, None, :] & t.maps[b][None, :, :]).sum(axis=2, dtype=np.int64)
    n, m = s.n[a][:, None], t.n[b][None, :]
    most = np.minimum(n - s.ones[a][:, None], m - t.ones[b][None, :]) + common
    i, j = np.nonzero(spec.linked(np.minimum(most, np.minimum(n, m)), n, m))
    return i + a.start, j + b.start


def traverse(s: Tree, t: Tree, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs that may link, from both roots down; of a tree with itself each pair once."""
    todo = [(len(s.levels) - 1, 0, len(t.levels) - 1, 0)]
    while todo:
        i, p, j, q = todo.pop()
        if s is t and (i, p) > (j, q) and i == j:
            continue
        x, y = s.levels[i][p], t.levels[j][q]
        if not possible(x, y, spec):
            continue
        if i == 0 and j == 0:
            a, b = leaf_pairs(s, x, t, y, spec)
            yield (a[a < b], b[a < b]) if s is t else (a, b)
        elif s is t:
            down = lambda k: range(k * FAN, min((k + 1) * FAN, len(s.levels[i - 1])))
            todo += [(i - 1, u, i - 1, v) for u in down(p) for v in down(q) if u <= v]
        elif i >= j:
            todo += [(i - 1, u, j, q) for u in range(p * FAN, min((p + 1) * FAN, len(s.levels[i - 1])))]
        else:
            todo += [(i, p, j - 1, v) for v in range(q * FAN, min((q + 1) * FAN, len(t.levels[j - 1])))]


def by_width(n: np.ndarray, maps: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by the width of their bitmaps, in words of 64 bits: (places in order of size, bitmaps)."""
    widths = np.array([len(m) // 8 for m in maps])
    out = {}
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        at = at[np.argsort(n[at], kind="stable")]
        out[int(w)] = at, np.frombuffer(b"".join(maps[i] for i in at), U).reshape(len(at), -1)
    return out


def tree_pairs(n: np.ndarray, maps: list[bytes], side: np.ndarray, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of a block that may link; if both sides 0 and 1 occur, only pairs across them.

    Sets of linked size have bitmaps of the same width, or of widths next to each other; the wider ones are folded.
    """
    sides = [np.flatnonzero(side == k) for k in (0, 1)]
    two = len(sides[0]) and len(sides[1])
    rows = [np.arange(len(n))] * 2 if not two else sides
    groups = [by_width(n[r], [maps[i] for i in r]) for r in rows]
    for w, (at, own) in groups[0].items():
        for v, (other_at, other) in groups[1].items():
            if v not in (w, 2 * w, w // 2) or (not two and v < w):
                continue
            least = min(v, w)
            s = Tree(n[rows[0]][at], folded(own, least))
            t = s if not two and v == w else Tree(n[rows[1]][other_at], folded(other, least))
            for a, b in traverse(s, t, spec):
                yield rows[0][at[a]], rows[1][other_at[b]]


def met_in_blocks(blocks: DataFrame, spec: Spec, one_of_each: bool) -> DataFrame:
    """Candidate pairs (ra, rb, apart, a, b) of rows (token, lo, hi, side, id, n, root, first, bits) that stream by block by block.

    Sets that share many shingles meet in as many blocks; a block leaves a pair to an earlier one if both rows name that in ``first``.
    The earliest that they share never does, so no pair is lost.  With ``one_of_each`` a block gives one pair for any two roots,
    the nearest in size.
    """

    def found(token: int, held: list) -> Iterator[tuple]:
        side, ids, n, root, first, maps = zip(*held)
        n, root = np.array(n), np.array(root)
        earlier = [{t for t in f if t < token} for f in first]
        best = {}
        for a, b in tree_pairs(n, [zlib.decompress(m) for m in maps], np.array(side), spec):
            apart = root[a] != root[b]
            for i, j in zip(a[apart], b[apart]):
                if not earlier[i].isdisjoint(earlier[j]):
                    continue
                i, j = (i, j) if (root[i], ids[i]) < (root[j], ids[j]) else (j, i)
                pair = (abs(int(n[i]) - int(n[j])), ids[i], ids[j])
                of = (int(root[i]), int(root[j]))
                if not one_of_each:
                    yield (*of, *pair)
                elif of not in best or pair < best[of]:
                    best[of] = pair
        for of, pair in best.items():
            yield (*of, *pair)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own, held = None, []
        for batch in batches:
            for token, lo, hi, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (token, lo, hi) != own:
                    if len(held) > 1:
                        yield from found(own[0], held)
                    own, held = (token, lo, hi), []
                held.append(rest)
        if len(held) > 1:
            yield from found(own[0], held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimals = lambda x: pa.array(x, ID)
        yield from batched(pairs(batches), ["ra", "rb", "apart", "a", "b"], [longs, longs, longs, decimals, decimals])

    where = ["token", "lo", "hi"]
    rows = blocks.select(*where, "side", "id", "n", "root", "first", "bits").repartition(*where).sortWithinPartitions(*where)
    return rows.mapInArrow(run, "ra long, rb long, apart long, a decimal(38,0), b decimal(38,0)")


def block_pairs(blocks: DataFrame, spec: Spec, one_of_each: bool) -> DataFrame:
    """The pairs (a, b) of ``met_in_blocks``; with ``one_of_each`` one for any two roots, of all blocks' pairs the nearest in size."""
    made = met_in_blocks(blocks, spec, one_of_each)
    if one_of_each:
        return made.groupBy("ra", "rb").agg(F.min(F.struct("apart", "a", "b")).alias("one")).select("one.a", "one.b")
    return made.select("a", "b").distinct()


# --- the join


def text_hash(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)


def star_of(tokens: np.ndarray, spec: Spec) -> int:
    """A hash of the least shingle by an order of its own and of the class of size: most near copies have it in common."""
    like = int(np.floor(np.log(len(tokens)) / -np.log(spec.percent / 100))) if spec.percent < 100 else len(tokens)
    least = tokens[np.argmin(mixed(tokens + U(1)))]
    return xxhash.xxh3_64_intdigest(least.tobytes() + like.to_bytes(8, "little")) - (1 << 63)


def candidates(texts: DataFrame, rare: np.ndarray, bits: int, spec: Spec) -> DataFrame:
    """The sets that may link at all: (id, text, n, star, tokens, bits), a row per set.

    Shingles are ordered from rare to frequent.  Sets that link share one of the first of each, so only sets with a shared one
    matter; ``tokens`` are those, ``text`` the hash of a text with this set, ``star`` as by ``star_of``, ``bits`` the signature,
    packed, as few of its bits are set.
    """
    order = texts.sparkSession.sparkContext.broadcast(rare)

    def prefix(tokens):
        level = order.value[place(tokens, bits)]
        return tokens[np.lexsort((tokens, level))[: spec.prefix(len(tokens))]].view(np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, np.full(len(p), np.frombuffer(own, np.int64)[0])) for own, _, tokens in each_set(batches, spec) for p in [prefix(tokens)])
        yield from batched(rows, ["token", "h"], [longs, longs], 256)

    shared = texts.mapInArrow(keys, "token long, h long").groupBy("token").agg(F.min("h").alias("l"), F.max("h").alias("g")).where("l <> g").select("token")
    shared = settle(shared)
    known = texts.sparkSession.sparkContext.broadcast(flags(shared, shared.count()))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = known.value

        def rows():
            for own, text, tokens in each_set(batches, spec):
                p = prefix(tokens)
                hit = p[flagged(table, width, p.view(U))]
                if len(hit):
                    yield own, text, len(tokens), star_of(tokens, spec), hit.tolist(), zlib.compress(bitmap(tokens), 1)

        lists, binaries = (lambda x: pa.array(x, pa.list_(pa.int64()))), (lambda x: pa.array(x, pa.binary()))
        yield from batched(rows(), ["id", "text", "n", "star", "tokens", "bits"], [id_array, longs, longs, longs, lists, binaries], 512)

    ddl = "id decimal(38,0), text long, n long, star long, tokens array<long>, bits binary"
    return settle(texts.mapInArrow(members, ddl).dropDuplicates(["id"]))


def tagged(value: str, role: int):
    return F.col(value).bitwiseAND(-4).bitwiseOR(role).alias("value")


def has_role(known: tuple[np.ndarray, int], value: int, role: int) -> bool:
    return bool(flagged(*known, np.array([(value & -4) | role], np.int64).view(U))[0])


def sets_of(texts: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """(id, set): whole sets of the texts whose hashes ``wanted`` (one column of longs) holds."""
    known = texts.sparkSession.sparkContext.broadcast(flags(wanted, wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((own, tokens.tobytes()) for own, _, tokens in each_set(batches, spec, lambda hashes: flagged(*known.value, hashes.view(U))))
        yield from batched(rows, ["id", "set"], [id_array, lambda x: pa.array(x, pa.binary())], 128)

    return settle(texts.mapInArrow(run, "id decimal(38,0), set binary").dropDuplicates(["id"]))


def rooted(ids: DataFrame, roots: DataFrame, of: str, name: str) -> DataFrame:
    """Adds the root of an id's component, which is the id itself if nothing links to it."""
    r = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return ids.join(r, F.col(of) == F.col("__node"), "left").withColumn(name, F.coalesce("__root", of)).drop("__node", "__root")


def first_links(texts: DataFrame, found: DataFrame, spec: Spec) -> DataFrame:
    """Links found by comparing every set with one other of its star.

    The other, the star's leader, is the set with the fewest rare shingles of its own, most likely the text that others were copied from.
    This connects most copies of a group at a cost in proportion to the group, and leaves the exact search little to
    do.  Every set is sent once, to its star; a hot star is met in ``SALTS`` groups, each of which gets the leader.  Who
    leads and what is hot stands in a filter of bounded size, whose errors only send more.
    """
    own = spec.prefix(F.col("n")) - F.size("tokens")
    stars = found.groupBy("star").agg(F.min(F.struct(own.alias("own"), F.xxhash64("id").alias("h"), "text")).alias("one"), F.count(F.lit(1)).alias("rows"))
    stars = settle(stars.where("rows > 1").select("star", "rows", F.col("one.text").alias("leader")))
    marks = found.select(tagged("text", FOUND)).unionAll(stars.select(tagged("star", STAR))).unionAll(stars.select(tagged("leader", LEADER)))
    marks = settle(marks.unionAll(stars.where(F.col("rows") > HOT).select(tagged("star", HOT_STAR))))
    known = texts.sparkSession.sparkContext.broadcast(flags(marks, marks.count()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value

        def rows():
            for own, text, tokens in each_set(batches, spec, lambda hashes: flagged(*table, ((hashes & -4) | FOUND).view(U))):
                star = star_of(tokens, spec)
                if has_role(table, star, STAR):
                    leads, body = has_role(table, text, LEADER), tokens.tobytes()
                    salts = [0] if not has_role(table, star, HOT_STAR) else range(SALTS) if leads else [text % SALTS]
                    for salt in salts:
                        yield star, salt, int(not leads), own, body

        yield from batched(rows(), ["star", "salt", "follows", "id", "set"], [longs, longs, longs, id_array, lambda x: pa.array(x, pa.binary())], 128)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            at = None
            for batch in batches:
                for star, salt, follows, own, body in zip(*batch.columns):
                    if (star, salt) != at:
                        at, leader = (star, salt), None
                        if not follows.as_py():
                            leader, tokens = own.as_py(), unpacked(body).copy()
                    elif leader is not None and own.as_py() != leader:
                        other = unpacked(body)
                        if spec.linked(min(len(tokens), len(other)), len(tokens), len(other)) and spec.linked(len(np.intersect1d(tokens, other, assume_unique=True)), len(tokens), len(other)):
                            yield tuple(sorted((own.as_py(), leader)))

        decimals = lambda x: pa.array(x, ID)
        yield from batched(links(), ["a", "b"], [decimals, decimals])

    where = ["star", "salt"]
    sent = texts.mapInArrow(send, "star long, salt long, follows long, id decimal(38,0), set binary")
    met = sent.repartition(*where).sortWithinPartitions(*where, "follows", "id")
    return settle(met.mapInArrow(compare, "a decimal(38,0), b decimal(38,0)").distinct())


def blocks_between(named: DataFrame) -> DataFrame:
    """Rows for ``block_pairs``: each shared shingle makes a block of (id, n, root, first, bits), with the set's ``FIRST`` least shingles
    that make one.

    Blocks whose sets are all connected go, and of blocks with the same sets, by 128 bits of hashes, one stays.
    """
    placed = named.select("id", "root", F.explode("tokens").alias("token"))
    members = [F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "id")).alias("y")]
    live = placed.groupBy("token").agg(F.min("root").alias("l"), F.max("root").alias("g"), *members).where("l <> g")
    live = live.groupBy("rows", "x", "y").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("rows") / BLOCK).cast("int").alias("cuts"))
    of_set = placed.join(live, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "cuts"))).alias("blocks"))
    rows = of_set.join(named.select("id", "n", "root", "bits"), "id").withColumn("first", F.slice("blocks.token", 1, FIRST))
    rows = rows.withColumn("block", F.explode("blocks")).select("id", "n", "root", "first", "bits", "block.*")
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    side = (F.col("cut") > F.col("other")).cast("int").alias("side")
    return rows.select("token", F.least("cut", "other").alias("lo"), F.greatest("cut", "other").alias("hi"), side, "id", "n", "root", "first", "bits")


def unsettled(named: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(id) of the sets that may still link to another component, after one pair of each two that meet was verified.

    Components whose pair links are one now, and those that do not meet have no pair that may link.  What is left are components whose
    pair does not link, unless that is their only one.
    """
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("sets"))
    own = named.select("id", "root").join(sizes, "root")
    ends = pairs.join(links, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        ends = ends.join(own.select(F.col("id").alias(end), F.col("root").alias(f"r{end}"), F.col("sets").alias(f"n{end}")), end)
    ends = ends.where("na > 1 or nb > 1")
    roots = ends.select(F.col("ra").alias("root")).unionAll(ends.select(F.col("rb").alias("root"))).distinct()
    return settle(named.join(roots, "root").select("id"))


def connected(texts: DataFrame, found: DataFrame, spec: Spec) -> DataFrame:
    """(node, root) of all sets that links connect; a set without a link may be left out.

    What ``first_links`` finds connects most.  Then blocks of sets that share a rare shingle meet in signature trees: a first pass
    verifies one pair for any two components that meet, which joins the parts of large groups of near copies at a cost
    in proportion to the parts; a second one verifies all pairs of what is still apart and not settled by the first.
    """
    roots = settle(components(first_links(texts, found, spec)))
    light = found.select("id", "n", "tokens", "bits")
    for one_of_each in (True, False):
        named = rooted(light if one_of_each else light.join(left, "id"), roots, "id", "root")
        named = settle(named.withColumn("root", F.xxhash64("root")))
        pairs = settle(block_pairs(blocks_between(named), spec, one_of_each))
        if pairs.isEmpty():
            break
        ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = settle(found.select("id", "text").join(ids, "id").select("text"))
        links = verified(sets_of(texts, wanted, spec), pairs, spec)
        roots = joined_components(roots, links)
        if one_of_each:
            left = unsettled(named, pairs, links)
            if left.isEmpty():
                break
    return roots


def link_documents(docs: DataFrame, key: str, text: str, shingle: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, set_id, component, component_id) of every document.

    Gives components, not the links of the join: pairs inside a component that is connected already are not tested.

    A document's set are the hashes of its distinct shingles, over lower-cased A-Z; documents of equal sets are one class.
    Classes link when percent * union <= 100 * intersection.  component is the same for all that links connect, and component_id the
    smallest key among them (null if all are null).  A document without words has an empty set, no component, and its own key
    as component_id.  Repeated rows are documents of equal sets.  Other columns are not looked at.

    Every link between different sets is found, except those that would connect what is connected already.  The
    order of shingles comes from a sketch of fixed size; a coarser one makes larger blocks, but any order finds all links.
    """
    spec = Spec(shingle, percent)
    base = short_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts = base.select("text")
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    bits = max(16, min(MOST_CELLS, int(chars // 6).bit_length()))
    own, rare = identify(base, spec, bits)
    found = candidates(texts, rare, bits, spec)
    roots = connected(texts, found, spec)
    classes = own.where("n > 0").groupBy("id").agg(F.min("key").alias("least"))
    classes = rooted(classes, roots, "id", "component")
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = settle(classes.join(smallest, "component").select(F.col("id").alias("set_id"), "component", "component_id"))
    out = own.where("n > 0").withColumnRenamed("id", "set_id").join(named, "set_id")
    empty = own.where("n = 0").select("key", "n", F.col("id").alias("set_id"), F.lit(None).cast("decimal(38,0)").alias("component"), F.col("key").alias("component_id"))
    return out.select("key", "n", "set_id", "component", "component_id").unionByName(empty).withColumnRenamed("n", "n_shingles")
