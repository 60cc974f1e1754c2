"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallframe.llm.common import number_rows, plain_key, words
from squallframe.session import settle


@dataclass(frozen=True)
class Shape:
    """2^bin_bits bins, of whose least hashes the low 8 bits are stored; shingles of so many words."""

    bin_bits: int = 7
    shingle: int = 5

    @property
    def bins(self) -> int:
        return 1 << self.bin_bits

    def bin_of(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.bin_bits).cast("int")


def with_fingerprint(df: DataFrame, text: str, name: str, shape: Shape = Shape()) -> DataFrame:
    """Adds a text's fingerprint: two hex digits a bin; a text without words has the empty fingerprint.

    Every shingle is hashed once.  The high bits of the hash are its bin; sorting the hashes of a document brings each bin's
    least one to the front of its run.  An empty bin copies a bin that is not: each empty bin has its own order of all bins, by a hash of
    both numbers, and takes the first non-empty one on it, which is the choice of optimal densification and the same for every
    document.  Documents with fewer words than a shingle are one shingle.  Steps are projections of their own, so an array is made once.
    """
    k = shape.shingle
    w, h, s, least, at, full = (f"__{name}_{x}" for x in ("w", "h", "s", "least", "at", "full"))
    keep = df.columns
    step = df.select("*", words(F.col(text)).alias(w))
    step = step.select(*keep, w, F.transform(w, lambda x: F.xxhash64(x)).alias(h))
    gram = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(*keep, F.sort_array(F.when(F.size(h) >= k, gram).otherwise(short)).alias(s))
    first = F.filter(s, lambda x, i: (i == 0) | (shape.bin_of(x) != shape.bin_of(F.get(s, i - 1))))
    step = step.select(*keep, first.alias(least))
    step = step.select(*keep, least, F.transform(least, shape.bin_of).alias(at))

    def filled(b: Column) -> Column:
        own = F.get(least, (F.array_position(F.col(at), b) - 1).cast("int"))
        probe = F.transform(least, lambda x: F.struct(F.xxhash64(b, shape.bin_of(x)).alias("turn"), x.alias("h")))
        return F.coalesce(own, F.array_min(probe)["h"])

    step = step.select(*keep, F.when(F.size(least) > 0, F.transform(F.sequence(F.lit(0), F.lit(shape.bins - 1)), filled)).alias(full))
    packed = F.array_join(F.transform(full, lambda x: F.substring(F.hex(F.lit(256) + x.bitwiseAND(F.lit(255))), 2, 2)), "")
    return step.select(*keep, F.coalesce(packed, F.lit("")).alias(name))


def likeness(a: Column, b: Column, shape: Shape = Shape()) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets, from 0 to 1.

    Different hashes share their low 8 bits once in 256, which is taken out of the share of equal bins.  Two empty fingerprints are
    alike (1); an empty one and any other are not (0).
    """
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(shape.bins - 1)),
        F.lit(0),
        lambda n, i: n + (F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2))).cast("int"),
    )
    chance = 1 / 256
    est = F.greatest(F.lit(0.0), (same / float(shape.bins) - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(est)


def edit_and_compare(docs: DataFrame, key: str, text: str, shape: Shape = Shape()) -> DataFrame:
    """Fingerprints of every document and of its edited text: (key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).

    The edited text replaces the last half of a text (floor of its code points) by the start of the next document's text, in ascending
    order of key (null first), ties by text, the first after the last.  A null text is empty.  Repeated rows follow each other.
    Other columns are not looked at.

    Only keys are put in order.  A text is known by the md5 of key and text, under which it is shuffled once: the shuffle serves the
    join that cuts the starts that others need, and the one that puts them together.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), body.alias("text")).select(F.md5(F.concat_ws(":", plain_key(F.col("key")), "text")).alias("id"), "key", "text")
    ids = settle(base.groupBy("id").agg(F.min("key").alias("key"), F.min(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")))
    placed = settle(number_rows(ids, [], ["key", "id"], "place"))
    total = placed.count()
    after = placed.select(F.pmod(F.col("place") - 1, F.lit(max(1, total))).alias("place"), F.col("id").alias("next_id"))
    ring = settle(placed.join(after, "place").select("id", "key", "n", "rows", "next_id"))

    repeated = settle(ids.where("rows > 1").select("id"))
    one = base.select("id", "text")
    if not repeated.isEmpty():
        one = one.join(repeated, "id", "left_anti").unionByName(one.join(repeated, "id", "left_semi").dropDuplicates(["id"]))

    asked = ring.select(F.col("next_id").alias("id"), F.col("id").alias("by"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    starts = one.join(asked, "id").select(F.col("by").alias("id"), F.substring("text", F.lit(1), F.col("half")).alias("start"))
    head = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    own = one.join(ring, "id").join(starts, "id")
    texts = own.select("id", "key", "n", "next_id", F.lit(1).cast("long").alias("times"), "text", F.concat(head, "start").alias("edited"))
    if not repeated.isEmpty():  # all but the last of a run of repeated rows are followed by themselves
        again = one.join(ring.where("rows > 1"), "id")
        whole = F.concat(head, F.substring("text", F.lit(1), F.floor(F.col("n") / 2).cast("int")))
        texts = texts.unionByName(again.select("id", "key", "n", F.col("id").alias("next_id"), (F.col("rows") - 1).alias("times"), "text", whole.alias("edited")))
    printed = with_fingerprint(with_fingerprint(texts, "text", "fingerprint", shape), "edited", "edited_fingerprint", shape)
    printed = settle(
        printed.select("id", "key", F.col("n").cast("long").alias("n_chars"), "next_id", "times", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint")
    )
    following = printed.where("id <> next_id or times = 1").select(F.col("id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint"))
    if not repeated.isEmpty():
        following = following.dropDuplicates(["next_id"])
    out = printed.join(following, "next_id")
    if not repeated.isEmpty():
        out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select(
        "key",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), shape).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), shape).alias("near_next"),
    )
