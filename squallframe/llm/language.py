"""Language identification: multinomial naive Bayes over hashed character n-grams."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from squallframe.llm.common import short_batches

NOT_LETTERS = re.compile(r"[\W\d_]+")
SLICE = 1 << 20  # code points that are hashed at a time, so that memory is bounded for any text
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
MOST_CELLS = 1 << 26  # languages x features of a model
ROWS, CELLS = 256, 1 << 21  # texts, and features x languages, that are scored at a time


def letters_of(text: str) -> Iterator[str]:
    """The lower-cased letters, words apart by one space, one at either end; in pieces, which don't show where they were cut."""
    yield " "
    last = " "
    for at in range(0, len(text), SLICE):
        # a capital sigma is the only letter whose lower case depends on its neighbours
        s = NOT_LETTERS.sub(" ", text[at : at + SLICE].replace("\u03a3", "\u03c3").lower())
        s = s[1:] if last == " " and s[:1] == " " else s
        if s:
            last = s[-1]
            yield s
    if last != " ":
        yield " "


def grams(text: str, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of ``letters_of`` the text; memory is bounded for any text."""
    reach = max(orders)
    codes, new = np.zeros(0, np.uint64), 0
    for piece in letters_of(text):
        own = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        codes, new = np.concatenate([codes[len(codes) - min(len(codes), reach - 1) :], own]), len(own)
        for n in orders:
            c = codes[max(0, len(codes) - new - n + 1) :]
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, dtype=np.uint64)
                for i in range(n):
                    h = (h ^ c[i : len(c) - n + 1 + i]) * MIX[i % 2]
                    h ^= h >> np.uint64(29)
                yield ((h * MIX[0]) >> np.uint64(64 - bits)).astype(np.int64)


def counted(text: str, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text, ascending, and how often each occurs."""
    parts, n = [], 0
    for ids in grams(text, orders, bits):
        parts.append(ids)
        n += len(ids)
        if n > 4 << bits:  # a long text is summed up as it is read
            sums = np.zeros(1 << bits, np.int64)
            for ids_ in parts:
                sums += np.bincount(ids_, minlength=1 << bits) if ids_.ndim == 1 else ids_[0]
            parts, n = [sums[None]], 0
    if any(x.ndim == 2 for x in parts):
        sums = sum(np.bincount(x, minlength=1 << bits) if x.ndim == 1 else x[0] for x in parts)
        used = np.flatnonzero(sums)
        return used, sums[used]
    return np.unique(np.concatenate(parts), return_counts=True)


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    prior: np.ndarray  # log share of each language
    weights: np.ndarray  # features x languages, log probability
    orders: tuple[int, ...]
    bits: int

    usual: np.ndarray  # mean log probability of an n-gram of each language
    spread: np.ndarray  # and its deviation

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, excess) of each text, scored as one sparse matrix of counts, a bounded number of cells at a time.

        score is the probability of the language among those learned; excess is how much less likely than usual, in mean log
        probability, the n-grams are, beyond what chance explains in a text of this length (four deviations of the mean).
        """
        out: list = [("und", 0.0, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.langs and has_letters(t)]
        for at in range(0, len(rows), ROWS):
            own = rows[at : at + ROWS]
            found = [counted(texts[i], self.orders, self.bits) for i in own]
            ends = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in found])])
            ids, counts = (np.concatenate(c) for c in zip(*found))
            total = self.totals(ends, ids, counts)
            best = total.argmax(axis=1)
            score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            n = np.add.reduceat(counts, ends[:-1])
            mean = (total[np.arange(len(own)), best] - self.prior[best]) / n
            excess = np.maximum(0.0, self.usual[best] - mean - 4 * self.spread[best] / np.sqrt(n))
            for i, b, s, e in zip(own, best, score, excess):
                out[i] = self.langs[b], float(s), float(e)
        return out

    def totals(self, ends: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """rows x languages: log prior plus counts times weights, for rows whose features stand between their ends."""
        total = np.tile(self.prior, (len(ends) - 1, 1))
        step = max(1, CELLS // len(self.langs))
        for lo in range(0, len(ids), step):
            hi = min(lo + step, len(ids))
            first, last = np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, hi, "left")
            starts = np.maximum(ends[first:last], lo) - lo
            part = counts[lo:hi, None] * self.weights[ids[lo:hi]].astype(float)
            total[first:last] += np.add.reduceat(part, starts, axis=0)
        return total


def fit(docs: DataFrame, text: str, lang: str, key: str, sample_per_lang: int = 4000, orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, smooth: float = 0.1) -> Model:
    """Fit on the rows with a language.

    Priors count all rows.  N-grams come from about ``sample_per_lang`` rows of each language, picked by a hash of the key (all,
    where there are fewer): a documented bound, as a few million n-grams settle a language.  Tasks add up their counts in
    numpy and send one row per feature seen; the sums, at most languages x 2^bits numbers, make the matrix.
    """
    labelled = short_batches(docs).where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) << bits > MOST_CELLS:
        raise ValueError(f"{len(langs)} languages: use fewer bits")
    if not langs:
        return Model([], np.zeros(0), np.zeros((1 << bits, 0), np.float32), orders, bits, np.zeros(0), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_per_lang / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("key")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for batch in batches:
            for name, body in zip(batch["lang"], batch["text"]):
                row = sums.setdefault(name, np.zeros(1 << bits, np.int64))
                for ids in grams(body, orders, bits):
                    row += np.bincount(ids, minlength=1 << bits)
        for name, row in sums.items():
            used = np.flatnonzero(row)
            yield pd.DataFrame({"lang": name, "gram": used.astype(np.int32), "n": row[used]})

    sample = labelled.where(F.col("text").isNotNull() & (draw < share[F.col("lang")])).select("lang", "text")
    table = sample.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((1 << bits, len(langs)), smooth)
    if len(table):
        counts[table["gram"].to_numpy(), table["lang"].map(langs.index).to_numpy()] += table["n"].to_numpy()
    share_of = counts / counts.sum(axis=0)
    weights = np.log(share_of)
    usual = (share_of * weights).sum(axis=0)
    spread = np.sqrt((share_of * (weights - usual) ** 2).sum(axis=0))
    prior = np.log(np.array([sizes[k] for k in langs], float) / sum(sizes.values()))
    return Model(langs, prior, weights.astype(np.float32), orders, bits, usual, spread)


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct(lang, score, excess), as by ``Model.predict``.  The matrix is broadcast; its size is
    bounded by ``MOST_CELLS``.

    A null, empty or letterless text is ``und`` with score 0; so is every text if nothing could be learned.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double,excess:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame(own.predict(texts.tolist()), columns=["lang", "score", "excess"])

    return predict


def held_out(key: Column) -> Column:
    """Documents that are kept from learning: checksum of the key as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, held_out, lang, score) of every document, learned from those not held out.

    A document with a null key is not held out.  A null, empty or letterless text is ``und`` with score 0.  Texts are scored whole, however
    long.  Repeated rows give a row each, an empty table gives an empty result; other columns are not looked at.
    """
    model = fit(docs.where(~held_out(F.col(key))), text, lang, key)
    found = predictor(docs.sparkSession, model)(F.col(text))
    out = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), found.alias("found"))
    return out.select("key", "held_out", "found.lang", "found.score")
