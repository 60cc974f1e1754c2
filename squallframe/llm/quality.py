"""Quality rules as a short-circuit cascade: cost and selectivity from a sample, most rejections per cost first."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SAMPLE = 2000  # documents that costs and selectivities are estimated on, about
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LETTERED = regex.compile(r"\p{L}[^\x20\x09-\x0D]*")  # matches once in each word with a letter


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur at least twice, the first time included; exact.

    Words become numbers, then windows of two, four, eight words, each from the numbers of two shorter ones.
    """
    n, ids = len(words), {}
    if n <= window:
        return 0
    runs = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    span = 1
    while span < window and len(runs):
        shift = min(span, window - span)
        pairs = runs[:-shift] * np.int64(n) + runs[shift:]
        distinct, runs = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(runs):
            return 0
        span += shift
    starts = np.flatnonzero(np.bincount(runs)[runs] > 1)
    return int(np.minimum(np.diff(starts, append=n + window), window).sum())


# name -> (what it needs, how it comes from that); each is computed at most once a document
STATISTICS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "words": (("body",), lambda body: body.split()),  # of bytes, at ASCII white space only
    "text": (("body",), lambda body: body.decode("utf-8", "replace")),
    "lines": (("text",), lambda text: [x for x in text.split("\n") if x.strip(WHITE)]),
    "n_words": (("words",), len),
    "word_chars": (("words",), lambda words: len(b"".join(words).decode("utf-8", "replace"))),
    "n_symbols": (("body",), lambda body: sum(body.count(s.encode()) for s in SYMBOLS)),
    "n_lines": (("lines",), len),
    "n_dup_lines": (("lines",), lambda lines: len(lines) - len(set(lines))),
    "n_letter_words": (("text",), lambda text: sum(1 for _ in LETTERED.finditer(text))),
    "n_repeat_words": (("words",), repeated_words),
}


def value(name: str, known: dict):
    """A statistic of one document; ``known`` holds what is computed already, at first its ``body``."""
    if name not in known:
        needs, how = STATISTICS[name]
        known[name] = how(*(value(x, known) for x in needs))
    return known[name]


def ancestors(names: tuple[str, ...]) -> set[str]:
    """The statistics that the given ones take, themselves included."""
    out = set()
    for name in names:
        if name != "body":
            out |= {name} | ancestors(STATISTICS[name][0])
    return out


@dataclass(frozen=True)
class Rule:
    """Rejects a document of which ``fails(*statistics)`` holds."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[..., bool]

    def rejects(self, known: dict) -> bool:
        return bool(self.fails(*(value(x, known) for x in self.needs)))


# Limits that are widely used for web text
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
)
RULES = (
    *BASE,
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: c < 3 * n or c > 10 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("letterless_words", ("n_letter_words", "n_words"), lambda x, n: 10 * x < 8 * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
)


def order_rules(rules: tuple[Rule, ...], failed: dict[int, int], seconds: dict[str, float]) -> tuple[Rule, ...]:
    """The rules, the one that rejects most per cost first, then that among what is left, and so on.

    ``failed`` counts the sample's documents by the bits of the rules that reject them, ``seconds`` are costs of the statistics.
    Rejections are those among documents that earlier rules let through, and a statistic that an earlier
    rule took costs nothing again; so rules that agree, or share their work, are ordered rightly.  Ties keep the given order.
    """
    left, out, paid = list(range(len(rules))), [], set()
    while left:

        def rank(i):
            caught = sum(n for bits, n in failed.items() if bits >> i & 1 and not any(bits >> j & 1 for j in out))
            cost = sum(seconds.get(s, 0.0) for s in ancestors(rules[i].needs) - paid) + 1e-9
            return -caught / cost, cost

        best = min(left, key=rank)
        left.remove(best)
        out.append(best)
        paid |= ancestors(rules[best].needs)
    return tuple(rules[i] for i in out)


def bodies(batch: pa.RecordBatch) -> Iterator[dict]:
    """What is known of each text at first; a null text is empty."""
    return ({"body": t.as_py() or b""} for t in batch.column(batch.num_columns - 1).cast(pa.binary()))


def plan(docs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules in the order of the cascade, from about ``sample`` documents drawn by chance (all, if there are fewer).

    Every rule runs on every drawn document, and each statistic is timed without those that it is made of.  The order changes
    costs only, never verdicts.  The driver gets at most a row per task and a row per pattern of rejections.
    """
    names = list(STATISTICS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, patterns = dict.fromkeys(names, 0.0), {}
        for batch in batches:
            for known in bodies(batch):
                for name in names:  # each comes after what it needs
                    began = time.perf_counter()
                    value(name, known)
                    spent[name] += time.perf_counter() - began
                bits = sum(rule.rejects(known) << i for i, rule in enumerate(rules))
                patterns[bits] = patterns.get(bits, 0) + 1
        rows = [("time", names.index(k), 0, s) for k, s in spent.items()] + [("failed", bits, n, 0.0) for bits, n in patterns.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["what", "which", "n", "seconds"])

    total = docs.count()
    if not total:
        return rules
    drawn = docs.select(F.col(text)).where(F.rand(17) < min(1.0, sample / total))
    sums = drawn.mapInArrow(measure, "what string, which long, n long, seconds double").groupBy("what", "which").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"))
    rows = sums.collect()
    failed = {r["which"]: r["n"] for r in rows if r["what"] == "failed"}
    seconds = {names[r["which"]]: r["seconds"] for r in rows if r["what"] == "time"}
    return order_rules(rules, failed, seconds)


def judge(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """(key, kept, failed_rule, rules_run, and the statistics to report) of every document.

    Rules run in the order of ``plan`` until one rejects: ``failed_rule`` is that one (null for kept documents) and ``rules_run``
    how many ran.  These two follow the measured order and may differ between runs; ``kept`` does not.  Rules share the
    statistics of a document, which are computed when first asked for; those of ``report`` are computed for all documents.

    A null, empty or wordless text has statistics of 0 and goes by the rule on the number of words.  Texts are looked at whole,
    however long, and one at a time.  Repeated rows give a row each, null keys stay, an empty table gives an empty result;
    other columns are not looked at.
    """
    rules = plan(docs, text, rules, sample)
    kind = docs.schema[key].dataType
    names = ["key", "kept", "failed_rule", "rules_run", *report]
    kinds = [to_arrow_type(kind), pa.bool_(), pa.string(), pa.int32(), *[pa.int64()] * len(report)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for known in bodies(batch):
                ran, failed = len(rules), None
                for i, rule in enumerate(rules):
                    if rule.rejects(known):
                        ran, failed = i + 1, rule.name
                        break
                rows.append((failed is None, failed, ran, *(value(s, known) for s in report)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]), *columns], names=names)

    ddl = ", ".join([f"key {kind.simpleString()}, kept boolean, failed_rule string, rules_run int", *[f"{s} long" for s in report]])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, ddl)
