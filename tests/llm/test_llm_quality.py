"""The quality cascade against plain counting and every rule on every text."""
import collections

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from squallframe.llm import quality

from .conftest import words

REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words")


def plain(text):
    text = text or ""
    w, seen, again = words(text), set(), 0
    lines = [x for x in text.split("\n") if words(x)]
    for x in lines:
        again += x in seen
        seen.add(x)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(runs)
    covered = {j for i, r in enumerate(runs) if times[r] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), len(lines), sum(any(map(str.isalpha, x)) for x in w))


def verdict(s):
    n, chars, symbols, dup, repeat, lines, letters = s
    return not (n < 20 or 100 * repeat > 30 * n or chars < 3 * n or chars > 10 * n or 10 * symbols > n or 10 * letters < 8 * n or 2 * dup > lines)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 9))
def test_repeated_words_of_any_window(tokens, window):
    runs = [tuple(tokens[i : i + window]) for i in range(len(tokens) - window + 1)]
    times = collections.Counter(runs)
    covered = {j for i, r in enumerate(runs) if times[r] > 1 for j in range(i, i + window)}
    assert quality.repeated_words([t.encode() for t in tokens], window) == len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé é1#|<\n\t \x1c\x85\xa0 ٣Ⅷ", max_size=80))
def test_statistics_of_odd_texts(text):
    known = {"body": text.encode()}
    assert tuple(quality.value(n, known) for n in REPORT) == plain(text)


def prose(n):
    return " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(n))


@pytest.fixture(scope="module")
def texts(awkward):
    more = [(30, prose(40)), (31, prose(30) + " | # $ % & *"), (32, "x " * 30), (33, prose(25) + " 1 2 3 4 5 6 7 8 9"), (34, prose(5000)), (35, "a b\n" * 30)]
    return [(r[0], r[1]) for r in awkward] + more


def test_every_document_gets_the_verdict_of_all_rules(table, texts):
    made = table(texts, "doc_id long, text string", "key string, kept int, n_words string, text2 string, which int")
    got = quality.judge(made, "doc_id", "text", report=REPORT)
    mine = sorted((repr(r["key"]), r["kept"], *(r[c] for c in REPORT)) for r in got.collect())
    assert mine == sorted((repr(d), verdict(plain(t)), *plain(t)) for d, t in texts)
    rows = got.collect()
    assert all(r["kept"] == (r["failed_rule"] is None) for r in rows) and all(r["rules_run"] == len(quality.RULES) for r in rows if r["kept"])
    assert any(r["kept"] for r in rows) and any(r["rules_run"] < len(quality.RULES) for r in rows)
    assert quality.judge(made.limit(0), "doc_id", "text").count() == 0


def test_verdicts_do_not_depend_on_the_sample(table, texts):
    made = table(texts, "doc_id long, text string", "kept int")
    few = sorted((repr(r["key"]), r["kept"]) for r in quality.judge(made, "doc_id", "text", sample=1).collect())
    assert few == sorted((repr(d), verdict(plain(t))) for d, t in texts)


def test_order_is_rejections_per_cost_among_what_is_left():
    cheap, dear = ("n_words",), ("n_repeat_words",)
    a, b, c, d = (quality.Rule(n, s, lambda *_: False) for n, s in zip("abcd", (cheap, dear, ("n_symbols",), dear)))
    seconds = {"words": 1.0, "n_words": 0.1, "n_repeat_words": 10.0, "n_symbols": 1.0}
    # c catches most per cost; what a catches is all caught by c, so b comes before a although a is cheaper; d then costs nothing
    failed = {0b0101: 40, 0b0100: 10, 0b0010: 30, 0b1000: 5, 0: 15}
    assert [r.name for r in quality.order_rules((a, b, c, d), failed, seconds)] == ["c", "b", "d", "a"]
    assert quality.ancestors(("n_repeat_words",)) == {"n_repeat_words", "words"}


def test_later_rules_do_not_run(monkeypatch):
    ran = []
    rules = tuple(quality.Rule(n, ("n_words",), lambda n, i=i: ran.append(i) or i == 1) for i, n in enumerate("abc"))
    known = {"body": b"one two"}
    next(r for r in rules if r.rejects(known))
    assert ran == [0, 1]
