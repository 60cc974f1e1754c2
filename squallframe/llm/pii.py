"""Personal data: patterns propose spans, checks confirm them, words nearby move their score."""
from __future__ import annotations

import re
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn", "secret"]
CODE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns take no step back over what they have read, so a long run of digits or letters costs linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")  # the start of one; its country tells how long it is
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
# The length of an account number by country
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# What a confirmed span scores by itself, and the words that raise it
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "credit", "visa", "mastercard", "payment"},
    "phone": {"phone", "call", "tel", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "secret": {"token", "secret", "key", "password", "credential", "auth"},
}
NEAR = 40  # code points on either side in which context words count
LETTERS = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an account number: country and check digits go last, letters count from 10."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str):
    """Matches of local@domain from left to right: from each @ the local part reaches back as far as it can."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def accounts(text: str):
    """Account numbers cut to the length of their country, single spaces apart; what goes on after them is none."""
    for m in IBAN.finditer(text):
        left, at = IBAN_LENGTHS.get(m[0][:2], 0) - 4, m.end()
        while left > 0 and at < len(text):
            at += text[at] == " "
            if at == len(text) or text[at] not in CODE:
                break
            left, at = left - 1, at + 1
        if left == 0 and not text[at : at + 1].isalnum():
            yield m.start(), at


def bits_a_character(value: str) -> float:
    counts = [value.count(c) for c in set(value)]
    return -sum(n / len(value) * log2(n / len(value)) for n in counts)


def proposals(text: str):
    for start, end in emails(text):
        yield "email", start, end
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE), ("ssn", SSN), ("secret", SECRET)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()
    for start, end in accounts(text):
        yield "iban", start, end


def confirmed(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(map(small_part, value.split(".")))
    if kind == "card":
        d = digits_of(value)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits_of(value)) <= 15
    if kind == "iban":
        return mod97(value.replace(" ", ""))
    if kind == "ssn":
        return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"
    if kind == "secret":  # random letters and digits, not a long word or number
        letters = sum(c.isalpha() for c in value[:256])
        return 0 < letters and any(c.isdigit() for c in value[:256]) and bits_a_character(value[:256]) >= 3
    return True


def find_spans(text: str | None, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; positions are code points, the end is exclusive.

    Spans of the four base kinds stay whatever they score; of the others only those that reach ``least``.  A null text has none.
    """
    found = []
    for kind, start, end in proposals(text or ""):
        if confirmed(kind, text[start:end]):
            near = LETTERS.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
            score = min(1.0, SCORE[kind] + 0.3 * (not CONTEXT[kind].isdisjoint(near)))
            if kind in BASE or score >= least:
                found.append((kind, start, end, score))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


@F.pandas_udf(T.ArrayType(SPAN))
def spans(text: pd.Series) -> pd.Series:
    """The spans of every whole text."""
    names = ("kind", "start", "end", "score")
    return pd.Series([[dict(zip(names, s)) for s in find_spans(t)] for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def redact(text: pd.Series) -> pd.Series:
    """Texts with every span replaced by its kind in brackets; spans that overlap become one. Null stays null, empty stays empty."""

    def one(t):
        if t is None:
            return None
        out, upto, covered = [], 0, 0
        for kind, start, end, _ in find_spans(t):
            if start >= covered:
                out += [t[upto:start], f"[{kind.upper()}]"]
            covered = upto = max(covered, end)
        return "".join([*out, t[upto:]]) if out else t

    return pd.Series([one(t) for t in text], dtype=object)


def scores(found: Column) -> Column:
    """The scores of the spans, in order, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.format_number(s["score"], 2)), ",")


def written(found: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found): the spans of each document's whole text, each with its score.

    A null or empty text has none.  Patterns read a text once, however long.  Repeated rows give a row each, null keys stay, an empty
    table gives an empty result; other columns are not looked at.
    """
    return docs.select(F.col(key).alias("key"), spans(F.col(text)).alias("found"))
