"""Parts of the training-data operators that once were left out."""
import collections
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from squallframe.llm import chats, language, pii

TURNS = "conv_id long, turn long, role string, text string"


def forgetful():
    """A template, made here so that workers get it whole."""

    def thoughts_since_the_last_user(turns):
        """Drops the thought of a turn when a user turn follows, however far back; the first turn stands in front of every piece."""
        last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
        head = turns[0][1] if turns and turns[0][0] == "system" else ""
        return "".join(f"[{head}{i}:{r}] {t if i > last else t.split('|')[-1]}\n" for i, (r, t) in enumerate(turns))

    return thoughts_since_the_last_user


@pytest.mark.parametrize("tools", [10, 3])
def test_a_rewrite_far_back_is_seen(spark, tools):
    turns = [("system", "S"), ("user", "q"), ("assistant", "think|a"), *[("tool", f"t{i}") for i in range(tools)], ("user", "again"), ("assistant", "hm|b")]
    template = forgetful()
    rows = spark.createDataFrame([(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(turns)], TURNS)
    got = {(r["conv_id"], r["place"]): r for r in chats.format_chats(rows, template).collect()}
    for c in (1, 2):
        for i in range(len(turns)):
            piece, lo, hi, rewritten = chats.locate(template, turns[:i], turns[i])
            r, start = got[c, i], len(template(turns[:i])) - rewritten
            assert (r["piece"], r["start"], r["text_start"], r["text_end"], r["rewritten"]) == (piece, start, start + lo, start + hi, rewritten)
        assert got[c, 3 + tools]["rewritten"] > 0 and got[c, 4 + tools]["piece"].startswith("[S")


def test_a_declared_history_changes_nothing_where_it_is_true(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", f"text {i} <|im_end|>") for i in range(12)]
    rows = spark.createDataFrame(turns, TURNS)
    assert sorted(chats.format_chats(rows).collect()) == sorted(chats.format_chats(rows, history=0).collect())


def test_packed_windows_hold_their_tokens(spark, docs):
    from squallframe.llm import packing

    rows = C.packed(spark, docs, "").collect()
    assert rows and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rows)
    encode, joined = packing.public_encoder(), {}
    for r in sorted(rows, key=lambda r: r["start"]):
        if r["doc_id"] in (7, 8, 9):
            joined.setdefault(r["doc_id"], []).extend(r["ids"])
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id in (7, 8, 9)").collect()}
    assert joined == {k: [*encode(t), 1] for k, t in texts.items()}


# --- language: plain naive Bayes, slices, junk


def plain_grams(text, orders=(1, 2, 3)):
    s = f" {re.sub(r'[\W\d_]+', ' ', text.lower()).strip()} "
    return collections.Counter(s[i : i + n] for n in orders for i in range(len(s) - n + 1))


def test_language_equals_plain_naive_bayes(table):
    rng = np.random.default_rng(4)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnéß"}
    rows = [(i, " ".join("".join(rng.choice(list(alphabets[k]), 4)) for _ in range(6)), k) for i in range(90) for k in [list(alphabets)[i % 3]]]
    rows += [(900, "efgh EFGH 12 efgh", None), (901, "zzzz", None), (902, "ij", "cc")]
    got = {r["key"]: r for r in language.identify(table(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()}
    learned = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {k: sum((plain_grams(t) for _, t, lang in learned if lang == k), collections.Counter()) for k in alphabets}
    size = {k: sum(c.values()) + 0.1 * 2**16 for k, c in counts.items()}
    for i, text, _ in rows:
        total = {k: np.log(sum(x[2] == k for x in learned) / len(learned)) + sum(n * np.log((counts[k][g] + 0.1) / size[k]) for g, n in plain_grams(text).items()) for k in alphabets}
        best = max(total, key=total.get)
        assert got[i]["lang"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(np.exp(t - total[best]) for t in total.values()), abs=1e-3)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_slices_of_a_text_do_not_show(monkeypatch, size):
    text = "  Ein Über-Satz, 12 ΟΔΟΣ x\n und\t\tmehr. "
    whole = language.counted(text, (1, 2, 3), 16)
    assert whole[1].sum() == sum(plain_grams(text.replace("Σ", "σ")).values())
    monkeypatch.setattr(language, "SLICE", size)
    assert all((x == y).all() for x, y in zip(whole, language.counted(text, (1, 2, 3), 16)))


def test_long_texts_are_summed_as_they_are_read(monkeypatch):
    text = "ab cd " * 3000
    whole = language.counted(text, (1, 2), 16)
    monkeypatch.setattr(language, "SLICE", 50)
    assert all((x == y).all() for x, y in zip(whole, language.counted(text, (1, 2), 6 + 10)))
    few = language.counted(text, (1, 2), 4)
    assert few[1].sum() == whole[1].sum() and len(few[0]) <= 16


def test_junk_and_unknown_languages_are_in_excess(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out(docs["doc_id"])), "text", "lang", "doc_id")
    rng = np.random.default_rng(1)
    junk = [" ".join("".join(rng.choice(list("qwxzjkvbpfgm"), 7)) for _ in range(60)) for _ in range(20)]
    unknown = [" ".join("".join(rng.choice(list("абвгдежзик"), 5)) for _ in range(60)) for _ in range(20)]
    clean = [r["text"] for r in docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("quality = 1").collect()]
    limit = C.MOST_EXCESS
    assert all(e > limit for _, _, e in model.predict(junk + unknown))
    assert all(e <= limit for _, _, e in model.predict(clean))


# --- personal data


def test_account_numbers_end_where_their_country_says():
    spans = lambda t: [s[:3] for s in pii.find_spans(t)]
    assert spans("IBAN DE89 3704 0044 0532 0130 00 PLEASE PAY") == [("iban", 5, 32)]
    assert spans("GB29NWBK60161331926819 AND") == [("iban", 0, 22)]
    assert spans("DE89370400440532013000X") == spans("ZZ89 3704 0044 0532 0130 00") == spans("DE89 3704 0044") == []


def test_context_decides_on_secrets():
    body = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert [s[0] for s in pii.find_spans(f'token = "{body}"')] == ["secret"]
    assert pii.find_spans(f"commit {body}") == [] and pii.find_spans("key a" + "ab" * 20) == []


def test_scores_are_in_the_result(spark):
    rows = entry.queries()["op8_personal_data"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) == len([x for x in r["scores"].split(",") if x]) for r in rows)
    assert any("secret" in r["spans"] for r in rows)
