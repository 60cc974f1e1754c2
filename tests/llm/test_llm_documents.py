"""Mixing, sharding, fingerprints, language, personal data, substrings and packing against brute force."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from squallframe.llm import fingerprints, language, mixing, packing, pii, sharding, substrings

from .conftest import passage, words


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# --- mixing


def water(sizes, weights, most=3):
    total, open_, target = sum(sizes.values()), set(sizes), {}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    while open_:
        left = total - sum(target.values())
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] >= most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        open_ -= set(over)
    return target


def test_mixture_meets_its_targets(docs, awkward):
    got = rows_of(mixing.mix(docs, "doc_id", "text", "source", [5, 2, 1]), "key", "size", "source", "source_size", "target", "taken")
    sizes = collections.Counter()
    for _, text, _, source, _ in awkward:
        sizes[source] += len(words(text))
    want = water(sizes, [5, 2, 1])
    assert len(got) == len(awkward)
    assert sorted(x[1] for x in got) == sorted(len(words(r[1])) for r in awkward)
    largest, taken = collections.Counter(), collections.Counter()
    for _, size, source, source_size, target, t in got:
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and t <= 3 * size
        largest[source] = max(largest[source], size)
        taken[source] += t
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    again = rows_of(mixing.mix(docs.repartition(5), "doc_id", "text", "source", [5, 2, 1]), "key", "taken")
    assert sorted(again, key=str) == sorted([(x[0], x[5]) for x in got], key=str)


def test_mixture_is_near_its_targets_on_many_rows(table):
    rows = [(i, "x " * (1 + i * 7919 % 97), "en", f"s{i % 5 if i % 3 else 0}", 1) for i in range(3000)]
    got = rows_of(mixing.mix(table(rows), "doc_id", "text", "source", [5, 2, 1]), "source", "target", "taken")
    taken, target = collections.Counter(), {}
    for source, goal, t in got:
        taken[source] += t
        target[source] = goal
    assert all(abs(taken[s] - target[s]) <= 97 for s in target)


def test_larger_budgets_take_what_smaller_ones_took(table):
    rows = [(i, "x " * (1 + i % 7), "en", "s", 1) for i in range(500)]
    few, more = (dict(rows_of(mixing.mix(table(rows), "doc_id", "text", "source", [1], share=s), "key", "copies")) for s in (0.3, 0.6))
    assert sum(few.values()) and all(more[k] >= n for k, n in few.items())


def test_mixture_of_documents_repeats_rows(docs, no_docs, awkward):
    plan = mixing.mix(docs, "doc_id", "text", "source", [5, 2, 1])
    out = mixing.mixture(docs, "doc_id", "text", "source", [5, 2, 1])
    assert out.columns == docs.columns
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(no_docs, "doc_id", "text", "source", [5, 2, 1]).count() == 0
    assert mixing.mixture(no_docs, "doc_id", "text", "source", [5, 2, 1]).count() == 0


# --- sharding


def test_shards_and_slots(docs, no_docs, awkward):
    out = sharding.shard_records(docs, "doc_id", "text", [1.0] * 8, [1.0])
    got = rows_of(out, "key", "size", "text_crc32", "shard", "slot", "grown_shard")
    assert sorted(x[1:3] for x in got) == sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in awkward)
    slots, shard_of = collections.defaultdict(list), {}
    for key, _, _, shard, slot, grown in got:
        slots[shard].append(slot)
        assert shard_of.setdefault(key, shard) == shard and grown in (shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_records(no_docs, "doc_id", "text", [1.0] * 8, [1.0]).count() == 0


def test_weights_decide_the_shares_and_lost_shards_move_only_their_rows(spark):
    keys = spark.range(20_000)
    both = keys.select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0]).alias("a"), sharding.rendezvous(F.col("id"), [1.0, 0.0, 1.0]).alias("b")).collect()
    share = collections.Counter(r["a"] for r in both)
    assert abs(share[1] / 20_000 - 0.5) < 0.02
    assert all(r["a"] == r["b"] for r in both if r["a"] != 1)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [0.0])


def test_a_repeated_row_spreads_over_slots(table):
    rows = [(1, "x", "en", "a", 1)] * 3000 + [(i, "y", "en", "a", 1) for i in range(2, 200)]
    got = rows_of(sharding.shard_records(table(rows), "doc_id", "text", [1.0] * 2), "shard", "slot")
    for s in (0, 1):
        own = sorted(slot for shard, slot in got if shard == s)
        assert own == list(range(len(own)))


def test_shards_are_written_whole(docs, spark, tmp_path):
    sharding.write_shards(docs, "doc_id", [1.0] * 3, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# --- fingerprints


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints_of_documents_and_edits(docs, no_docs, awkward):
    got = fingerprints.edit_and_compare(docs, "doc_id", "text").collect()
    assert len(got) == len(awkward)
    by_text, texts = {}, collections.Counter()
    ordered = sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0))
    edits = collections.defaultdict(set)
    for i, (key, text, *_) in enumerate(ordered):
        text = text or ""
        texts[(key, len(text))] += 1
        for other in ordered:  # ties in order by key: any document of the next key, or of the same one
            nxt, half = other[1] or "", len(text) // 2
            edits[(key, len(text))].add(hashlib.sha256((text[: len(text) - half] + nxt[:half]).encode()).hexdigest())
    assert collections.Counter((r["key"], r["n_chars"]) for r in got) == texts
    for r in got:
        assert r["edited_sha256"] in edits[(r["key"], r["n_chars"])] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert len(r["fingerprint"]) in (0, 256)
    assert fingerprints.edit_and_compare(no_docs, "doc_id", "text").count() == 0


def test_edits_follow_the_order_of_ids(table):
    rows = [(i * 3 % 50, passage(i * 40, 30 + i), "en", "a", 1) for i in range(50)]
    got = {r["key"]: r for r in fingerprints.edit_and_compare(table(rows), "doc_id", "text").collect()}
    by_id = {r[0]: r[1] for r in rows}
    for i in range(50):
        text, nxt = by_id[i], by_id[(i + 1) % 50]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        a, b = shingles(text), shingles(edited)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i]["near_edited"] - len(a & b) / len(a | b)) < 0.2 and got[i]["near_next"] < 0.05
    mean = np.mean([got[i]["near_edited"] - len(shingles(by_id[i]) & shingles(by_id[i][: len(by_id[i]) - len(by_id[i]) // 2])) / 1e9 for i in range(50)])
    assert 0.2 < mean < 0.5


def test_a_single_document_follows_itself(table):
    got = fingerprints.edit_and_compare(table([(1, passage(0, 50), "en", "a", 1)]), "doc_id", "text").first()
    assert got["near_next"] == 1.0


def test_likeness_of_known_overlaps(spark):
    base = [f"t{i}" for i in range(1000)]
    for share in (0.9, 0.5, 0.1):
        pairs = [(" ".join(f"{x}_{r}" for x in base), " ".join(f"{x}_{r}" for x in base[: int(1000 * share)]) + " " + passage(r * 5000, 1000 - int(1000 * share))) for r in range(20)]
        df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(spark.createDataFrame(pairs, "a string, b string"), "a", "fa"), "b", "fb")
        got = [r["x"] for r in df.select(fingerprints.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()]
        true = np.mean([len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs])
        assert abs(np.mean(got) - true) < 0.04


# --- language


def test_language_is_learned_and_wordless_texts_are_undetermined(table, awkward, docs, no_docs):
    vocabulary = {"en": "the house and the garden with", "de": "das haus und der garten mit", "fr": "la maison et le jardin avec"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.permutation(vocabulary[k].split() * 3)), k, "a", 1) for i in range(120) for k in [list(vocabulary)[i % 3]]]
    rows += [(500, None, "en", "a", 1), (501, "123 !? 4", "en", "a", 1), (502, "", None, "a", 1), (None, "das haus und", None, "a", 1)]
    got = language.identify(table(rows), "doc_id", "text", "lang").collect()
    by_id = {r["key"]: r for r in got}
    assert all(by_id[i]["lang"] == k and by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, k, *_ in rows[:120])
    assert all(by_id[i]["lang"] == "und" and by_id[i]["score"] == 0 for i in (500, 501, 502))
    assert by_id[None]["lang"] == "de" and not by_id[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got)
    assert len(language.identify(docs, "doc_id", "text", "lang").collect()) == len(awkward)
    assert language.identify(no_docs, "doc_id", "text", "lang").count() == 0


def test_nothing_is_learned_from_held_out_rows(table):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "das haus", "xx" if i in held else "de", "a", 1) for i in range(200)]
    assert {r["lang"] for r in language.identify(table(rows), "doc_id", "text", "lang").collect()} == {"de"}


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fits(kind, value):
        d = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if fits(kind, m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="01245.@+- ()ab_%é4", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == plain_spans(text)


def test_checked_spans_and_context():
    assert [s[:3] for s in pii.find_spans("IBAN DE89 3704 0044 0532 0130 00 ok")][:1] == [("iban", 5, 32)]
    assert not [s for s in pii.find_spans("DE88 3704 0044 0532 0130 00") if s[0] == "iban"]
    assert [s[0] for s in pii.find_spans("my social security number: 123-45-6789")] == ["ssn"]
    assert not pii.find_spans("part 123-45-6789 in stock")
    alone, near = pii.find_spans("192.168.0.1")[0], pii.find_spans("server 192.168.0.1")[0]
    assert alone[3] < near[3]


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@a" * 50_000, "1." * 100_000, "+1" * 100_000, "A1" * 100_000):
        pii.find_spans(text)


def test_redaction(docs, no_docs, awkward):
    text = next(r[1] for r in awkward if r[0] == 12)
    found = {r["key"]: r["found"] for r in pii.scan(docs, "doc_id", "text").collect()}
    assert [tuple(s)[:3] for s in found[12]] == plain_spans(text) and found[1] == []
    clean = docs.where("doc_id = 12").select(pii.redact(F.col("text")).alias("t")).first()["t"]
    assert clean == "été 🙂 Über straße mail [EMAIL], [CARD], [PHONE] at [IP]"
    assert docs.where("doc_id = 1").select(pii.redact(F.col("text")).alias("t")).first()["t"] is None
    assert pii.scan(no_docs, "doc_id", "text").count() == 0


# --- substrings


def plain_removal(texts, size):
    all_words = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + size]) for w in all_words for i in range(len(w) - size + 1))
    out = []
    for w in all_words:
        hit = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                hit[i : i + size] = [True] * size
        out.append((len(w), sum(hit), " ".join(x for x, y in zip(w, hit) if not y)))
    return out


@pytest.mark.parametrize("size, cells", [(35, 25), (5, 16), (1, 16)])
def test_repeated_windows_go(docs, awkward, size, cells):
    got = rows_of(substrings.remove_repeated(docs, "doc_id", "text", size, cells), "key", "n_words", "n_removed", "kept")
    want = [(r[0], *x) for r, x in zip(awkward, plain_removal([r[1] for r in awkward], size))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_full_sketch_loses_nothing(table):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 6, 400)), "en", "a", 1) for i in range(60)]
    got = rows_of(substrings.remove_repeated(table(rows), "doc_id", "text", 6, 4), "key", "n_words", "n_removed", "kept")
    assert sorted(got) == sorted((r[0], *x) for r, x in zip(rows, plain_removal([r[1] for r in rows], 6)))


def test_no_documents_no_windows(no_docs):
    assert substrings.remove_repeated(no_docs, "doc_id", "text").count() == 0


# --- packing


def test_pieces_fill_windows(docs, no_docs, awkward, spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cut = packing.pieces(docs, "doc_id", "text", window=256, keep_ids=True)
    got = packing.pack(cut, window=256)
    rows, seqs = collections.Counter(), collections.defaultdict(list)
    for r in got.collect():
        rows[(r["key"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.Counter()
    for key, text, *_ in awkward:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            want[(key, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert rows == want
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    whole = packing.sequences(got, window=256).collect()
    assert sum(r["used"] for r in whole) == sum(n for _, n in (p for s in seqs.values() for p in s))
    assert all(len(r["ids"]) == (256 if r["used"] & (r["used"] - 1) else r["used"]) for r in whole)
    assert packing.pack(packing.pieces(no_docs, "doc_id", "text")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(0, 60))
def test_the_best_sum_is_found(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * i for s in sums for i in range(n + 1)}
    used = packing.fill(counts, room)
    assert all(n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=30))
def test_plans_use_up_all_pieces(histogram):
    used = collections.Counter()
    for p in packing.plan(dict(histogram), 64):
        assert sum(k * n for k, n in p.content.items()) <= 64
        for k, n in p.content.items():
            used[k] += n * p.times
    assert used == collections.Counter(histogram)


def test_windows_are_nearly_full():
    rng = np.random.default_rng(5)
    histogram = collections.Counter(rng.integers(1, 2049, 200_000).tolist())
    plan = packing.plan(dict(histogram), 2048)
    assert sum(k * n for k, n in histogram.items()) / (2048 * sum(p.times for p in plan)) > 0.99 and len(plan) < 20_000
