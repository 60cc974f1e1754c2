"""Chats, nearest neighbours, the Jaccard join and the registered queries against brute force."""
import collections
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from squallframe.llm import chats, jaccard, neighbours
from squallframe.llm.common import components

from .conftest import passage, words

SF = "/root/testdata/sf0.001"


# --- chats


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab\\n\n<|", max_size=8), st.text(alphabet="<|\\im_start>end\n", max_size=30)), max_size=5))
def test_the_template_can_be_read_back(turns):
    assert chats.parse(chats.marked(turns)) == turns


def test_conversations_with_odd_rows(spark, table):
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", probe), (1, 1, "assistant", probe), (1, 1, "assistant", probe), (2, None, None, None), (2, 5, "assistant", ""), (None, 1, "assistant", "x")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i} <\\| a\nb") for i in range(300)]
    made = table(rows, "conv_id long, turn long, role string, text string", "place string, piece string, start string")
    pieces = chats.format_chats(made)
    got = {r["conv_id"]: r for r in chats.digests(pieces).collect()}
    by_conv = collections.defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    assert set(got) == set(by_conv)
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chats.marked([(x[2] or "", x[3] or "") for x in own]))
    assert {r["rewritten"] for r in pieces.collect()} == {0}
    assert chats.format_chats(made.limit(0)).count() == 0 and chats.digests(chats.format_chats(made.limit(0))).count() == 0


def test_templates_that_rewrite_history_are_seen(spark):
    def last_thought(turns):  # shows a thought only in the last turn
        return "".join(f"[{r}] {t if i == len(turns) - 1 else t.split('|')[-1]}\n" for i, (r, t) in enumerate(turns))

    rows = spark.createDataFrame([(1, 0, "assistant", "think|a"), (1, 1, "user", "b"), (2, 0, "user", "a"), (2, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["place"]): r["rewritten"] for r in chats.format_chats(rows, last_thought).collect()}
    assert got[(1, 1)] > 0 and got[(2, 1)] == 0


def test_spans_of_a_template_with_a_preamble_and_trimming():
    def template(turns):
        return "<s>" + "".join(f"{r}: {t.strip()} ;" for r, t in turns)

    piece, lo, hi, rewritten = chats.locate(template, [("user", "hi")], ("assistant", "  well;  "))
    assert (piece[lo:hi], rewritten) == ("well;", 0)


# --- nearest neighbours


def near_by_force(rows, query, k):
    own = dict(rows)[query]
    far = sorted((float(np.sqrt(((np.array(v, float) - np.array(own, float)) ** 2).sum())), i) for i, v in rows if i != query and len(v) == len(own))
    return far[:k]


def test_neighbours_with_copies_ties_and_unusable_vectors(table):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype("f4")]) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(1000, 1100)] + [(2000, [0.5, 0.5]), (2100, [0.5, 0.25]), (2001, [0.5, 0.5])]
    bad = [(3000, None), (3100, [0.0] * 8), (3200, [1.0, None] + [0.0] * 6), (3300, [float("nan")] * 8), (3400, [float("inf")] * 8), (3500, []), (None, [1.0] * 8)]
    made = table([*rows, *bad, rows[0]], "vec_id long, embedding array<float>", "id string, vec string, point string, list string")
    got = collections.defaultdict(list)
    for r in neighbours.search(made, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    asked = [i for i, _ in rows if i % 100 == 0]
    assert set(got) == set(asked)
    hits = total = 0
    for q in asked:
        want, own = near_by_force(rows, q, 10), sorted(got[q])
        assert [x[0] for x in own] == list(range(1, len(want) + 1))
        exact = {i: d for d, i in near_by_force(rows, q, len(rows))}
        assert all(abs(exact[i] - d) < 1e-12 for _, d, i in own)
        hits += len({i for _, i in want} & {i for *_, i in own})
        total += len(want)
    assert hits / total >= 0.9
    assert [(x[1], x[2]) for x in sorted(got[1000])] == [(0.0, i) for i in range(1001, 1011)]
    assert [x[2] for x in sorted(got[2000])] if 2000 in got else True
    assert neighbours.search(made.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10).count() == 0


def test_the_scan_drops_only_far_rows():
    rng = np.random.default_rng(1)
    rows, queries = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    kept = neighbours.scan(queries, rows, rotation, 10)
    hits = 0
    for q, found in zip(queries, kept):
        want = np.argsort(((rows - q) ** 2).sum(axis=1))[:10]
        hits += np.isin(want, found).sum()
        assert len(found) < 100
    assert hits >= 195


# --- the Jaccard join


def sets_of(texts, k, lower=str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})):
    out = []
    for t in texts:
        w = words((t or "").translate(lower))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def components_by_force(keys, sets, percent):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(zip(keys, sets))]


def test_links_of_awkward_documents(docs, no_docs, awkward):
    got = [(r["key"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs, "doc_id", "text").collect()]
    want = components_by_force([r[0] for r in awkward], sets_of([r[1] for r in awkward], 4), 85)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert jaccard.link_documents(no_docs, "doc_id", "text").count() == 0


def edited(rng, text, share):
    w = text.split()
    for i in rng.choice(len(w), max(1, int(len(w) * share)), replace=False):
        w[i] = f"x{rng.integers(1 << 40)}"
    return " ".join(w)


def near_copies():
    """Groups with edits of all strengths, a passage that all share, chains, and very short texts."""
    rng = np.random.default_rng(8)
    texts, hot = [], passage(100_000, 30)
    for g in range(25):
        base = passage(g * 1000, int(rng.integers(20, 200)))
        texts += [base] + [edited(rng, base, s) for s in rng.uniform(0.005, 0.08, 8)]
    chain = passage(50_000, 120)
    for _ in range(12):
        texts.append(chain)
        chain = edited(rng, chain, 0.02)
    texts += [f"{hot} {passage(200_000 + 60 * i, 40)}" for i in range(60)] + ["a b", "A B", "a", "a b c", "b a"] * 2
    return texts


def test_no_link_is_lost(table, monkeypatch):
    texts = near_copies()
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    want = components_by_force(list(range(len(texts))), sets_of(texts, 4), 85)
    for block in (4096, 16):  # the second one cuts blocks
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = [(r["key"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(table(rows), "doc_id", "text").collect()]
        assert sorted(got) == sorted(want)


def test_the_exact_search_needs_no_first_links(table, monkeypatch):
    monkeypatch.setattr(jaccard, "first_links", lambda texts, found, spec: found.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    texts = near_copies()
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = [(r["key"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(table(rows), "doc_id", "text").collect()]
    assert sorted(got) == sorted(components_by_force(list(range(len(texts))), sets_of(texts, 4), 85))


def test_trees_keep_every_pair_that_links():
    rng = np.random.default_rng(2)
    spec = jaccard.Spec()
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, int(rng.integers(5, 900))).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[int(len(base) * cut) :], rng.integers(0, 1 << 62, int(len(base) * cut)).astype(np.uint64)])) for cut in rng.uniform(0, 0.15, 5)]
    n, maps = np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets]
    link = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if spec.linked(len(np.intersect1d(sets[i], sets[j])), n[i], n[j])}
    got = {(min(i, j), max(i, j)) for a, b in jaccard.tree_pairs(n, maps, np.zeros(len(n), int), spec) for i, j in zip(a, b)}
    assert link and link <= got and len(got) < 4 * len(link)
    side = np.arange(len(n)) % 2
    across = {(min(i, j), max(i, j)) for a, b in jaccard.tree_pairs(n, maps, side, spec) for i, j in zip(a, b)}
    assert {p for p in link if side[p[0]] != side[p[1]]} <= across and all(side[i] != side[j] for i, j in across)


def test_blocks_do_not_repeat_pairs_nor_make_far_ones(spark):
    rng = np.random.default_rng(3)
    spec = jaccard.Spec()
    common = np.arange(1, 131, dtype=np.uint64)
    core = rng.integers(0, 1 << 62, 130).astype(np.uint64)
    sets = [np.unique(np.concatenate([core, rng.integers(0, 1 << 62, 5 if i < 4 else 30).astype(np.uint64)])) for i in range(40)]
    # all share ten blocks, but for one block that the first and the last row leave, so that no two blocks are alike
    rows = [(i, len(s), i, [int(t) for t in common[:10] if t != i + 1], zlib.compress(jaccard.bitmap(s))) for i, s in enumerate(sets)]
    named = spark.createDataFrame(rows, "id long, n long, root long, tokens array<long>, bits binary").withColumn("id", F.col("id").cast("decimal(38,0)"))
    link = {(i, j) for i in range(40) for j in range(i + 1, 40) if spec.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    made = [(int(r["a"]), int(r["b"])) for r in jaccard.met_in_blocks(jaccard.blocks_between(named), spec, False).collect()]
    assert len(made) == len(set(made)) and link == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)} and link <= set(made) and len(made) < 100


def test_only_unsettled_components_are_searched_again(spark):
    named = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6)], "id long, root long")
    pairs = spark.createDataFrame([(1, 3), (4, 5), (6, 5)], "a long, b long")
    links = spark.createDataFrame([(6, 5)], pairs.schema)
    # 1 and 3 did not link, but 2 and 3 may; 4 and 5 have no other pair; 6 and 5 are one component
    assert sorted(int(r["id"]) for r in jaccard.unsettled(named, pairs, links).collect()) == [1, 2, 3]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (301, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- the queries, and the pipeline


@pytest.mark.parametrize("name", ["op1_mix_sources", "op9_rendezvous_shards"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    canon = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([canon(r[c]) for c in names]) for r in df.collect()) == sorted(str([canon(v) for v in r]) for r in cur.fetchall())


SCHEMAS = {
    "op2_substring_dedup": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    "op3_format_chats": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    "op4_fingerprints": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    "op5_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op6_nearest_neighbours": "query_id:bigint rank:int vec_id:bigint score:double",
    "op7_pack_documents": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op8_personal_data": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op10_jaccard_components": "doc_id:bigint n_shingles:bigint component_id:bigint",
}


@pytest.mark.parametrize("name", SCHEMAS)
def test_queries_cover_their_tables(spark, name):
    df = entry.queries()[name](spark, SF)
    assert " ".join(f"{n}:{k}" for n, k in df.dtypes) == SCHEMAS[name]
    rows = df.collect()
    if SCHEMAS[name].startswith("doc_id"):
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def test_language_of_held_out_documents(spark):
    found = entry.queries()["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert held > 0.95


def test_pipeline_stages(spark, docs, no_docs, awkward):
    import corpus_pipeline as C
    from squallframe.session import settle

    assert len(C.STAGES) == 5
    known = settle(C.known_language(spark, docs, SF))
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in known.collect()} <= {1, 2, 3} | {r[0] for r in awkward}
    one = settle(C.one_of_each(spark, docs, SF))
    left = collections.Counter(r["doc_id"] for r in one.collect())
    want = components_by_force(list(range(len(awkward))), sets_of([r[1] for r in awkward], 5), 80)
    assert sum(left.values()) == len({c for _, n, c in want if n}) + sum(1 for _, n, _ in want if not n)
    assert left[12] == 1 and left[5] == 1 and left[8] == 0
    clean = C.without_personal_data(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(awkward)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean.collect())
    mixed = settle(C.mixed(spark, docs, SF))
    assert mixed.columns == docs.columns
    tokens = C.packed(spark, mixed, SF)
    assert tokens.where("start = 0").count() == mixed.count()
    empty = no_docs
    for _, stage in C.STAGES:
        empty = settle(stage(spark, empty, SF))
        assert empty.count() == 0


def test_pipeline_runs(spark):
    rows = entry.queries()["pipeline"](spark, SF).collect()
    assert rows and all(r["offset"] + r["length"] <= 2048 for r in rows)
