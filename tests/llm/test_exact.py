"""Counting, duplicates, containers and leaks against brute force, with nulls, ties, repetitions and empty tables."""

import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import components, containers, eval_leaks, format_duplicates, near_duplicates, term_counts

WORD = re.compile(r"[^\W_]+")


# near duplicates


def brute_pairs(texts, threshold=0.5):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").lower())
        if s := {tuple(w[k : k + 3]) for k in range(len(w) - 2)}:
            sets[i] = s
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def family(rng, n, words=60):
    base = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def records():
    rng = random.Random(5)
    texts = [t for _ in range(12) for t in family(rng, rng.randrange(1, 9))]
    texts += [texts[0], texts[0].upper().replace(" ", " - "), None, "", "two words", "one", " ".join(f"w{i}" for i in range(20_000))]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("shard", [20_000, 3])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(near_duplicates, "SHARD", shard)  # 3: every shard is cut into blocks
    rows = records()
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "record bigint, text string, id string, node int")
    got = [tuple(r) for r in near_duplicates.similar_pairs(df, "record", F.col("text")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(rows)


def test_groups_of_similar_records(spark):
    rows = records()
    pairs = brute_pairs(rows)
    df = spark.createDataFrame(rows, "record bigint, text string")
    got = {r["id"]: (r["group_id"], r["links"]) for r in near_duplicates.groups(df, "record", F.col("text")).collect()}
    assert set(got) == {x for p in pairs for x in p}
    assert all(got[a][0] == got[b][0] for a, b in pairs)


def test_bk_forest_finds_all_within_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, (300, 8), dtype=np.uint64)
    prints[100:150] = prints[:50] ^ (np.uint64(1) << rng.integers(0, 63, (50, 8), dtype=np.uint64))
    prints[150:160] = prints[0]
    tree = np.sort(rng.integers(0, 4, 300))
    forest = near_duplicates.BKForest(prints, tree)
    radius = np.full(300, 40)
    got = {(int(a), int(b)) for q, item, _ in forest.search(np.arange(300), prints, forest.root_of, radius) for a, b in zip(q, item, strict=True)}
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    assert got == {(a, b) for a in range(300) for b in range(300) if tree[a] == tree[b] and d[a, b] <= 40}


def test_fingerprints_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        x, y = near_duplicates.fingerprint(a), near_duplicates.fingerprint(b)
        d = [np.bitwise_count(near_duplicates.folded(x, w) ^ near_duplicates.folded(y, w)).sum() for w in (4, min(len(x), len(y)))]
        assert d[0] <= d[1] <= len(set(a.tolist()) ^ set(b.tolist()))


def test_pairs_at_the_threshold_share_a_shard(spark):
    """Sets around a similarity of one half, with sequences that a third of all records hold."""
    rng = random.Random(8)
    words = [f"v{k}" for k in range(4000)]
    common = " ".join(words[:30])
    rows = []
    for i in range(120):
        base = rng.sample(words, 60)
        cut = rng.randrange(10, 30)
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(base[: 60 - cut] + rng.sample(words, cut))), (3 * i + 2, f"{common} {' '.join(rng.sample(words, rng.randrange(3, 40)))}")]
    df = spark.createDataFrame(rows, "record bigint, text string")
    got = {tuple(r) for r in near_duplicates.similar_pairs(df, "record", F.col("text")).collect()}
    assert got == brute_pairs(rows) and len(got) > 100


def test_trees_prune_by_size_and_distance(monkeypatch):
    """Families of near sets of many sizes in one shard: what is visited, and what a search without pruning finds."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(20, 2000)), dtype=np.uint64)
        for _ in range(5):
            own = base.copy()
            own[rng.random(len(own)) < 0.05] ^= np.uint64(12345)
            sets.append(np.unique(own))
    size = np.array([len(x) for x in sets])
    monkeypatch.setattr(near_duplicates, "LEAST_BITS", 1 << 14)  # one length for all
    prints = np.stack([near_duplicates.fingerprint(x) for x in sets])
    shard, ids, work = np.zeros(len(sets), np.int64), np.arange(len(sets)), []
    found = {(int(a), int(b)) for x, y in near_duplicates.search_shards(shard, ids, size, prints, 0.8, None, work) for a, b in zip(x, y, strict=True)}
    true = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert true <= found and len(found) <= 1.2 * len(true) and sum(work) < 0.25 * len(sets) ** 2, (len(true), len(found), sum(work) / len(sets) ** 2)


def test_no_records(spark):
    df = spark.createDataFrame([], "record bigint, text string")
    assert near_duplicates.similar_pairs(df, "record", F.col("text")).count() == 0
    assert near_duplicates.groups(df, "record", F.col("text")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["group_id"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# duplicates hidden by formatting


def test_copies_by_text(spark):
    rng = random.Random(1)
    values = ["Ab c", "ab-C!", "abc", "acb", "é", "e", "", None, "12", "1 2", "x" * 50_000, ("X " * 50_000).strip()]
    rows = [(i, rng.choice(values), rng.choice(values)) for i in range(150)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "row bigint, a string, b string, kept_id string, _key string")
    strip = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    classes = defaultdict(list)
    for i, a, b in rows:
        classes[strip(a), strip(b)].append(i)
    fields = [F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))]
    got = {tuple(r) for r in format_duplicates.duplicate_rows(df, "row", fields).collect()}
    assert got == {(min(c), i) for c in classes.values() for i in c if i != min(c)}
    assert {tuple(r) for r in format_duplicates.collapse(df, "row", fields).collect()} == {(min(c), len(c)) for c in classes.values()}
    assert format_duplicates.duplicate_rows(df.where("false"), "row", fields).count() == 0


def test_triples_written_differently(spark):
    a = {"subject": {"content": ["La", "Mer"], "lemma_content": "la mer"}, "property": {"content": "is", "lemma_content": ["be"]}, "value": {"content": "big", "lemma_content": "big"}}
    b = json.dumps({"value": a["value"], "property": {"lemma_content": "BE!", "content": ["I", "s"]}, "subject": {"lemma_content": ["la", "mer"], "content": "LA mer\n"}}, indent=1)
    rows = [(1, json.dumps(a)), (2, b), (3, json.dumps(a).replace("big", "bíg")), (4, None), (5, "{broken"), (6, None)]
    assert {tuple(r) for r in format_duplicates.kg_duplicates(spark.createDataFrame(rows, "kg_id bigint, kg string")).collect()} == {(1, 2)}


# term counts


def test_counts_of_terms(spark, monkeypatch):
    monkeypatch.setattr(term_counts, "COUNTERS_PER_TASK", 3)  # counters are handed on early
    rng = random.Random(2)
    docs = [(o, [(rng.choice("aabcdé"), rng.randrange(3), rng.random() < 0.2) for _ in range(rng.randrange(12))]) for o in "xy" for _ in range(80)]
    df = spark.createDataFrame([*docs, ("x", None), ("y", [])], "origin string, tokens array<struct<term:string,weight:bigint,flag:boolean>>")
    n, recs, weight, flag = Counter(), Counter(), Counter(), set()
    for o, tokens in docs:
        recs.update({(o, t) for t, _, _ in tokens})
        for t, w, f in tokens:
            n[o, t] += 1
            weight[o, t] += w
            flag |= {(o, t)} if f else set()
    got = {(r["origin"], r["term"]): (r["occurrences"], r["records"], r["weight"], r["flagged"]) for r in term_counts.count_terms(df).collect()}
    assert got == {k: (n[k], recs[k], weight[k], k in flag) for k in n}


TAGGED = "tagged_id bigint, source_doc_id string, data_source string, content_morphosyntax array<struct<pos:string,lemma:string,text:string,is_oov:boolean,is_sent_start:boolean,position:int>>, tagged_at timestamp"
NAMES = "relation_id bigint, batch_id bigint, sentence string, count bigint, triple_type string"


def test_marks_and_dirty_rows(spark):
    from datetime import datetime

    tok = lambda lemma, pos="NOUN", oov=False: (pos, lemma, lemma, oov, False, 0)
    day = lambda d: datetime(2024, 1, d)
    tagged = [(i, f"d{i}", None, [tok(" Common "), tok("rare" if i == 1 else "mid"), tok("x", "PUNCT"), tok(None), tok(" ")], day(1)) for i in range(1, 9)]
    tagged += [(20, "d1", None, [tok("common"), tok("late", oov=True)], day(5)), (21, "d1", None, [tok("old")], day(3)), (22, None, None, [tok("none")], day(9)), (23, "d9", None, None, day(1))]
    names = [(1, 1, "####S####A b", 1, "subject"), (2, 1, " a B", 9, "subject"), (3, 2, "c", 5000, "object"), (4, 2, None, 1, "object"), (5, 3, "d", None, "keyword"), (6, 3, "e", 1, None)]
    got = {tuple(r) for r in term_counts.marked_terms(spark.createDataFrame(tagged, TAGGED), spark.createDataFrame(names, NAMES)).collect()}
    assert got == {("lemma", "common", "common"), ("lemma", "mid", "common"), ("lemma", "late", "rare_oov"), ("subject", "a b", "rare"), ("object", "c", "common"), ("keyword", "d", "rare")}
    assert term_counts.marked_terms(spark.createDataFrame([], TAGGED), spark.createDataFrame([], NAMES)).count() == 0


# containers


def test_best_fill_is_the_best():
    rng = random.Random(3)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 15) for _ in range(rng.randrange(1, 8)))
        room = rng.randrange(0, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        fill = containers.best_fill(sorted(counts, reverse=True), counts, room)
        assert all(0 < n <= counts[length] for length, n in fill.items())
        assert sum(length * n for length, n in fill.items()) == max(s for s in sums if s <= room)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(4)
    items = [(i, rng.choice([0, 1, 7, 50, 64, 99, 100, 101, 250, 1000])) for i in range(2000)]
    rows = containers.pack(spark.createDataFrame(items, "item bigint, tokens bigint"), 100).collect()
    used = Counter()
    for r in rows:
        if r["n_tokens"]:
            used[r["container"]] += r["n_tokens"]
    assert max(used.values()) <= 100
    assert {(i, n) for i, n in items} == {(i, sum(r["n_tokens"] for r in rows if r["item"] == i)) for i, _ in items}
    assert all(len([1 for r in rows if r["item"] == i]) == max(1, -(-n // 100)) for i, n in items)
    assert len(used) <= 1.02 * sum(n for _, n in items) / 100 + 1
    assert containers.pack(spark.createDataFrame([], "item bigint, tokens bigint"), 100).count() == 0


def test_stretches_are_tokenized_as_the_whole():
    enc = containers.encoder(containers.TOKENIZER)
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " the", "  two", "\n\n", " 12", "!", "é", " don't", "\t"]) for _ in range(4000))
    assert sum(len(enc.encode_ordinary(s)) for s in containers.stretches(text, 200)) == len(enc.encode_ordinary(text))
    assert "".join(containers.stretches(text, 200)) == text


def test_sizes_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "a" * 9000)], "doc_id bigint, text string")
    got = {r["item"]: r["n_tokens"] for r in containers.pack_texts(rows, "doc_id", "text").where("piece = 0").collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and 0 < got[4] <= 2048


# leaks


@pytest.mark.parametrize(("shard", "block"), [(400_000, 2_000_000), (50, 40)])
def test_leaks_equal_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(eval_leaks, "MAX_TEST_WORDS", block)
    rng = random.Random(7)
    word = lambda: rng.choice("abcde") + rng.choice("xyz")
    items = [(q, " ".join(word() for _ in range(rng.randrange(5, 40)))) for q in range(12)] + [(90, None), (91, ""), (5, "x")]
    docs = []
    for d in range(40):
        parts = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            w = rng.choice(items[:12])[1].split()
            a = rng.randrange(len(w))
            parts[5:5] = w[a : a + rng.randrange(5, 30)]
        docs.append((d, ", ".join(parts).upper() if d % 3 else "\n".join(parts)))
    docs += [(100, None), (101, ""), (7, docs[7][1]), (102, " ".join(t for _, t in items[:12]) + " zz " * 3000)]
    grams = defaultdict(set)
    for q, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 5):
            grams[tuple(w[k : k + 6])].add(q)
    expected = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        expected |= {(q, d) for k in range(len(w) - 5) for q in grams.get(tuple(w[k : k + 6]), ())}
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, qid int").repartition(3)
    found = eval_leaks.leaks(df, spark.createDataFrame(items, "qid bigint, description string"), 6).collect()
    assert {(r["qid"], r["doc_id"]) for r in found} == expected and len(found) == len(expected)
    clean = eval_leaks.clean(df, spark.createDataFrame(items, "qid bigint, description string"), 6)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for _, d in expected}


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "qid bigint, description string")
    assert eval_leaks.leaks(docs, items).count() == 0
    assert eval_leaks.leaks(spark.createDataFrame([(1, "a b")], docs.schema), items).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    a = np.r_[rng.integers(1, 4, 300), -1]
    sa = eval_leaks.suffix_array(a, np.arange(300))
    assert [tuple(a[i:]) for i in sa] == sorted(tuple(a[i:]) for i in range(300))
