import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.config import SearchPolicy, from_environment
from textloom.operators import corpora as C
from textloom.operators import evaluation as E
from textloom.operators import index as I
from textloom.operators import keywords as K
from textloom.operators import knowledge as G
from textloom.operators import lexicon as L
from textloom.operators import retrieval as R
from textloom.operators import scoring as S
from textloom.operators import vectors as V

DOCS = [(1, "the red fox and the dog"), (2, "a red red house"), (3, ""), (4, None), (5, "dog house of the fox")]


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    toks = I.tokens(docs, "doc_id", "text")
    return docs, toks, I.postings(toks), I.lengths(docs, "doc_id", "text")


def test_index_statistics(parts):
    _, toks, posts, dl = parts
    assert toks.count() == posts.agg(F.sum("tf")).first()[0] == dl.agg(F.sum("dl")).first()[0] == 15
    assert {r["term"]: (r["df"], r["ttf"]) for r in I.term_stats(posts).collect()}["red"] == (2, 3)
    assert tuple(I.field_stats(posts).first()) == (3, 13, 15)


def test_bm25_by_hand(spark, parts):
    _, _, posts, dl = parts
    terms = R.query_terms(spark.createDataFrame([(7, "red")], "qid bigint, query string"))
    got = {r["doc_id"]: r["score"] for r in R.match_or(posts, dl, terms).collect()}
    n, df, avgdl = 5, 2, 3.0
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    assert got == {d: pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl)), abs=1e-6) for d, tf, length in ((1, 1, 6), (2, 2, 4))}


def test_clauses(spark, parts):
    _, toks, posts, dl = parts
    terms = R.query_terms(spark.createDataFrame([(7, "red fox"), (8, "")], "qid bigint, query string"))
    found = R.match_or(posts, dl, terms)
    assert {r["doc_id"] for r in R.match_and(found, terms).collect()} == {1}
    must = spark.createDataFrame([(7, 2, 1.0)], "qid bigint, doc_id bigint, score double")
    assert [r["doc_id"] for r in R.boolean([found], [must]).collect()] == [2]
    phrase = spark.createDataFrame([("a", ["red", "fox"]), ("b", ["fox", "dog"])], "phrase_id string, terms array<string>")
    assert {tuple(r) for r in R.phrases(toks, phrase).collect()} == {("a", 1, 1)}
    assert {tuple(r) for r in R.phrases(toks, phrase, slop=2).collect()} == {("a", 1, 1), ("b", 1, 2)}


def test_penalties_are_shares(spark, parts):
    _, _, posts, dl = parts
    terms = R.query_terms(spark.createDataFrame([(7, "red fox bird")], "qid bigint, query string"))
    rows = R.penalties(R.match_or(posts, dl, terms), posts, terms).collect()
    assert all(0 <= r["penalty"] <= 1 for r in rows)
    assert {r["strategy"]: r["penalty"] for r in rows if r["doc_id"] == 1} == {"no-normalization": 1.0, "by-query-size": 0.666667, "by-document-size": 0.4, "by-union-size": 0.333333, "by-intersection-size": 1.0, "intersection-size": 0.5}


def test_keywords(spark):
    words = [("deep", "ADJ"), ("neural", "ADJ"), ("network", "NOUN"), ("of", "ADP"), ("network", "NOUN"), (".", "PUNCT"), ("last", "ADJ")]
    tokens = [(p, w, w, False, i == 0, i) for i, (w, p) in enumerate(words)]
    df = spark.createDataFrame([(1, tokens), (2, None)], "id bigint, t array<struct<pos string, lemma string, text string, is_oov boolean, is_sent_start boolean, position int>>")
    phrases = K.candidate_phrases(K.tagged_tokens(df, "id", "t"))
    got = {r["phrase"]: r["score"] for r in K.rank(phrases).collect()}
    assert got == {"deep neural network": 3 + 3 + 2, "network": 2}  # network: degree 4 of 2 phrases


def test_graph(spark):
    rows = spark.createDataFrame([(1, "a", "p", "b", 1, 2, 3), (1, "a", "p", "b", 1, 2, 3), (2, "a", "p", "b", 1, 2, 3), (2, "", "p", "c", -1, 2, 4)], "doc bigint, s string, p string, o string, cs int, cp int, co int")
    assert G.distinct_triples(rows).count() == 3
    assert {tuple(r) for r in G.graph_overlap(rows, rows).collect()} == {(1, 2, 1), (2, 1, 1)}
    groups = {(r["grouping"], r["key"]): r["n"] for r in G.role_groupings(rows).collect()}
    assert groups["spo", "#1|#2|#3"] == 3 and groups["s", "#1|p|b"] == 3 and len({g for g, _ in groups}) == 7
    units = {(r["triple_type"], r["sentence"]): r["count"] for r in G.relation_units(rows).collect()}
    assert units == {("subject", "a"): 3, ("relation", "p"): 4, ("object", "b"): 3, ("object", "c"): 1}


def test_units_of_placed_triples_and_keywords(spark, tmp_path):
    from textloom.plans import catalog

    role = "struct<content:array<string>,lemma_content:array<string>,positions:array<int>,class:int>"
    part = lambda text, *at: ([text], None, list(at) if at else None, None)
    kg = [(part("a", 1), part("p", 2), part("b", 3), None, None), (part("a", 1), part("q", -1), part("c", 3), None, None), (part("x", -1), part("p", 2), part("b", 3), None, None), (part("d"), part("p", -1, 2), part("b", 4), None, None)]
    spark.createDataFrame([(1, kg)], f"record_id bigint, kg array<struct<subject:{role},property:{role},value:{role},field_type:string,confidence:double>>").write.parquet(str(tmp_path / "converted_docs.parquet"))
    token = lambda w, pos: (pos, w, w, False, False, 0)
    tagged = [(n, [token("wind", "NOUN"), token("farm", "NOUN"), token("the", "DET")]) for n in (1, 2)]
    spark.createDataFrame(tagged, "tagged_id bigint, content_morphosyntax array<struct<pos:string,lemma:string,text:string,is_oov:boolean,is_sent_start:boolean,position:int>>").write.parquet(str(tmp_path / "tagged_docs.parquet"))
    got = {tuple(r) for r in catalog.queries()["relation_units"](spark, str(tmp_path)).select("triple_type", "sentence", "count", "n_contexts").collect()}
    assert got == {("subject", "a", 1, 1), ("subject", "d", 1, 1), ("relation", "p", 2, 2), ("object", "b", 2, 2), ("keyword", "wind farm", 2, 1)}


def test_overlap_counts_triples_of_many_documents(spark):
    rows = spark.createDataFrame([(d, "a", "p", "b") for d in range(60)] + [(d, "c", "p", "b") for d in (3, 7)], "doc bigint, s string, p string, o string")
    want = {(q, d): 1 + ({q, d} == {3, 7}) for q in (3, 20) for d in range(60) if d != q}
    queries = spark.createDataFrame([(3,), (20,), (20,), (None,), (99,)], "doc bigint")
    for found in (G.graph_overlap(rows, queries), G.graph_overlap(rows, queries, block=7)):
        assert {(r["query"], r["doc"]): r["shared"] for r in found.collect()} == want


def test_longest_match_takes_the_longest_from_left(spark):
    lex = L.build(spark.createDataFrame([("New York", "city"), ("new york times", "paper"), ("times", "word"), ("!!", "x"), (None, "y")], "w string, l string"), "w", "l")
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate("the new york times and new york".split())], "doc_id bigint, pos int, term string")
    found = L.without_overlap(L.candidate_matches(toks, lex))
    assert {tuple(r) for r in found.collect()} == {(1, 1, 3, "paper"), (1, 5, 2, "city")}


def test_overlap_is_proper(spark):
    a = spark.createDataFrame([(1, 0, 2), (1, 2, 1), (1, 5, 1)], "doc_id bigint, start int, n int")
    b = spark.createDataFrame([(1, 1, 2)], "doc_id bigint, start int, n int")
    assert {r["start"] for r in L.drop_overlapping(a, b).collect()} == {5}
    assert {r["start"] for r in L.drop_overlapping(a, b.where("start > 9")).collect()} == {0, 2, 5}


def test_metrics_against_plain_loops(spark):
    rng = random.Random(3)
    run = [(q, r + 1, d, 20.0 - r) for q in (1, 2) for r, d in enumerate(rng.sample(range(40), 20))]
    qrels = [(q, d, rng.choice([0, 1, 2])) for q in (1, 2, 3) for d in range(0, 40, 3)]
    got = {(r["qid"], r["k"]): r for r in E.metrics(spark.createDataFrame(run, "qid bigint, rank int, doc_id bigint, score double"), spark.createDataFrame(qrels, "qid bigint, doc_id bigint, rel int"), (10, 50)).collect()}
    judged = {(q, d): rel for q, d, rel in qrels}
    for q in (1, 2, 3):
        for k in (10, 50):
            rels = [judged.get((q, d), 0) for qq, r, d, _ in run if qq == q and r <= k]
            scores = [s for qq, r, _, s in run if qq == q and r <= k]
            relevant = sorted((rel for (qq, _), rel in judged.items() if qq == q and rel > 0), reverse=True)
            hits = sum(x > 0 for x in rels)
            assert got[q, k]["precision"] == pytest.approx(hits / k, abs=1e-6)
            assert got[q, k]["recall"] == pytest.approx(hits / len(relevant), abs=1e-6)
            dcg, ideal = (sum(x / math.log2(i + 2) for i, x in enumerate(v)) for v in (rels, relevant[:k]))
            assert got[q, k]["ndcg"] == pytest.approx(dcg / ideal, abs=1e-6)
            ap = sum(sum(x > 0 for x in rels[: i + 1]) / (i + 1) for i, x in enumerate(rels) if x > 0) / len(relevant)
            assert got[q, k]["map"] == pytest.approx(ap, abs=1e-6)
            gini = sum(abs(a - b) for a in scores for b in scores) / (2 * (sum(scores) / len(scores))) if scores else -1
            assert got[q, k]["gini"] == pytest.approx(gini, abs=1e-5)


def test_blocks(spark):
    row = spark.createDataFrame([(["a", "b", "c", "d"], [3, 3, 9, 1])], "i array<string>, n array<int>")
    assert row.select(S.pack_blocks(F.col("i"), F.col("n"), 6)).first()[0] == [["a", "b"], ["c"], ["d"]]
    digits = spark.createDataFrame([([str(i) for i in range(80)],)], "t array<string>")
    assert [len(b) for b in digits.select(S.split_tokens(F.col("t"))).first()[0]] == [64, 16]


def test_sentiment_and_relabel(spark):
    sents = S.sentence_rows(spark.createDataFrame([(1, "It works. It failed badly."), (2, None)], "id bigint, t string"), "id", "t")
    lex = spark.createDataFrame([("works", 1), ("failed", -1)], "word string, sign int")
    assert [tuple(r) for r in S.sentiment(sents, lex).collect()] == [(1, 0.5, 0.5)]
    scores = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.6), (1, "c", 0.2)], "doc bigint, label string, score double")
    master = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "label string, master string")
    assert {r["label"]: r["score"] for r in S.relabel(scores, master, "sum").collect()} == {"x": 0.8, "y": 0.2}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id bigint, v array<float>")
    usable = V.usable(rows, "v", 2)
    assert {r["id"] for r in usable.collect()} == {1, 2, 3}
    top = V.cosine_top(usable.where("id = 3").selectExpr("id as qid", "v as vec"), usable, "id", "v", 2)
    assert [(r["id"], r["rank"]) for r in top.orderBy("rank").collect()] == [(3, 1), (1, 2)]


def test_splits_are_stable(spark):
    df = spark.range(1000).withColumn("x", F.lit(1))
    a, b = (Counter(r["split"] for r in C.splits(d, "id").collect()) for d in (df, df.repartition(7)))
    assert a == b and 50 < a["test"] < 160


def test_upkeep(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3), (4, "b", 1)], "id bigint, k string, t int")
    assert {r["id"] for r in I.upsert_latest(df, ["k"], [F.desc("t")]).collect()} == {2, 3, 4}
    assert {r["id"] for r in I.delete_by_id(df, df.where("id = 4"), "k").collect()} == {1, 2, 3}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    posts = I.postings(I.tokens(docs, "doc_id", "text"))
    terms = R.query_terms(spark.createDataFrame([(1, "red")], "qid bigint, query string"))
    assert R.match_or(posts, I.lengths(docs, "doc_id", "text"), terms).count() == 0
    assert I.field_stats(posts).first()["sum_ttf"] == 0


def test_results_are_described(spark):
    rows = spark.createDataFrame([(q, 10, x) for q, x in enumerate((0.0, 1.0, 2.0, 5.0))], "qid bigint, k int, map double")
    got = E.described(rows).first().asDict()
    assert got == {"k": 10, "metric": "map", "count": 4, "mean": 2.0, "std": pytest.approx(math.sqrt(14 / 3)), "min": 0.0, "q1": 0.75, "median": 1.5, "q3": 2.75, "max": 5.0}


def test_policy():
    policy = from_environment("X_", {"X_SIZE": "5", "X_NORMALIZE": "no", "X_EXCLUDES": "a, b", "Y_SIZE": "9"})
    assert (policy.size, policy.normalize, policy.excludes) == (5, False, ("a", "b"))
    assert policy.excluding("b", "c").excludes == ("a", "b", "c")
    with pytest.raises(KeyError):
        SearchPolicy().with_text({"nothing": "1"})


def test_long_patterns_and_phrases_match(spark):
    words = [f"w{i}" for i in range(12)]
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate(["x", *words, "y"])], "doc_id bigint, pos int, term string")
    lex = L.build(spark.createDataFrame([(" ".join(words), "long"), ("w3", "short")], "w string, l string"), "w", "l")
    assert {(r["start"], r["n"]) for r in L.candidate_matches(toks, lex).collect()} == {(1, 12), (4, 1)}
    assert L.candidate_matches(toks, lex.where("false")).count() == 0
    table = spark.createDataFrame([("p", words), ("q", words[:2])], "phrase_id string, terms array<string>")
    assert {(r["phrase_id"], r["start"]) for r in R.phrases(toks, table).collect()} == {("p", 1), ("q", 1)}


def test_centroids_move_with_batches(spark):
    from textloom.streaming import pipelines as P

    batch = spark.createDataFrame([("a", [1.0, 0.0], 1.0), ("a", [3.0, 2.0], 3.0), ("b", [5.0, 5.0], 2.0), (None, [9.0, 9.0], 1.0), ("a", None, 1.0), ("a", [9.0, 9.0], 0.0)], "l string, v array<double>, w double")
    state = P.update_centroids({}, batch, "l", "v", "w")
    assert state == {"a": (4.0, [2.5, 1.5]), "b": (2.0, [5.0, 5.0])}
    again = P.update_centroids(state, batch.where("l = 'b'").withColumn("v", F.array(F.lit(8.0), F.lit(2.0))), "l", "v", "w")
    assert again == {"a": (4.0, [2.5, 1.5]), "b": (4.0, [6.5, 3.5])}
