from pyspark.sql import functions as F

from textloom.config import SearchPolicy
from textloom.operators import annotate as A
from textloom.operators import corpora as C
from textloom.operators import knowledge as G
from textloom.operators import scoring as S
from textloom.plans.engine import Engine

TOKENS = [("The", "DET"), ("old", "ADJ"), ("river", "NOUN"), ("bank", "NOUN"), ("was", "AUX"), ("seen", "VERB"), ("by", "ADP"), ("Ann", "PROPN"), (".", "PUNCT")]

TREEBANK = [
    ("1", 1, "The", "the", "DET", 2, "det"), ("1", 2, "engineer", "engineer", "NOUN", 3, "nsubj"), ("1", 3, "checks", "check", "VERB", 0, "root"), ("1", 4, "a", "a", "DET", 5, "det"), ("1", 5, "line", "line", "NOUN", 3, "obj"),
    ("2", 1, "A", "a", "DET", 2, "det"), ("2", 2, "nurse", "nurse", "NOUN", 3, "nsubj"), ("2", 3, "reads", "read", "VERB", 0, "root"), ("2", 4, "the", "the", "DET", 5, "det"), ("2", 5, "note", "note", "NOUN", 3, "obj"),
    ("2", 6, "and", "and", "CCONJ", 7, "cc"), ("2", 7, "signs", "sign", "VERB", 3, "conj"), ("2", 8, "the", "the", "DET", 9, "det"), ("2", 9, "report", "report", "NOUN", 7, "obj"),
    ("3", 1, "It", "it", "PRON", 2, "nsubj"), ("3", 2, "rains", "rain", "VERB", 0, "root"),
]


def tokens(spark):
    return spark.createDataFrame([(1, 0, i, t, p) for i, (t, p) in enumerate(TOKENS)], "doc bigint, sent int, pos_no int, text string, pos string")


def test_rules_tag_words(spark):
    words = spark.createDataFrame([(w,) for w in ("The", "quickly", "Paris", "walked", "famous", "river", "12", "!")], "term string")
    assert [r["pos"] for r in A.tag_words(words).collect()] == ["DET", "ADV", "PROPN", "VERB", "ADJ", "NOUN", "NUM", "PUNCT"]


def test_patterns_and_triples(spark):
    spans = {(r["label"], r["start"], r["n"]) for r in A.pattern_spans(tokens(spark)).collect()}
    assert ("noun_group", 0, 4) in spans and ("verb_group", 4, 3) in spans and ("noun_group", 7, 1) in spans
    got = [tuple(r)[2:5] for r in C.adjacent_triples(tokens(spark)).collect()]
    assert got == [("old river bank", "was seen by", "Ann")]


def test_entities_are_validated(spark):
    spans = spark.createDataFrame([(1, 7, 1, "person"), (1, 2, 1, "person"), (1, 0, 1, "thing")], "doc bigint, start int, n int, label string")
    kept = A.valid_entities(spans, tokens(spark), {"person": ({"PROPN", "NOUN"}, {"PROPN"})})
    assert {(r["start"], r["label"]) for r in kept.collect()} == {(7, "person")}


def test_syntax_triples(spark):
    rows = spark.createDataFrame(TREEBANK, "sent_id string, id int, form string, lemma string, upos string, head int, deprel string")
    assert {tuple(r) for r in C.syntax_triples(rows, ["sent_id"]).collect()} == {("1", "engineer", "check", "line"), ("2", "nurse", "read", "note"), ("2", "nurse", "sign", "report")}


def test_role_clauses_need_known_classes(spark):
    columns = "doc bigint, s string, p string, o string, cs int, cp int, co int"
    docs = spark.createDataFrame([(1, "a", "b", "c", 5, 5, 5), (2, "A", "x", "y", 5, -1, -1)], columns)
    query = spark.createDataFrame([(9, "a", "b", "c", 5, 5, 5)], columns).withColumnRenamed("doc", "qid")
    assert {(r["doc"], r["score"]) for r in G.role_clauses(docs, query).collect()} == {(1, 7.0)}


def test_boosts_and_questions(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 3)], "o string, n bigint")
    assert {r["o"]: r["boost"] for r in G.concept_boosts(counts).collect()} == {"a": 0.005, "b": 10.005}
    rows = spark.createDataFrame([(1, "Ann", "rel:instanceof", "person"), (1, "x", "rel:instanceof", "email")], "doc bigint, s string, p string, o string")
    assert [r["question"] for r in G.entity_questions(rows).collect()] == ["Who is Ann?"]


def test_hashed_vectors_have_unit_length(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "blue fox house"), (3, None)], "id bigint, t string")
    lengths = {r["id"]: round(sum(x * x for x in r["embedding"]), 3) for r in A.hashed_vectors(df, "id", "t").collect()}
    assert lengths == {1: 1.0, 2: 1.0, 3: 0.0}


def test_phrases_of_long_sentences(spark):
    words = [f"w{i}" for i in range(70)]
    marks = [i in (20, 40) for i in range(70)]
    row = spark.createDataFrame([(words, marks)], "t array<string>, m array<boolean>")
    got = row.select(S.split_phrases(F.col("t"), F.col("m"))).first()[0]
    assert all(len(p.split()) <= 30 for p in got) and " ".join(got).split() == [w for i, w in enumerate(words) if i not in (20, 40)]


def test_engine(spark):
    docs = spark.createDataFrame([(1, "the red fox", "x"), (2, "a red house", "y"), (3, "green fox", "z")], "id bigint, text string, note string")
    engine = Engine.build(docs, "id", "text")
    queries = spark.createDataFrame([(7, "red fox")], "qid bigint, query string")
    got = engine.search(queries, SearchPolicy(size=2, excludes=("note",))).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 3] or [r["doc_id"] for r in got] == [1, 2]
    assert "note" not in got[0].asDict() and got[0]["normalized"] == 1.0
    qrels = spark.createDataFrame([(7, 1, 1)], "qid bigint, doc_id bigint, rel int")
    assert engine.evaluate(queries, qrels).where("k = 10").first()["mrr"] == 1.0
    assert engine.expand(queries, qrels).count() >= 2
    assert engine.see_also(docs.selectExpr("id as doc_id")).count() >= 0


def test_all_words_of_a_query_are_searched_unless_cut(spark, tmp_path):
    from textloom.plans import retrieval_queries

    docs = spark.createDataFrame([(1, "how many units of power does duviva own"), (2, "how many units there are"), (3, "own power")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(7, "How many units of power does Duviva own?")], "qid bigint, query string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    queries.write.parquet(str(tmp_path / "eval_queries.parquet"))
    assert [r["doc_id"] for r in retrieval_queries._match_and(spark, str(tmp_path)).collect()] == [1]
    engine = Engine.build(docs, "doc_id", "text")
    assert {r["doc_id"] for r in engine.search(queries, SearchPolicy()).collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in engine.search(queries, SearchPolicy().with_text({"cut_query": "3"})).collect()} == {1, 2}
