"""The run and judgements of the evaluation: equal to the SQL over odd rows, without a shuffle of all pairs."""

import math
import random

import duckdb
import pytest

from textloom.operators import index as I
from textloom.operators import ranking as K
from textloom.operators import retrieval as R
from textloom.plans import catalog

#: Queries of findings F1 to F7.
QUERIES = ["ir_mean_score", "ir_ndcg", "ir_precision", "ir_f1", "ir_overall", "ir_gini", "ir_map"]
N_DOCS, N_QUERIES = 6000, 12


def shuffled(spark):
    """Rows that all stages so far have written for a shuffle."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Every document holds a word of every query; texts recur, identifiers and texts are missing or repeated."""
    folder, rng = str(tmp_path_factory.mktemp("ranking")), random.Random(5)
    texts = [" ".join(["the", *rng.choices(["fox", "dog", "house", "red", "Blue", "7"], k=rng.randint(1, 9))]) for _ in range(300)]
    docs = [(i, rng.choice(texts)) for i in range(N_DOCS)] + [(3, "fox the red fox"), (3, None), (None, "the dog"), (None, "the fox"), (7000, None), (7001, "")]
    asked = [(q, f"the {rng.choice(['fox', 'dog red', 'Blue the', '7'])}", f"the {rng.choice(['house', 'fox fox'])}", rng.choice([None, 0, 1, 3])) for q in range(N_QUERIES)]
    asked += [(90, "", "the dog"), (91, None, None), (92, "the zebra", "?")]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*a, None)[:4] for a in asked], "qid bigint, query string, description string, relevance int").coalesce(1).write.parquet(f"{folder}/eval_queries.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_evaluation_shuffles_no_pairs_and_equals_sql(spark, tables, name):
    before = shuffled(spark)
    df = catalog.queries()[name](spark, tables)
    got = {tuple(r)[: 1 + (name != "ir_overall")]: tuple(r)[1:] for r in df.collect()}
    assert shuffled(spark) - before < N_DOCS * N_QUERIES
    with duckdb.connect() as con:
        for t in ("documents", "eval_queries"):
            con.sql(f"create view {t} as select * from read_parquet('{tables}/{t}.parquet/*.parquet')")
        want = {r[: 1 + (name != "ir_overall")]: r[1:] for r in con.sql(catalog.oracle_sql()[name]).fetchall()}
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1.1e-6) for k in want for a, b in zip(got[k], want[k], strict=True))


#: Queries held to what repeated queries cost.
REPEATED = ["ir_ndcg", "ir_precision", "ir_f1", "ir_overall", "ir_gini", "ir_map"]
TIMES = 30


@pytest.fixture(scope="module")
def repeated(spark, tables, tmp_path_factory):
    """Every query of ``tables`` under further identifiers; some of them differ in the relevance, the words or their order, one has none."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    asked = spark.read.parquet(f"{tables}/eval_queries.parquet").collect()
    rows = [(r.qid + 1000 * t, r.query, r.description, r.relevance) for t in range(TIMES) for r in asked]
    rows += [(50_001, "dog the", "the fox", 1), (50_002, "the dog", "the fox", None), (50_003, "the dog", "the fox", 2), (50_004, "the dog", None, 0), (None, "the fox", "the dog", 1)]
    spark.createDataFrame(rows, "qid bigint, query string, description string, relevance int").coalesce(1).write.parquet(f"{folder}/eval_queries.parquet")
    return folder


@pytest.mark.parametrize("name", REPEATED)
def test_repeated_queries_are_scored_once_and_equal_sql(spark, repeated, name):
    before = shuffled(spark)
    rows = [tuple(r) for r in catalog.queries()[name](spark, repeated).collect()]
    assert shuffled(spark) - before < N_DOCS * N_QUERIES
    n = 1 + (name != "ir_overall")
    with duckdb.connect() as con:
        for t in ("documents", "eval_queries"):
            con.sql(f"create view {t} as select * from read_parquet('{repeated}/{t}.parquet/*.parquet')")
        want = {r[:n]: r[n:] for r in con.sql(catalog.oracle_sql()[name]).fetchall()}
    got = {r[:n]: r[n:] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1.1e-6) for k in want for a, b in zip(got[k], want[k], strict=True))


def test_best_is_the_head_of_all_matches(spark, monkeypatch):
    """Also in blocks of few documents, in several passes over the queries, and for identifiers that are strings."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(rng.choices("abcdefgh", k=rng.randint(0, 6)))) for i in range(200)], "id string, text string")
    terms = R.query_terms(spark.createDataFrame([(q, " ".join(rng.choices("abcdxyz", k=3))) for q in range(8)], "qid bigint, query string"))
    posts, dl = I.postings(I.tokens(docs, "id", "text")), I.lengths(docs, "id", "text")
    want = sorted(tuple(r) for r in R.page(R.match_or(posts, dl, terms), size=15).select("qid", "rank", "doc_id", "score").collect())
    monkeypatch.setattr(K, "CELLS", 70)
    monkeypatch.setattr(K, "QUERY_ROWS", 9)
    for got in K.best(docs, "id", "text", [(terms, 15), (terms, 15)]):
        assert sorted(tuple(r) for r in got.collect()) == want


def test_repeated_identifiers_shuffle_no_other_documents(spark, tmp_path):
    """With tables above the threshold of broadcasts: documents are shuffled for the count of identifiers alone."""
    rows = [(i, i % 7 + 1, [i % 5, 9], [1, 2]) for i in range(N_DOCS)] + [(3, 4, [3, 8], [1, 5]), (None, 2, [1], [1]), (None, 3, [1, 2], [2, 1])]
    spark.createDataFrame(rows, "doc_id bigint, dl bigint, codes array<int>, tfs array<int>").repartition(2).write.parquet(f"{tmp_path}/coded")
    coded, kept = spark.read.parquet(f"{tmp_path}/coded"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {r.doc_id: (sorted(r.lens), dict(zip(r.codes, r.tfs, strict=True))) for r in K._by_document(coded).collect()}
        assert shuffled(spark) - before < 2 * N_DOCS
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = {i: ([i % 7 + 1], {i % 5: 1, 9: 2}) for i in range(N_DOCS)} | {3: ([4, 4], {3: 2, 9: 2, 8: 5}), None: ([], {1: 3, 2: 1})}
    assert got == want


def test_best_of_nothing(spark):
    docs, asked = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "qid bigint, query string")
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0))):
        assert K.best(d, "doc_id", "text", [(R.query_terms(q), 5)])[0].count() == 0
