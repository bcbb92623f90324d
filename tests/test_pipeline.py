import base64
import json

from pyspark.sql import functions as F

from textloom import schemas
from textloom.sources import readers as R
from textloom.sources import writers as W
from textloom.streaming import pipelines as P

MAIL = "From: Ann Lee <ann@post.example>\nTo: Bob Ray <bob@post.example>, Cid <cid@post.example>\nSubject: Hello\nDate: Mon, 1 Jan 2024 10:00:00 +0000\n\nBody text\n"


def test_envelopes_dispatch(spark):
    enc = lambda s: base64.b64encode(s.encode()).decode()
    rows = [("raw", enc("<p>Hi <b>you</b></p>"), "a"), ("email", enc(MAIL), "b"), ("document", enc(json.dumps({"title": "T", "content": ["x"]})), "c"), ("pdf", enc("x"), "d"), ("raw", None, "e"), ("html", enc("<title>P</title><h1>H</h1>"), "f")]
    got = {r["source_doc_id"]: r for r in R.envelopes(spark.createDataFrame(rows, "datatype string, data string, source string")).collect()}
    assert got["a"]["content"] == ["Hi you"] and got["b"]["title"] == "Hello" and got["c"]["content"] == ["x"] and got["f"]["title"] == "P"
    assert got["d"]["error"] and got["e"]["error"] and not got["a"]["error"]
    triples = {tuple(t) for t in got["b"]["triples"]}
    assert ("Ann Lee", "rel:mailto", "Bob Ray") in triples and ("cid@post.example", "rel:instanceof", "email") in triples and ("Ann Lee", "rel:instanceof", "person") in triples


def test_json_folder_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("s", "1", "t", ["a"], [], False), ("s", "2", None, None, None, True)], schemas.DOCUMENT)
    W.json_documents(docs, str(tmp_path / "d"))
    back = R.json_documents(spark, str(tmp_path / "d"), lines=True)
    assert {r["source_doc_id"] for r in back.collect()} == {"1", "2"}
    first = back.where("source_doc_id = '1'").select("file")
    assert {r["source_doc_id"] for r in R.json_documents(spark, str(tmp_path / "d"), first, lines=True).collect()} <= {"2"}


def test_lexicons_and_conll(spark, tmp_path):
    (tmp_path / "l.txt").write_text("alpha\n\n beta \n")
    (tmp_path / "t.csv").write_text("instance,parent\nCTO,chief\n")
    (tmp_path / "c.conllu").write_text("# sent_id = s1\n# text = He runs\n1\tHe\the\tPRON\t_\t_\t2\tnsubj\t_\t_\n2\truns\trun\tVERB\t_\t_\t0\troot\t_\t_\n\n")
    assert [r["word"] for r in R.list_lexicon(spark, str(tmp_path / "l.txt"), "x").collect()] == ["alpha", "beta"]
    assert tuple(R.table_lexicon(spark, str(tmp_path / "t.csv"), [0, 1], "job").first()) == ("CTO", "job", "chief")
    assert [(r["sent_id"], r["lemma"], r["head"]) for r in R.conll_sentences(spark, str(tmp_path / "c.conllu")).orderBy("id").collect()] == [("s1", "he", 2), ("s1", "run", 0)]


def test_evaluation_files(spark, tmp_path):
    W.trec_run(spark.createDataFrame([(1, "d", 1, 0.5)], "qid int, doc_id string, rank int, score double"), str(tmp_path / "r"), "x")
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "1\tQ0\td\t1\t0.5\tx"


def test_stages_run_once_and_go_on(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    stages = [("arrivals", lambda s: P.first_arrivals(s, "t").select("doc_hash", "t")), ("upper", lambda s: s.select(F.upper("t").alias("t")))]
    spark.createDataFrame([("a",), ("b",), ("a",)], "t string").write.parquet(folder)
    status = P.run_pipeline(spark, folder, "t string", stages, root, "parquet")
    assert [s["status"] for s in status] == ["finished", "finished"] and not any(s["error"] for s in status)
    spark.createDataFrame([("b",), ("c",)], "t string").write.mode("append").parquet(folder)
    P.run_pipeline(spark, folder, "t string", stages, root, "parquet")
    assert sorted(r["t"] for r in spark.read.parquet(root + "/upper").collect()) == ["A", "B", "C"]


def test_windows(spark):
    e = spark.createDataFrame([("2024-01-01 10:05:00", "x", 1.0), ("2024-01-01 10:50:00", "x", 2.0), ("2024-01-01 11:05:00", "x", 4.0), (None, "x", 9.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in P.tumbling(e, "ts", "k", "v").collect()) == [1, 2]
    assert sorted(r["n"] for r in P.sessions(e, "ts", "k").collect()) == [1, 2]


def test_event_tags_over_the_whole_document(spark, tmp_path):
    from textloom.plans import pipeline_queries

    rows = [(1, "a", (0, 2)), (2, "a", (45, 3)), (3, "a", (38, 5)), (4, None, (1, 1)), (5, "a", None), (6, "b", (0, 60)), (7, "a", (None, 3))]
    spark.createDataFrame(rows, "emb_id bigint, source_doc_id string, position struct<start:int,length:int>").write.parquet(str(tmp_path / "doc_embeddings.parquet"))
    got = {r["emb_id"]: r["tags"] for r in pipeline_queries._event_tags(spark, str(tmp_path)).collect()}
    assert got == {1: "EE" + "O" * 46, 2: "O" * 45 + "EEE", 3: "O" * 38 + "E" * 5 + "O" * 5, 4: "OE", 6: "E" * 60, 7: "O" * 48}


def test_queries_without_the_removable_part():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "bm25_topk" in names
