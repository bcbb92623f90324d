"""Queries of sources, upkeep, corpora and streaming, each with its SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpora as C
from ..operators import index as I
from ..operators import keywords as K
from ..runtime import checkpoint_dir, load, materialize, parallelism
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import pipelines as P
from .registry import register
from .knowledge_queries import _TAGGED


def _csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.columns_to_documents(load(spark, sf_dir, "part"), "p_partkey", ["p_name"], ["p_name", "p_type"], ["p_brand", "p_type", "p_size"])
    return docs.select("source_doc_id", "title", F.explode("triples").alias("t")).select("source_doc_id", "title", "t.*")


register("csv_documents", _csv_documents, "select cast(p_partkey as varchar) as source_doc_id, p_name as title, unnest([p_brand, p_type, cast(p_size as varchar)]) as s, 'rel:is_a' as p, unnest(['p_brand', 'p_type', 'p_size']) as o from part")


def _patent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patent texts of the corpus with their source's parts as classes."""
    docs = load(spark, sf_dir, "documents").where("source like 'patent/%'").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.lit(None).cast("string").alias("abstract"), F.col("text").alias("description"), F.concat(F.lit("x|"), F.upper("source")).alias("assignees"))
    return R.patents(docs, "doc_id", "title", "abstract", "description").select("source_doc_id", "title", "converted", F.explode("triples").alias("t")).select("source_doc_id", "title", "converted", "t.s", "t.o")


register("patent_documents", _patent_documents, """select cast(doc_id as varchar) as source_doc_id, split_part(coalesce(title, ''), '|', 1) as title, coalesce(length("text"), 0) >= 256 as converted, lower(trim(upper(source))) as s, 'organization' as o from documents where source like 'patent/%'""")


def _raw_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.lit("raw").alias("datatype"), F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("data"), F.col("doc_id").cast("string").alias("source"))
    return R.envelopes(rows).select("source_doc_id", F.md5(F.coalesce(F.get("content", F.lit(0)), F.lit(""))).alias("digest"), "error")


register("envelopes_raw", _raw_envelopes, r"""
with t as (select cast(doc_id as varchar) as source_doc_id, coalesce("text", '') as t from documents),
b as (select source_doc_id, trim(t) = '' as error, regexp_replace(t, '<(nav|header|footer|script|style)\b.*?</(nav|header|footer|script|style)>', ' ', 'gis') as t from t)
select source_doc_id, md5(case when error then '' else trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) end) as digest, error from b""")


def _mail_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails written as messages from their own headers and bodies, and read again: the header's triples."""
    m = load(spark, sf_dir, "mail_docs").where("kg is not null")
    text = lambda e: F.array_join(e["content"], " ")
    of = lambda p, o: F.transform(F.filter("kg", lambda t: (text(t["property"]) == p) & (F.lit(o is None) | (text(t["value"]) == F.lit(o)))), lambda t: text(t["subject" if o else "value"]))
    person, address, sent, to = of("rel:instanceof", "person"), of("rel:instanceof", "email"), of("rel:instanceof", "date"), of("rel:mailto", None)
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    head = F.concat(F.lit("From: "), first(person), F.lit(" <"), first(address), F.lit(">\nTo: "), F.array_join(to, ", "), F.lit("\nDate: "), first(sent))
    raw = F.concat(head, F.lit("\nSubject: "), F.regexp_replace(F.coalesce("title", F.lit("")), r"[^\x20-\x7e]", ""), F.lit("\n\n"), F.concat_ws("\n", "content"))
    return R.mails(m.select("mail_id", raw.alias("raw")), "mail_id", "raw").select(F.col("source_doc_id").cast("bigint").alias("mail_id"), F.explode("triples").alias("t")).select("mail_id", "t.*")


register("mail_header_triples", _mail_envelopes, """select distinct mail_id, array_to_string(t.subject.content, ' ') as s, array_to_string(t.property.content, ' ') as p, array_to_string(t."value".content, ' ') as o
from (select mail_id, unnest(kg, max_depth := 1) as t from mail_docs)""")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of HTML, a paragraph for each line, and back: titles, headings and the whole text."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[<>]", " ")
    body = F.array_join(F.transform(F.split(plain("text"), "\n"), lambda x: F.concat(F.lit("<p class='x'>"), x, F.lit("</p>"))), "\n")
    html = F.concat(F.lit("<html><head><title> "), plain("title"), F.lit(" </title></head><body><nav>menu</nav><h1>"), plain("source"), F.lit("</h1>"), body, F.lit("<script>x = 1</script></body></html>"))
    d = load(spark, sf_dir, "documents").select("doc_id", html.alias("html"))
    return R.pages(d, "doc_id", "html").select("source_doc_id", "title", F.array_join(F.transform("triples", lambda t: t["s"]), "|").alias("headings"), F.md5(F.col("content")[0]).alias("digest"))


register("html_pages", _pages, r"""with d as (select doc_id, regexp_replace(coalesce(title, ''), '[<>]', ' ', 'g') as t, coalesce(source, '') as s, regexp_replace(coalesce("text", ''), '[<>]', ' ', 'g') as x from documents)
select cast(doc_id as varchar) as source_doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) as title, s as headings, md5(trim(regexp_replace(t || ' ' || s || ' ' || x, '\s+', ' ', 'g'))) as digest from d""")
register("exclude_antijoin", lambda s, d: I.not_yet_done(load(s, d, "documents").select("doc_id", "source"), load(s, d, "subject_labels").select("doc_id"), "doc_id"), "select doc_id, source from documents where doc_id not in (select doc_id from subject_labels where doc_id is not null)")
register("upsert_latest", lambda s, d: I.upsert_latest(load(s, d, "converted_docs").where("source_doc_id is not null"), ["source_doc_id"], [F.desc("ingested_at"), F.desc("record_id")]).select("source_doc_id", "record_id"), "select source_doc_id, record_id from converted_docs where source_doc_id is not null qualify row_number() over (partition by source_doc_id order by ingested_at desc, record_id desc) = 1")
register("delete_by_id", lambda s, d: I.delete_by_id(load(s, d, "converted_docs"), load(s, d, "converted_docs").where("error"), "source_doc_id").select("record_id"), "select record_id from converted_docs where source_doc_id is null or source_doc_id not in (select source_doc_id from converted_docs where error and source_doc_id is not null)")
register("merge_rows", lambda s, d: W.merge_latest(load(s, d, "nation").select("n_nationkey", "n_name"), load(s, d, "nation").select("n_nationkey", F.upper("n_name").alias("n_name")).where("n_nationkey < 5"), "n_nationkey"), "select cast(n_nationkey as bigint) as n_nationkey, case when n_nationkey < 5 then upper(n_name) else n_name end as n_name from nation")
register("conll_mask", lambda s, d: load(s, d, "tagged_docs").select("tagged_id", F.coalesce(C.mask_lemmas(F.col("content_morphosyntax")), F.lit("")).alias("masked")), "select tagged_id, coalesce(array_to_string([case when coalesce(t.pos in (" + ", ".join(f"'{p}'" for p in C.FUNCTION_POS) + r"""), true) or coalesce(regexp_full_match(t.lemma, '[!-/:-@\[-`{-~]*'), false) then '_' else coalesce(t.lemma, '_') end""" + " for t in content_morphosyntax], ' '), '') as masked from tagged_docs")


def _event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block's place tagged over its whole document, which ends with its last block."""
    e = load(spark, sf_dir, "doc_embeddings").where("position is not null").select("emb_id", "source_doc_id", F.col("position.start").alias("start"), (F.col("position.start") + F.col("position.length")).alias("end"))
    lengths = e.where("source_doc_id is not null").groupBy("source_doc_id").agg(F.max("end").alias("length"))
    # the lines of a document with many blocks are long: they are made after its rows are spread
    spread = e.join(lengths, "source_doc_id", "left").repartition(parallelism(spark), "emb_id")
    return spread.select("emb_id", C.tag_line(F.coalesce("length", "end", F.lit(0)), F.col("start"), F.col("end"), "E").alias("tags"))


register("event_tags", _event_tags, """
with e as (select emb_id, source_doc_id, cast(position.start as int) as a, cast(position.start + position."length" as int) as z from doc_embeddings where position is not null),
l as (select source_doc_id, max(z) as n from e where source_doc_id is not null group by 1)
select emb_id, case when n is null then '' else repeat('O', greatest(least(a, n), 0)) || repeat('E', greatest(least(z, n) - greatest(a, 0), 0)) || repeat('O', greatest(n - greatest(z, 0), 0)) end as tags
from (select emb_id, a, z, coalesce(l.n, z, 0) as n from e left join l using (source_doc_id))""")
register("label_map", lambda s, d: C.map_labels(load(s, d, "relation_names").select("relation_id", "triple_type"), "triple_type", {"subject": "subj", "object": "obj", "keyword": None}), "select relation_id, case triple_type when 'subject' then 'subj' when 'object' then 'obj' else triple_type end as triple_type from relation_names where triple_type is not null and triple_type <> 'keyword'")
register("stratify", lambda s, d: C.stratify(load(s, d, "documents").join(load(s, d, "subject_labels").select("doc_id", "subject").distinct(), "doc_id"), ["lang", "subject"], "doc_id"), "select lang, subject, count(*) as n, min(doc_id) as first, max(doc_id) as last from documents join (select distinct doc_id, subject from subject_labels) using (doc_id) group by lang, subject")
_FILE = ("coalesce(lang, 'xx')", "cast(doc_id as string)")
register(
    "file_language", lambda s, d: load(s, d, "documents").select("doc_id", T.file_language(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/x_y/"), F.expr(_FILE[0]), F.lit("_"), F.expr(_FILE[1]), F.lit(".conllu"))).otherwise(F.concat(F.lit("/x/corpus-part-"), F.expr(_FILE[0]), F.lit("-"), F.expr(_FILE[1])))).alias("language")),
    "select doc_id, coalesce(lang, 'xx') as language from documents",
)
register(
    "svo_adjacent", lambda s, d: C.adjacent_triples(K.tagged_tokens(load(s, d, "tagged_docs"), "tagged_id", "content_morphosyntax")),
    f"""with {_TAGGED},
k0 as (select *, case when pos in ('NOUN', 'PROPN', 'ADJ', 'DET', 'NUM') then 'n' when pos in ('VERB', 'AUX') then 'v' when pos = 'ADP' then 'a' else 'x' end as k from t),
k1 as (select *, case when k = 'a' and lag(k) over w = 'v' then 'v' else k end as kind from k0 window w as (partition by doc, sent order by pos_no)),
k2 as (select *, case when coalesce(lag(kind) over w, '') <> kind then 1 else 0 end as new from k1 window w as (partition by doc, sent order by pos_no)),
k3 as (select *, sum(new) over (partition by doc, sent order by pos_no) as g from k2),
gr as (select doc, sent, g, kind, coalesce(string_agg(text, ' ' order by pos_no) filter (where not (kind = 'n' and pos = 'DET')), '') as phrase, min(pos_no) filter (where not (kind = 'n' and pos = 'DET')) as start from k3 group by all),
ne as (select *, lag(kind) over w as k1, lag(phrase) over w as s, lead(kind) over w as k2, lead(phrase) over w as o from gr window w as (partition by doc, sent order by g))
select doc, sent, s, phrase as p, o, start from ne where kind = 'v' and k1 = 'n' and k2 = 'n' and s <> '' and o <> ''""",
)
_FLOOR = "select time_bucket(interval '{0}', ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(sum(value), 4) as total from (select ts::timestamp as ts, event_type, value from events) group by all"
_T = lambda s, d: load(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
register("event_tumbling", lambda s, d: P.tumbling(_T(s, d), "ts", "event_type", "value").drop("total").withColumn("start", F.unix_timestamp("start")), "select cast(epoch(start) as bigint) as start, event_type, n from (" + _FLOOR.format("1 hour") + ")")
register("event_sliding", lambda s, d: P.sliding(_T(s, d), "ts", "event_type", "value").drop("total").withColumn("start", F.unix_timestamp("start")), "select cast(epoch(start) as bigint) as start, event_type, count(*) as n from (select unnest([time_bucket(interval '30 minutes', ts, timestamp '1970-01-01'), time_bucket(interval '30 minutes', ts, timestamp '1970-01-01') - interval '30 minutes']) as start, event_type from (select ts::timestamp as ts, event_type from events)) group by all")
register("event_sessions", lambda s, d: P.sessions(_T(s, d), "ts", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest")), "with e as (select user_id, ts::timestamp as ts, case when ts::timestamp - lag(ts::timestamp) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e), c as (select user_id, k, count(*) as n from s group by all) select user_id, count(*) as sessions, max(n) as longest from c group by 1")


def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that land, read as a stream, each content passed on once."""
    landed = materialize(load(spark, sf_dir, "documents").select("doc_id", "title", "text", "source"), "landing")
    folder = os.path.commonprefix(landed.inputFiles()).rsplit("/", 1)[0]
    root = os.path.join(checkpoint_dir(spark), f"textloom-stream-{uuid.uuid4().hex}")
    P.run_pipeline(spark, folder, landed.schema, [("arrivals", lambda s: P.first_arrivals(s.where("text is not null"), "text").select("doc_hash"))], root, "parquet")
    return spark.read.parquet(f"{root}/arrivals").groupBy("doc_hash").agg(F.count(F.lit(1)).alias("times"))


register("file_stream_dedup", _stream_dedup, """select distinct 'doc-' || md5("text") as doc_hash, cast(1 as bigint) as times from documents where "text" is not null""")


def _syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples over dependency rows of all tagged sentences, heads by place: the first verb is the root, the last noun before it its subject, the first behind its object."""
    t = K.tagged_tokens(load(spark, sf_dir, "tagged_docs"), "tagged_id", "content_morphosyntax")
    w = Window.partitionBy("doc", "sent")
    noun, at = F.coalesce(F.col("pos").isin("NOUN", "PROPN"), F.lit(False)), F.col("pos_no")
    t = t.withColumn("root", F.min(F.when(F.col("pos") == "VERB", at)).over(w))
    t = t.withColumns({"subject": F.max(F.when(noun & (at < F.col("root")), at)).over(w), "object": F.min(F.when(noun & (at > F.col("root")), at)).over(w)})
    link = F.when(at == F.col("root"), "root").when(at == F.col("subject"), "nsubj").when(at == F.col("object"), "obj").otherwise("dep")
    rows = t.where("root is not null").select("doc", "sent", at.alias("id"), F.col("text").alias("form"), "lemma", F.coalesce("pos", F.lit("X")).alias("upos"), F.when(at == F.col("root"), -1).otherwise(F.col("root")).alias("head"), link.alias("deprel"))
    return C.syntax_triples(rows, ["doc", "sent"])


register("syntax_triples", _syntax, f"""with {_TAGGED},
r as (select *, min(case when pos = 'VERB' then pos_no end) over (partition by doc, sent) as root from t),
p as (select doc, sent, any_value(root) as v, max(case when pos in ('NOUN', 'PROPN') and pos_no < root then pos_no end) as a, min(case when pos in ('NOUN', 'PROPN') and pos_no > root then pos_no end) as b from r where root is not null group by doc, sent)
select p.doc, p.sent, s.text as subject, v.lemma as verb, o.text as object from p join t s on s.doc = p.doc and s.pos_no = a join t v on v.doc = p.doc and v.pos_no = p.v join t o on o.doc = p.doc and o.pos_no = b""")
