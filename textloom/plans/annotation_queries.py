"""Queries of rule-based annotation and of clauses over triples, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import annotate as A
from ..operators import knowledge as G
from ..operators import vectors as V
from ..runtime import load
from .registry import register
from .knowledge_queries import _KG, _TAGGED, _matches, _tokens, _triples

_LISTS = " ".join(f"when lower(w) in ({', '.join(repr(x) for x in words)}) then '{pos}'" for pos, words in A.CLOSED.items())


def _rule_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("term"))
    return A.tag_words(words).groupBy("term", "pos").agg(F.count(F.lit(1)).alias("n"))


register("rule_pos", _rule_pos, rf"""with w as (select unnest(regexp_extract_all("text", '[\p{{L}}\p{{N}}]+')) as w from documents)
select w as term, case when regexp_full_match(w, '[0-9]+([.,][0-9]+)*') then 'NUM' {_LISTS} when regexp_matches(w, '^\p{{Lu}}\p{{Ll}}') then 'PROPN' when regexp_matches(lower(w), '(ed|ing|ise|ize|ises|izes|ised|ized)$') then 'VERB' when regexp_matches(lower(w), 'ly$') then 'ADV' when regexp_matches(lower(w), '(ous|ful|able|ible|al|ic|ive|ary|less)$') then 'ADJ' else 'NOUN' end as pos, count(*) as n from w group by all""")
register("pos_patterns", lambda s, d: A.pattern_spans(_tokens(s, d)))
_BODY = "array_to_string(content, chr(10))"
_URL = T.URL.replace(chr(92) + '"', '"')
register(
    "regex_entities", lambda s, d: A.regex_entities(load(s, d, "mail_docs").select("mail_id", F.concat_ws("\n", "content").alias("body")), "mail_id", "body"),
    rf"""select doc, label, text, count(*) as n from (select mail_id as doc, 'url' as label, unnest(regexp_extract_all({_BODY}, '{_URL}')) as text from mail_docs union all select mail_id, 'email', unnest(regexp_extract_all({_BODY}, '{T.EMAIL}')) from mail_docs union all select mail_id, 'cite_person', unnest(regexp_extract_all({_BODY}, '\p{{Lu}}[\p{{L}}''-]+ et al\b')) from mail_docs) group by all""",
)
#: Parts of speech an expression may have, and needs (fixed values).
RULES = {"noun_group": ({"NOUN", "PROPN", "ADJ"}, {"PROPN"}), "quantity": ({"NUM", "NOUN"}, {"NOUN"})}
register("ner_validation", lambda s, d: A.valid_entities(A.pattern_spans(_tokens(s, d), {"noun_group": A.PATTERNS["noun_group"], "quantity": A.PATTERNS["quantity"]}).drop("sent"), _tokens(s, d), RULES))
register("concept_triples", lambda s, d: A.concept_triples(_matches(s, d)).groupBy("s").agg(F.count(F.lit(1)).alias("docs")), r"""
with w as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower("text"), '[\p{L}\p{N}]+'), ' ') || ' ' as t from documents), c as (select subject as s, ' ' || lower(unnest(content)) || ' ' as k from subject_areas)
select s, count(distinct doc_id) as docs from c join w on contains(t, k) group by s""")
register("stop_filter", lambda s, d: A.stop_filter(_tokens(s, d), ("ADP", "DET", "PUNCT", "NOUN", "PROPN", "ADJ"), ("PUNCT",)).groupBy("doc").agg(F.count(F.lit(1)).alias("n")), f"with {_TAGGED}, k as (select *, not coalesce(pos in ('ADP', 'DET', 'PUNCT', 'NOUN', 'PROPN', 'ADJ'), false) as keep from t), a as (select *, max(cast(keep as int)) over (partition by doc) as anyk from k) select doc, count(*) as n from a where keep or (anyk = 0 and not coalesce(pos = 'PUNCT', false)) group by doc")
register("hashed_vectors", lambda s, d: A.hashed_vectors(load(s, d, "eval_queries"), "qid", "description").select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("length")))
register("spo_units", lambda s, d: G.spo_units(_triples(s, d)), f"with {_KG} select s, p, o, count(*) as count, array_to_string(list_sort(list(distinct field_type)), ',') as types from tr group by s, p, o")
register("concept_boosts", lambda s, d: G.concept_boosts(_triples(s, d).groupBy("o").agg(F.count(F.lit(1)).alias("n"))), f"with {_KG}, c as (select o, count(*) as n from tr group by 1) select o, n, round(10.0 * (n - min(n) over () + 0.001) / case when max(n) over () = min(n) over () then 1 else max(n) over () - min(n) over () end, 6) as boost from c")


def _role_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share triples, by text or class, with every 20th document as query; classes are those of first letters."""
    rows = _triples(spark, sf_dir).select("doc", "s", "p", "o", *[(F.ascii(F.lower(x)) % 16).alias(f"c{x}") for x in "spo"])
    query = rows.where("doc % 20 = 0").withColumnRenamed("doc", "qid")
    return G.role_clauses(rows, query).where("doc <> qid")


_MIX = " union all ".join("select doc, '" + g + "' as grouping, " + " || '|' || ".join((f"'#' || (ascii(lower({x})) % 16)" if x in g else f"lower({x})") for x in "spo") + " as key from tr" for g in ("spo", "sp", "so", "po", "s", "p", "o"))
register("kg_role_clauses", _role_clauses, f"with {_KG}, mix as (select distinct doc, grouping, key from ({_MIX})) select q.doc as qid, m.doc as doc, cast(count(*) as double) as score from mix m join mix q using (grouping, key) where q.doc % 20 = 0 and q.doc <> m.doc group by all")
register("entity_questions", lambda s, d: G.entity_questions(G.triples(load(s, d, "mail_docs"), "mail_id")), "with k as (select mail_id as doc, unnest(kg) as t from mail_docs), r as (select doc, array_to_string(t.subject.content, ' ') as s, array_to_string(t.property.content, ' ') as p, array_to_string(t.\"value\".content, ' ') as o from k) select distinct doc, s as entity, case o when 'person' then 'Who is ' || s || '?' when 'date' then 'What happened on ' || s || '?' end as question from r where p = 'rel:instanceof' and o in ('person', 'date')")


def _cluster_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of names by the nearest centroid of their role's model, led to the triples of the documents."""
    rows = V.usable(load(spark, sf_dir, "relation_names"), "embedding")
    classes = V.kmeans_by_role(rows, "relation_id", "triple_type", "embedding", "count", k=8)
    named = classes.join(rows.select(F.col("relation_id").alias("id"), F.trim(F.regexp_replace("sentence", r"#{2,}\s*[A-Za-z]+\s*#{2,}", "")).alias("sentence")), "id")
    table = named.groupBy(F.col("role").alias("triple_type"), "sentence").agg(F.min("class").alias("class"))
    return G.add_classes(_triples(spark, sf_dir), table)


register("cluster_inference", _cluster_inference)
