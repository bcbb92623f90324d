"""Queries of keywords, lexicons and knowledge graphs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import keywords as K
from ..operators import knowledge as G
from ..operators import lexicon as L
from ..runtime import load
from .registry import register

_TAGGED = """
tt as (select tagged_id as doc, i - 1 as pos_no, lower(trim(m[i].lemma)) as lemma, m[i].text as text, m[i].pos as pos, coalesce(m[i].is_oov, false) as is_oov, coalesce(m[i].is_sent_start, false) as st
  from (select tagged_id, content_morphosyntax as m, unnest(range(1, len(content_morphosyntax) + 1)) as i from tagged_docs)),
t as (select *, cast(sum(cast(st as int)) over (partition by doc order by pos_no) as bigint) as sent from tt)
"""
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_PHRASES = f"""{_TAGGED},
s as (select *, coalesce(pos in ({_IN(K.PHRASE_STOPS)}), false) or lemma is null or lemma = '' as stop from t),
isl as (select *, sum(cast(stop as int)) over (partition by doc order by pos_no) as island from s),
runs as (select doc, sent, island, string_agg(lemma, ' ' order by pos_no) as phrase, count(*) as n, min(pos_no) as start, max(pos_no) + 1 as "end",
  bool_and(coalesce(pos, 'X') in ({_IN(K.POSSIBLE)})) and bool_or(coalesce(pos, 'X') in ({_IN(K.AT_LEAST)})) as ok from isl where not stop group by all),
ph as (select doc, phrase, max(n) as n, max(start) as start, arg_max("end", start) as "end" from runs where ok and n <= 10 group by all),
pw as (select doc, phrase, n, start, "end", unnest(string_split(phrase, ' ')) as word from ph),
ws as (select doc, word, count(*) as freq, cast(sum(n) as bigint) as degree from pw group by all)
"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tagged_tokens(load(spark, sf_dir, "tagged_docs"), "tagged_id", "content_morphosyntax")


register("sentence_rebuild", lambda s, d: K.rebuild_sentences(_tokens(s, d)), f"with {_TAGGED} select doc, sent, coalesce(string_agg(text, ' ' order by pos_no), '') as sentence from t group by all")
register("lemma_sentences", lambda s, d: K.rebuild_sentences(_tokens(s, d).where(~F.coalesce(F.col("pos").isin("PUNCT", "DET"), F.lit(False))), "lemma"), f"with {_TAGGED} select doc, sent, coalesce(string_agg(lemma, ' ' order by pos_no), '') as sentence from t where not coalesce(pos in ('PUNCT', 'DET'), false) group by all")
register("keyword_candidates", lambda s, d: K.candidate_phrases(_tokens(s, d)), f'with {_PHRASES} select doc, phrase, n, start, "end" from ph')
register("rake_word_scores", lambda s, d: K.word_scores(K.candidate_phrases(_tokens(s, d))), f"with {_PHRASES} select doc, word, freq, degree from ws")
for _metric, _sql in (("ratio", "degree / freq"), ("degree", "degree"), ("frequency", "freq")):
    register(
        f"rake_keywords_{_metric}", lambda s, d, m=_metric: K.rank(K.candidate_phrases(_tokens(s, d)), m),
        f'with {_PHRASES} select doc, phrase, cast(floor(sum({_sql}) + 1e-9) as int) as score, start, "end" from pw join ws using (doc, word) group by all',
    )
register("keywords_multiword", lambda s, d: K.rank(K.candidate_phrases(_tokens(s, d))).where(F.size(F.split("phrase", r"\s+")) > 1), f'with {_PHRASES} select doc, phrase, cast(floor(sum(degree / freq) + 1e-9) as int) as score, start, "end" from pw join ws using (doc, word) where n > 1 group by all')
register("oov_counts", lambda s, d: _tokens(s, d).where("is_oov and lemma <> ''").groupBy("lemma").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("docs")), f"with {_TAGGED} select lemma, count(*) as n, count(distinct doc) as docs from t where is_oov and lemma <> '' group by 1")
register("pos_profile", lambda s, d: _tokens(s, d).groupBy(F.coalesce("pos", F.lit("none")).alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lemma").alias("lemmas")), f"with {_TAGGED} select coalesce(pos, 'none') as pos, count(*) as n, count(distinct lemma) as lemmas from t group by 1")

_KG = """
k as (select record_id as doc, i - 1 as no, kg[i] as t from (select record_id, kg, unnest(range(1, len(kg) + 1)) as i from converted_docs)),
tr as (select doc, no, coalesce(array_to_string(t.subject.content, ' '), '') as s, coalesce(array_to_string(t.property.content, ' '), '') as p, coalesce(array_to_string(t."value".content, ' '), '') as o,
  cast(coalesce(t.subject."class", -1) as bigint) as cs, cast(coalesce(t.property."class", -1) as bigint) as cp, cast(coalesce(t."value"."class", -1) as bigint) as co, coalesce(t.field_type, '') as field_type from k)
"""


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.triples(load(spark, sf_dir, "converted_docs"), "record_id")


register("kg_triples", lambda s, d: _triples(s, d).drop("confidence"), f"with {_KG} select * from tr")
register("kg_dedup", lambda s, d: G.distinct_triples(_triples(s, d)), f"with {_KG} select distinct doc, s, p, o from tr")
register("kg_by_field", lambda s, d: _triples(s, d).groupBy("field_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("docs")), f"with {_KG} select field_type, count(*) as n, count(distinct doc) as docs from tr group by 1")
register("kg_nested_match", lambda s, d: G.match(load(s, d, "converted_docs"), "record_id", value="contact"), f"with {_KG} select distinct doc from tr where lower(o) = 'contact'")


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of queries of all searches, ids divisible by 20, against all documents."""
    rows = _triples(spark, sf_dir)
    return G.graph_overlap(rows, rows.where(F.col("doc") % 20 == 0))


register("kg_overlap", _overlap, f"with {_KG}, u as (select distinct doc, s, p, o from tr) select a.doc as query, b.doc, count(*) as shared from u a join u b using (s, p, o) where a.doc % 20 = 0 and a.doc <> b.doc group by all")


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that the documents of both sources hold."""
    docs = load(spark, sf_dir, "converted_docs")
    return G.shared_triples(*(G.triples(docs.where(F.col("data_source") == x), "record_id") for x in ("converter-service", "batch")))


_MK = _KG.replace("k as (", "k2 as (").replace("record_id", "mail_id").replace("converted_docs", "mail_docs").replace("tr as (", "tr2 as (").replace("from k)", "from k2)")
_OF_SOURCE = "select s, p, o from tr join converted_docs on record_id = doc where data_source = '{0}'"
register("kg_intersect", _shared, f"with {_KG} {_OF_SOURCE.format('converter-service')} intersect {_OF_SOURCE.format('batch')}")
register("kg_union", lambda s, d: G.joined_triples([G.triples(load(s, d, "converted_docs"), "record_id"), G.triples(load(s, d, "mail_docs"), "mail_id")]), f"with {_KG}, {_MK} select distinct s, p, o from tr union select s, p, o from tr2")
_SETS = ["spo", "sp", "so", "po", "s", "p", "o"]
_GROUPED = " union all ".join("select '" + g + "' as grouping, " + " || '|' || ".join((f"'#' || c{x}" if x in g else x) for x in "spo") + " as key from tr" for g in _SETS)
register("semantic_role_groupings", lambda s, d: G.role_groupings(_triples(s, d)), f"with {_KG} select grouping, key, count(*) as n from ({_GROUPED}) group by all")
register(
    "semantic_boosts", lambda s, d: G.scaled_boosts(G.role_groupings(_triples(s, d)), "grouping", skip=3),
    f"with {_KG}, g as (select grouping, key, count(*) as n from ({_GROUPED}) group by all), q as (select *, row_number() over (partition by grouping order by n desc, key) as r from g qualify r > 3) select grouping, key, n, cast(case when max(n) over w = min(n) over w then 1 else floor(1 + (n - min(n) over w) * 9 / (max(n) over w - min(n) over w) + 1e-9) end as int) as boost from q window w as (partition by grouping)",
)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the triples that have a place, and of keywords."""
    rows = G.triples(load(spark, sf_dir, "converted_docs"), "record_id", placed=True)
    return G.relation_units(rows).unionByName(G.keyword_units(K.candidate_phrases(_tokens(spark, sf_dir))))


_NO_PLACE = " and ".join(f"coalesce(t.{r}.positions <> [-1], true)" for r in ("subject", "property", '"value"'))
register("relation_units", _units, f"""with {_PHRASES}, {_KG.replace("from k)", f"from k where {_NO_PLACE})")},
u as (select 'subject' as triple_type, s as sentence, p || '#' || o as c from tr union all select 'relation', p, s || '#' || o from tr union all select 'object', o, s || '#' || p from tr)
select triple_type, sentence, count(*) as count, count(distinct c) as n_contexts from u where sentence <> '' group by all
union all select 'keyword', phrase, count(*), 1 from ph where phrase <> '' group by phrase""")
register(
    "class_stats_top10", lambda s, d: G.class_statistics(_triples(s, d)),
    f"with {_KG}, u as (select 'subject' as role, cs as class, s as text from tr union all select 'property', cp, p from tr union all select 'value', co, o from tr), c as (select role, class, text, count(*) as c from u group by all), r as (select *, row_number() over (partition by role, class order by c desc, text) as r from c) select role, class, cast(sum(c) as bigint) as n, string_agg(text, ' ## ' order by r) filter (where r <= 10) as top from r group by role, class",
)


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of repeated role texts, here by their first letter, led back to the triples."""
    rows = _triples(spark, sf_dir)
    units = G.relation_units(rows).where(F.col("count") > 1).select("triple_type", "sentence", (F.ascii(F.lower("sentence")) % 16).alias("class"))
    return G.add_classes(rows, units)


register(
    "kg_add_class", _classes,
    f"with {_KG}, u as (select 'subject' as triple_type, s as sentence from tr union all select 'relation', p from tr union all select 'object', o from tr), c as (select triple_type, sentence, cast(ascii(lower(sentence)) % 16 as bigint) as class from u where sentence <> '' group by all having count(*) > 1) select doc, no, coalesce(a.class, -1) as cs, coalesce(b.class, -1) as cp, coalesce(e.class, -1) as co from tr left join c a on a.triple_type = 'subject' and a.sentence = s left join c b on b.triple_type = 'relation' and b.sentence = p left join c e on e.triple_type = 'object' and e.sentence = o",
)
register("svo_trim_bounds", lambda s, d: G.trimmed_bounds(load(s, d, "converted_docs"), "record_id", "kg", ("ADP", "DET", "PRON", "PUNCT")), f"""with {_KG},
z as (select doc, no, t.subject.content as a, t.subject.pos as ap, t."value".content as b, t."value".pos as bp from k),
f as (select *, [i for i in range(1, len(ap) + 1) if not coalesce(ap[i] in ('ADP', 'DET', 'PRON', 'PUNCT'), false)] as ak, [i for i in range(1, len(bp) + 1) if not coalesce(bp[i] in ('ADP', 'DET', 'PRON', 'PUNCT'), false)] as bk from z)
select doc, no, coalesce(array_to_string(case when len(ak) > 0 then a[ak[1]:ak[-1]] when len(ap) > 0 then [] else a end, ' '), '') as subject, coalesce(array_to_string(case when len(bk) > 0 then b[bk[1]:bk[-1]] when len(bp) > 0 then [] else b end, ' '), '') as "value" from f""")
register("kg_pivot", lambda s, d: G.pivot_values(G.triples(load(s, d, "mail_docs"), "mail_id"), ["person", "email", "date"]), f"with {_MK} select doc, coalesce(string_agg(distinct case when o = 'person' then s end, '|' order by case when o = 'person' then s end), '') as person, coalesce(string_agg(distinct case when o = 'email' then s end, '|' order by case when o = 'email' then s end), '') as email, coalesce(string_agg(distinct case when o = 'date' then s end, '|' order by case when o = 'date' then s end), '') as date from tr2 where o in ('person', 'email', 'date') group by doc")
register("index_documents", lambda s, d: I.index_documents(load(s, d, "converted_docs")).select("index_id", "source_doc_id", F.size("triples").alias("n_triples"), F.size("suggestions").alias("n_suggestions"), "suggestion_weight"), """
with k as (select record_id, source_doc_id, title, coalesce(array_to_string(content, ' '), '') as content, unnest(case when len(kg) > 0 then kg else [null] end) as t from converted_docs),
e as (select record_id, source_doc_id, title, content, t is not null as has, coalesce(array_to_string(t.subject.content, ' '), '') as s, coalesce(array_to_string(t.property.content, ' '), '') as p, coalesce(array_to_string(t."value".content, ' '), '') as o from k),
g as (select record_id, source_doc_id, title, content, count(distinct (s, p, o)) filter (where has) as n, count(distinct s) filter (where has) as ns from e group by all)
select 'doc-' || md5(coalesce(title, '') || chr(1) || content || chr(1) || coalesce(source_doc_id, '')) as index_id, source_doc_id, n as n_triples, ns as n_suggestions, cast(floor(100 / greatest(n, 1)) as int) as suggestion_weight from g""")

_WORDS = r"""
words as (select doc_id, regexp_extract_all(lower("text"), '[\p{L}\p{N}]+') as w from documents),
tok as (select doc_id, i - 1 as pos, w[i] as term from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words)),
lex as (select list_aggregate(p, 'string_agg', ' ') as key, len(p) as n, subject as label, max(1.0) as weight from (select regexp_extract_all(lower(trim(c)), '[\p{L}\p{N}]+|[-&]') as p, subject from (select unnest(content) as c, subject from subject_areas)) group by all),
grams as (select doc_id, i - 1 as start, cast(k as bigint) as n, array_to_string(w[i:i + k - 1], ' ') as key from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words), (select unnest([1, 2, 3, 4, 5, 6, 7]) as k) where i + k - 1 <= len(w)),
m as (select doc_id, start, n, label, weight from grams join lex using (key, n))
"""


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.build(load(spark, sf_dir, "subject_areas").select("subject", F.explode("content").alias("word")), "word", "subject")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.candidate_matches(I.tokens(load(spark, sf_dir, "documents"), "doc_id", "text"), _lexicon(spark, sf_dir))


_LONGEST = "long as (select *, row_number() over (partition by doc_id, start order by n desc, weight desc, label) as r from m qualify r = 1)"
register("lexicon_build", lambda s, d: _lexicon(s, d).select("key", "n", "label", "weight"), f"with {_WORDS} select key, n, label, weight from lex")
register("mwe_longest_match", lambda s, d: L.longest_at_start(_matches(s, d)).select("doc_id", "start", "n", "label"), f"with {_WORDS}, {_LONGEST} select doc_id, start, n, label from long")
register("mwe_non_overlapping", lambda s, d: L.without_overlap(_matches(s, d)))
register("dict_ner_argmax", lambda s, d: L.best_label(_matches(s, d)).select("doc_id", "start", "n", "label"), f"with {_WORDS}, b as (select *, row_number() over (partition by doc_id, start, n order by weight desc, label) as r from m qualify r = 1) select doc_id, start, n, label from b")


def _ner_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entities that overlap no longer expression."""
    m = _matches(spark, sf_dir)
    return L.drop_overlapping(m.where("n = 1"), m.where("n > 1")).select("doc_id", "start", "label")


register("ner_overlap_antijoin", _ner_overlap, f"with {_WORDS} select doc_id, start, label from m a where n = 1 and not exists (select 1 from m b where b.doc_id = a.doc_id and b.n > 1 and a.start < b.start + b.n and b.start < a.start + a.n)")
#: A small list of typing errors and spelling variants (fixed values).
TYPOS = [("recieved", "received"), ("goverment", "government"), ("knowlege", "knowledge"), ("adress", "address")]
VARIANTS = [("fibres", "fibers"), ("calibrated", "adjusted"), ("whilst", "while"), ("catalyst", "accelerator")]


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("pos", "token"))
    table = lambda rows: spark.createDataFrame(rows, "form string, by string")
    return L.normalize_words(words, table(TYPOS), table(VARIANTS)).where("normalized <> token").groupBy("token", "normalized").agg(F.count(F.lit(1)).alias("n"))


_VALUES = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
register("typo_normalize", _normalized, rf"""with ty(form, fix) as (values {_VALUES(TYPOS)}), va(form, fix) as (values {_VALUES(VARIANTS)}),
w as (select unnest(regexp_extract_all("text", '[\p{{L}}\p{{N}}]+')) as token from documents),
j as (select token, coalesce(va.fix, ty.fix) as fix from w left join ty on lower(token) = ty.form left join va on coalesce(ty.fix, lower(token)) = va.form)
select token, normalized, count(*) as n from (select token, case when fix is null then token when token = upper(token) and length(token) > 1 then upper(fix) when token[1] = upper(token[1]) then upper(fix[1]) || fix[2:] else fix end as normalized from j) where normalized <> token group by all""")
