"""Queries of scoring frames, vectors, evaluation and text functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import index as I
from ..operators import ranking as K
from ..operators import retrieval as R
from ..operators import scoring as S
from ..operators import vectors as V
from ..runtime import discard, load, materialize
from .registry import register
from .retrieval_queries import _BM25, _STOP, _TOP, _Index

_SENTS = r"""
c as (select doc_id as doc, trim(regexp_replace("text", '\s+', ' ', 'g')) as t from documents),
s0 as (select doc, string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) as a from c),
s1 as (select doc, [x for x in a if x <> ''] as a from s0),
s as (select doc, i - 1 as sent, a[i] as sentence, len(regexp_extract_all(lower(a[i]), '[\p{L}\p{N}]+')) as n_words from (select doc, a, unnest(range(1, len(a) + 1)) as i from s1))
"""
_SCORES = rf"""{_SENTS},
cl as (select distinct subject as label, unnest(regexp_extract_all(lower(array_to_string(content, ' ')), '[\p{{L}}\p{{N}}]+')) as word from subject_areas),
w as (select doc, sent, n_words, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+')) as word from s where n_words > 0),
sc as (select doc, sent, n_words, label, count(*) / n_words as score from w join cl using (word) group by doc, sent, n_words, label),
tot as (select doc, count(*) as n, sum(n_words) as w from s where n_words > 0 group by 1),
ds as (select doc, label, round(sum(score) / any_value(n), 6) as score, round(sum(score * n_words) / any_value(tot.w), 6) as weighted from sc join tot using (doc) group by doc, label)
"""


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentence_rows(load(spark, sf_dir, "documents"), "doc_id", "text")


def _doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = load(spark, sf_dir, "subject_areas").select(F.col("subject").alias("label"), F.explode(T.words(F.concat_ws(" ", "content"))).alias("word")).distinct()
    sents = _sents(spark, sf_dir)
    return S.document_scores(sents, S.overlap_scores(sents, classes))


#: Areas brought together to three (fixed values).
MASTER = [("agriculture", "nature"), ("chemistry", "nature"), ("medicine", "nature"), ("energy", "industry"), ("robotics", "industry"), ("machine_learning", "industry"), ("software", "industry"), ("finance", "society"), ("law", "society"), ("sport", "society")]
_MASTER = ", ".join(f"('{a}', '{b}')" for a, b in MASTER)
register("sentences_split", lambda s, d: _sents(s, d).select("doc", "sent", "sentence"), f"with {_SENTS} select doc, sent, sentence from s")
register("document_classes", _doc_scores, f"with {_SCORES} select doc, label, score, weighted from ds")
for _how, _sql in (("max", "max"), ("mean", "avg"), ("sum", "sum")):
    register(
        f"class_relabel_{_how}", lambda s, d, h=_how: S.relabel(_doc_scores(s, d), s.createDataFrame(MASTER, "label string, master string"), h),
        f"with {_SCORES}, ma(label, master) as (values {_MASTER}), g as (select doc, master as label, {_sql}(score) as s from ds join ma using (label) group by all) select doc, label, round(coalesce(s / nullif(sum(s) over (partition by doc), 0), s), 6) as score from g",
    )
#: Words of praise and blame (fixed values).
POSITIVE = ("pleased", "right", "works", "fine", "thank", "best", "new")
NEGATIVE = ("failed", "mistake", "protest", "problem", "sorry", "lost", "costs", "without")
_LEX = ", ".join([f"('{w}', 1)" for w in POSITIVE] + [f"('{w}', -1)" for w in NEGATIVE])
register(
    "sentiment_lexicon", lambda s, d: S.sentiment(_sents(s, d), s.createDataFrame([(w, 1) for w in POSITIVE] + [(w, -1) for w in NEGATIVE], "word string, sign int")),
    rf"with {_SENTS}, lx(word, sign) as (values {_LEX}), w as (select doc, sent, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+')) as word from s where n_words > 0), p as (select doc, sent, count(*) filter (where sign > 0) as p, count(*) filter (where sign < 0) as n from w left join lx using (word) group by all), q as (select doc, case when p >= n then (greatest(p, n) + 1) / (p + n + 2) else 1 - (greatest(p, n) + 1) / (p + n + 2) end as pos from p) select doc, round(sum(pos) / count(*), 6) as positive, round(sum(1 - pos) / count(*), 6) as negative from q group by doc",
)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each question in the best documents found for it."""
    x = _Index(spark, sf_dir).stored()
    top = R.page(x.found(), size=3).join(x.queries.select("qid", "query"), "qid").join(x.docs.select("doc_id", "text"), "doc_id")
    return top.select("qid", "doc_id", F.round(S.coverage(F.col("query"), F.col("text"), T.STOP_WORDS), 6).alias("coverage"))


_COVER = rf"""with {_BM25}, top as (select *, {_TOP} as r from scored qualify r <= 3), q as (select qid, doc_id, list_distinct([x for x in regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+') if x not in ({_STOP})]) as w, lower("text") as t from top join eval_queries using (qid) join documents using (doc_id))
select qid, doc_id, round(coalesce(len([x for x in w if contains(t, x)]) / nullif(len(w), 0), 0), 6) as coverage from q"""
register("qa_coverage", _coverage, _COVER)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences of the best documents as answers, equal ones brought together."""
    x = _Index(spark, sf_dir).stored()
    first = F.get(T.sentences(F.col("text")), F.lit(0))
    rows = R.page(x.found(), size=10).join(x.docs.select("doc_id", first.alias("answer")), "doc_id").select("qid", "answer", "score", F.col("rank").alias("place"))
    return S.best_answers(S.group_answers(rows.where("answer is not null")))


register(
    "answer_group", _answers,
    rf"""with {_BM25}, {_SENTS}, top as (select *, {_TOP} as place from scored qualify place <= 10), a as (select qid, sentence as answer, score, place from top join s on s.doc = top.doc_id and sent = 0),
g as (select qid, answer, round(avg(score), 6) as score, count(*) as count, string_agg(distinct cast(place as varchar), ',' order by cast(place as varchar)) as places from a group by all)
select *, row_number() over (partition by qid order by score desc, count desc, answer) as rank from g qualify rank <= 3""".replace("string_agg(distinct cast(place as varchar), ',' order by cast(place as varchar))", "array_to_string([cast(x as varchar) for x in list_sort(list(distinct place))], ',')"),
)


def _summary_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.size(T.words(F.col("text"))), F.lit(0))
    low, high = S.summary_lengths(n, least_percent=10, most_percent=30)
    return load(spark, sf_dir, "documents").select("doc_id", low.alias("least"), high.alias("most"))


register("summary_len_rule", _summary_rule, r"""with n as (select doc_id, coalesce(len(regexp_extract_all(lower("text"), '[\p{L}\p{N}]+')), 0) as n from documents) select doc_id, cast(floor(n * 10 / 100) as int) as least, cast(case when floor(n * 30 / 100) <= floor(n * 10 / 100) then floor(n * 30 / 100) + 10 else floor(n * 30 / 100) end as int) as most from n""")
register(
    "summary_extract", lambda s, d: S.extractive_summary(_sents(s, d)),
    rf"with {_SENTS}, w as (select doc, sent, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+')) as word from s where n_words > 0), df as (select word, count(distinct doc) as df from w group by 1), n as (select count(distinct doc) as n from s), sc as (select doc, sent, round(avg(ln(n / df)), 6) as v from w join df using (word), n group by all), top as (select *, row_number() over (partition by doc order by v desc, sent) as r from sc qualify r <= 2) select doc, string_agg(sentence, ' ' order by sent) as summary from top join s using (doc, sent) group by doc",
)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed into blocks of 60 words."""
    sent = T.sentences(F.col("text"))
    packed = S.pack_blocks(sent, F.transform(sent, lambda x: F.size(T.words(x))), 60)
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(packed).alias("block", "items")).select("doc_id", "block", F.size("items").alias("sentences"))


register("block_pack", _blocks)


def _token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(S.split_tokens(tokens)).alias("block", "items")).select("doc_id", "block", F.size("items").alias("tokens"))


register("token_blocks", _token_blocks)


def _phrase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of tagged documents cut into phrases at marks."""
    t = load(spark, sf_dir, "tagged_docs").where(F.size("content_morphosyntax") > 0)
    words, marks = F.transform("content_morphosyntax", lambda x: F.coalesce(x["text"], F.lit(""))), F.transform("content_morphosyntax", lambda x: F.coalesce(x["pos"].isin("PUNCT", "CCONJ"), F.lit(False)))
    return t.select("tagged_id", F.posexplode(S.split_phrases(words, marks)).alias("no", "phrase"))


register("phrase_split", _phrase_split)

# vectors
_USABLE = "select emb_id, embedding as v from doc_embeddings where len(embedding) = 64 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0"


def _cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query set: rows whose identifier is divisible by 20, against all rows."""
    rows = V.usable(load(spark, sf_dir, "doc_embeddings"), "embedding")
    queries = rows.where("emb_id % 20 = 0").select(F.col("emb_id").alias("qid"), F.col("embedding").alias("vec"))
    return V.cosine_top(queries, rows, "emb_id", "embedding")


register(
    "cosine_topk", _cosine_top,
    f"with u as ({_USABLE}), p as (select a.emb_id as qid, b.emb_id as id, round(list_dot_product(a.v::double[], b.v::double[]) / (sqrt(list_dot_product(a.v::double[], a.v::double[])) * sqrt(list_dot_product(b.v::double[], b.v::double[]))), 6) as cos from u a, u b where a.emb_id % 20 = 0) select qid, id, cos, row_number() over (partition by qid order by cos desc, id) as rank from p qualify rank <= 10",
)
register(
    "mean_pooling", lambda s, d: V.mean_vectors(V.usable(load(s, d, "doc_embeddings"), "embedding").where("source_doc_id is not null"), "source_doc_id", "embedding"),
    f"with u as ({_USABLE}), e as (select source_doc_id, unnest(v) as x, unnest(range(0, 64)) as dim from u join doc_embeddings using (emb_id) where source_doc_id is not null) select source_doc_id, cast(dim as int) as dim, count(*) as n, round(avg(x::double), 6) as mean from e group by source_doc_id, dim",
)
register(
    "masked_pooling", lambda s, d: V.usable(load(s, d, "doc_embeddings"), "embedding").select("emb_id", F.array_join(F.transform(T.mean_pool(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8)), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.get("embedding", k * 8) > 0).cast("int"))), lambda x: F.format_number(x + F.lit(1e-9), 5)), " ").alias("pooled")),
    f"with u as ({_USABLE}), k as (select emb_id, v, [i for i in range(0, 8) if v[i * 8 + 1] > 0] as kept from u) select emb_id, case when len(kept) = 0 then null else array_to_string([format('{{:,.5f}}', list_sum([v[i * 8 + j]::double for i in kept]) / len(kept) + 1e-9) for j in range(1, 9)], ' ') end as pooled from k",
)


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return V.nearest_centroid(rows, "vec_id", "embedding", V.centroids(rows, "label", "embedding"))


register(
    "nearest_centroid", _centroids,
    "with e as (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings), c0 as (select label, i, avg(embedding[i]::double) as x from e group by all), c as (select label, list(x order by i) as c from c0 group by 1), d as (select vec_id as id, c.label, round(list_distance(embedding::double[], c), 6) as distance from embeddings, c) select id, cast(label as bigint) as label, distance from d qualify row_number() over (partition by id order by distance, label) = 1",
)
register("kmeans_roles", lambda s, d: V.kmeans_by_role(load(s, d, "relation_names"), "relation_id", "triple_type", "embedding", "count"))


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "doc_embeddings").where("source_doc_id is not null").select("emb_id", "source_doc_id", F.coalesce("position.length", F.lit(0)).cast("bigint").alias("length"))
    return S.running_offsets(rows, "source_doc_id", "emb_id", "length").select("emb_id", "start")


register("embedding_offsets", _offsets, 'select emb_id, cast(coalesce(sum(coalesce(position."length", 0)) over (partition by source_doc_id order by emb_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start from doc_embeddings where source_doc_id is not null')


# evaluation: documents of the passages' words as judgements of the questions' run
def _metrics(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(qid, k, *names).  Queries of the same words, passage's words and relevance have the same metrics and are scored once."""
    x = _Index(spark, sf_dir)
    terms, described = x.terms, R.query_terms(x.queries, text="description")
    rel = materialize(x.queries.groupBy("qid").agg(F.max(F.coalesce("relevance", F.lit(1))).alias("rel")), "relevance")
    same = K.asked_once(rel, terms, described)
    asked = same.select(F.col("asked").alias("once")).distinct()
    once = lambda t: t.join(asked, F.col("qid") == F.col("once"), "left_semi").unionByName(t.where("qid is null"))
    out = None
    for found in K.passes(x.docs, "doc_id", "text", [(once(terms), 500), (once(described), 20)]):
        run, judged = K.lists(found, 2)
        part = materialize(E.metrics(run, judged.join(rel, "qid").select("qid", "doc_id", "rel")).select("qid", "k", *names), "metrics")
        discard(found)
        out = part if out is None else out.unionByName(part)
    return same.join(out.withColumnRenamed("qid", "asked"), "asked").select("qid", "k", *names).unionByName(out.where("qid is null"))


_BM25_Q = _BM25
_DESC = _BM25.replace("lower(query)", "lower(description)")
_EVAL = f"""
with run as (select * from (with {_BM25_Q} select qid, {_TOP} as rank, doc_id, score from scored qualify rank <= 500)),
qr as (select qid, doc_id, coalesce(relevance, 1) as rel from (with {_DESC} select qid, {_TOP} as r, doc_id from scored qualify r <= 20) join eval_queries using (qid)),
ks as (select cast(unnest([10, 50, 100, 500]) as bigint) as k),
j as (select run.*, coalesce(rel, 0) as rel, cast(coalesce(rel, 0) > 0 as int) as hit from run left join qr using (qid, doc_id)),
h as (select *, sum(hit) over (partition by qid order by rank) as hits from j),
cut as (select *, row_number() over (partition by qid, k order by score, rank) as i, count(*) over (partition by qid, k) as n from h, ks where rank <= k),
got as (select qid, k, sum(hit) as found, sum(rel / log2(rank + 1)) as dcg, sum(hit * hits / rank) as ap, max(case when hit = 1 then 1 / rank else 0 end) as mrr, avg(score) as mean_score, 2 * sum((2 * i - n - 1) * score) as spread from cut group by all),
ideal as (select *, row_number() over (partition by qid order by rel desc) as r from qr where rel > 0),
best as (select qid, k, count(*) as relevant, sum(case when r <= k then rel / log2(r + 1) end) as idcg from ideal, ks group by all),
qs as (select qid, k from (select qid from run union select qid from qr), ks),
pr as (select qid, k, coalesce(found / k, 0) as p, coalesce(found / relevant, 0) as r, coalesce(dcg / idcg, 0) as ndcg, coalesce(ap / relevant, 0) as map, coalesce(mrr, 0) as mrr, coalesce(mean_score, -1) as mean_score, coalesce(spread / (2 * nullif(mean_score, 0)), -1) as gini from qs left join got using (qid, k) left join best using (qid, k)),
m as (select qid, k, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1, round(ndcg, 6) as ndcg, round(map, 6) as map, round(mrr, 6) as mrr, round(mean_score, 6) as mean_score, round(gini, 6) as gini from pr)
"""
_METRICS = ("precision", "recall", "f1", "ndcg", "map", "mrr", "mean_score", "gini")
for _m in _METRICS[:-1]:
    register(f"ir_{_m}", lambda s, d, m=_m: _metrics(s, d, m), f"{_EVAL} select qid, k, {_m} from m")
register("ir_gini", lambda s, d: _metrics(s, d, "gini"), f"{_EVAL} select qid, k, gini from m")
register("ir_overall", lambda s, d: E.overall(_metrics(s, d, *_METRICS)), f"{_EVAL} select k, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1, round(avg(ndcg), 6) as ndcg, round(avg(map), 6) as map, round(avg(mrr), 6) as mrr, round(avg(mean_score), 6) as mean_score, round(avg(gini), 6) as gini from m group by k")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "converted_docs").where("source_doc_id is not null").groupBy(F.col("source_doc_id").alias("name")).agg(F.min("record_id").alias("number"))
    targets = load(spark, sf_dir, "eval_queries").where("target_document is not null").select(F.col("target_document").alias("name"))
    return E.document_numbers(targets.union(docs.select("name")), docs)


register("document_numbers", _numbers, "with known as (select source_doc_id as name, min(record_id) as number from converted_docs where source_doc_id is not null group by 1), n as (select distinct name from (select target_document as name from eval_queries where target_document is not null union all select name from known)), j as (select name, number from n left join known using (name)) select name, coalesce(number, 10000000 - 1 + row_number() over (partition by number is null order by md5(name)[1:2], name)) as number from j")

# text functions over whole tables
register("email_entities", lambda s, d: load(s, d, "mail_docs").select("mail_id", F.explode(F.regexp_extract_all(F.concat_ws("\n", "content"), F.lit(T.EMAIL), F.lit(0))).alias("email")).groupBy("mail_id", "email").agg(F.count(F.lit(1)).alias("n")), f"select mail_id, email, count(*) as n from (select mail_id, unnest(regexp_extract_all(array_to_string(content, chr(10)), '{T.EMAIL}')) as email from mail_docs) group by all")
register("ascii_fold", lambda s, d: load(s, d, "documents").select("doc_id", F.md5(T.ascii_fold(F.coalesce("text", F.lit("")))).alias("folded")), """select doc_id, md5(translate(coalesce("text", ''), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')) as folded from documents""")
register("content_ids", lambda s, d: load(s, d, "documents").select("doc_id", T.content_id(F.col("title"), F.col("text"), F.col("source")).alias("id")), """select doc_id, 'doc-' || md5(coalesce(title, '') || chr(1) || coalesce("text", '') || chr(1) || coalesce(source, '')) as id from documents""")
register("token_classes", lambda s, d: load(s, d, "documents").select(F.explode(F.split(T.collapse(F.col("text")), " ")).alias("t")).select(F.coalesce(T.token_class(F.col("t")), F.lit("other")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), rf"""select case when regexp_full_match(t, '[^\p{{L}}\p{{N}}\s]+') then 'PUNCT' when regexp_full_match(t, '(https?://[^\s<>"]+|www\.[a-zA-Z0-9.-]+)') then 'NOUN' when regexp_full_match(t, '({T.EMAIL})') then 'ADJ' when regexp_full_match(t, '[0-9]+([.,][0-9]+)*') then 'NUM' else 'other' end as kind, count(*) as n from (select unnest(string_split(trim(regexp_replace("text", '\s+', ' ', 'g')), ' ')) as t from documents) group by 1""")
register("question_tokens", lambda s, d: load(s, d, "eval_queries").select("qid", T.space_punctuation(F.col("query")).alias("tokens")), r"select qid, trim(regexp_replace(regexp_replace(query, '([.;,!?()])', ' \1 ', 'g'), '\s+', ' ', 'g')) as tokens from eval_queries")
register("base64_roundtrip", lambda s, d: load(s, d, "documents").select("doc_id", F.md5(F.unbase64(F.base64(F.encode("text", "UTF-8"))).cast("string")).alias("digest")), 'select doc_id, md5("text") as digest from documents')
register("json_values", lambda s, d: load(s, d, "kg_lines").select("kg_id", F.get_json_object("kg", "$.field_type").alias("field_type"), F.get_json_object("kg", "$.confidence").cast("double").alias("confidence")), "select kg_id, json_extract_string(kg, '$.field_type') as field_type, cast(json_extract_string(kg, '$.confidence') as double) as confidence from kg_lines")
register("analyzer_stop", lambda s, d: I.postings(I.tokens(load(s, d, "documents"), "doc_id", "text", T.analyze(F.col("text"), T.STOP_WORDS))).groupBy("term").agg(F.sum("tf").alias("ttf")), rf"""select term, count(*) as ttf from (select unnest([x for x in regexp_extract_all(lower("text"), '[\p{{L}}\p{{N}}]+') if x not in ({_STOP})]) as term from documents) group by 1""")
register("analyzer_stem", lambda s, d: load(s, d, "eval_queries").select("qid", F.array_join(T.stemmer()(T.analyze(F.col("query"), T.STOP_WORDS)), " ").alias("stems")))
