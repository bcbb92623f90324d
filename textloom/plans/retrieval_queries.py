"""Queries of index and retrieval, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import retrieval as R
from ..runtime import load, materialize
from .registry import register

_TOKENS = r"""
words as (select doc_id, regexp_extract_all(lower("text"), '[\p{L}\p{N}]+') as w from documents),
tok as (select doc_id, i - 1 as pos, w[i] as term from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words)),
post as (select doc_id, term, count(*) as tf from tok group by all),
dl as (select doc_id, coalesce(len(w), 0) as dl from words)
"""
_QUERY = r"""
qt as (select qid, term, cast(count(*) as double) as boost from (select qid, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) as term from eval_queries) group by all)
"""
_BM25 = f"""{_TOKENS}, {_QUERY},
st as (select count(*) as n, avg(cast(dl as double)) as avgdl from dl),
df as (select term, count(*) as df from post group by term),
scored as (
  select qid, doc_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score, count(*) as matched
  from qt join post using (term) join df using (term) join dl using (doc_id), st group by all)
"""
_TOP = "row_number() over (partition by qid order by score desc, doc_id)"


#: Index tables by session and state of the documents: what a search service keeps between queries.
_STORED: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _state(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, length and time of change of the files a table is read from."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    out = []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((f, status.getLen(), status.getModificationTime()))
    return out


class _Index:
    """The index tables of one folder; postings that are read more than once are written before."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.docs = load(spark, sf_dir, "documents")
        self.tokens = I.tokens(self.docs, "doc_id", "text")
        self.posts = I.postings(self.tokens)
        self.dl = I.lengths(self.docs, "doc_id", "text")
        self.queries = load(spark, sf_dir, "eval_queries")
        self.terms = R.query_terms(self.queries)

    def stored(self) -> _Index:
        """Postings and lengths as tables, written once for a session and state of the documents' files."""
        spark = self.docs.sparkSession
        key = (spark.sparkContext.applicationId, *_state(self.docs))
        if key not in _STORED:
            posts = materialize(I.stored_postings(self.docs, "doc_id", "text"), "postings")
            _STORED[key] = posts, materialize(self.dl, "lengths")
        self.posts, self.dl = _STORED[key]
        return self

    def found(self) -> DataFrame:
        return R.match_or(self.posts, self.dl, self.terms)


register("tokens_per_doc", lambda s, d: _Index(s, d).dl, f"with {_TOKENS} select doc_id, cast(dl as bigint) as dl from dl")
register("postings", lambda s, d: _Index(s, d).posts, f"with {_TOKENS} select doc_id, term, tf from post")
register(
    "postings_positions",
    lambda s, d: I.postings(_Index(s, d).tokens, positions=True).select("doc_id", "term", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("places")),
    f"with {_TOKENS} select doc_id, term, count(*) as tf, string_agg(cast(pos as varchar), ',' order by pos) as places from tok group by all",
)
register("term_stats", lambda s, d: I.term_stats(_Index(s, d).posts), f"with {_TOKENS} select term, count(*) as df, cast(sum(tf) as bigint) as ttf from post group by term")
register("field_stats", lambda s, d: I.field_stats(_Index(s, d).posts), f"with {_TOKENS} select count(distinct doc_id) as doc_count, count(*) as sum_df, cast(sum(tf) as bigint) as sum_ttf from post")
register("bm25_topk", lambda s, d: R.page(_Index(s, d).stored().found()).select("qid", "rank", "doc_id", "score"), f"with {_BM25} select qid, {_TOP} as rank, doc_id, score from scored qualify rank <= 10")
register("match_or", lambda s, d: _Index(s, d).stored().found().groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best")), f"with {_BM25} select qid, count(*) as hits, max(score) as best from scored group by qid")


def _match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all of a query's words but stop words."""
    x = _Index(spark, sf_dir).stored()
    terms = R.query_terms(x.queries, terms=T.analyze(F.col("query"), T.STOP_WORDS))
    return R.match_and(R.match_or(x.posts, x.dl, terms), terms).select("qid", "doc_id", "score")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_AND = _BM25.replace(_QUERY, rf"""
qt as (select qid, term, cast(count(*) as double) as boost from (select qid, unnest([x for x in regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+') if x not in ({_STOP})]) as term from eval_queries) group by all)
""")
register("match_and", _match_and, f"with {_AND} select qid, doc_id, score from scored join (select qid, count(*) as size from qt group by qid) using (qid) where matched = size")
register("page_offset", lambda s, d: R.page(_Index(s, d).stored().found(), size=5, start=10).select("qid", "rank", "doc_id", "score"), f"with {_BM25} select qid, {_TOP} as rank, doc_id, score from scored qualify rank between 11 and 15")


def _expand_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """size + N candidates by score, scored again by coverage of the query, cut to size."""
    x = _Index(spark, sf_dir).stored()
    wide = R.page(x.found(), size=30).drop("rank")
    size = x.terms.groupBy("qid").agg(F.count(F.lit(1)).alias("size"))
    again = wide.join(size, "qid").withColumn("score", F.round(F.col("score") * F.col("matched") / F.col("size") + 1e-9, 6))
    return R.page(again, size=10).select("qid", "rank", "doc_id", "score")


register(
    "expand_results", _expand_results,
    f"with {_BM25}, wide as (select *, {_TOP} as r from scored qualify r <= 30), again as (select qid, doc_id, round(score * matched / size + 1e-9, 6) as score from wide join (select qid, count(*) as size from qt group by qid) using (qid)) select qid, {_TOP} as rank, doc_id, score from again qualify rank <= 10",
)
register("score_normalize", lambda s, d: R.normalize(R.page(_Index(s, d).stored().found())).select("qid", "doc_id", "normalized"), f"with {_BM25}, top as (select *, {_TOP} as r from scored qualify r <= 10) select qid, doc_id, round(score / max(score) over (partition by qid), 6) as normalized from top")


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank lists of clauses run separately (query and description), scores summed by document."""
    x = _Index(spark, sf_dir).stored()
    lists = [R.page(x.found()), R.page(R.match_or(x.posts, x.dl, R.query_terms(x.queries, text="description")))]
    return R.page(R.boolean(lists)).select("qid", "rank", "doc_id", "score")


_BM25_D = _BM25.replace("lower(query)", "lower(description)").replace("qt", "qtd").replace("scored", "scored_d").replace("df as (select", "dfx as (select").replace("join df", "join dfx").replace("st as", "stx as").replace(", st ", ", stx ")
_DESCRIBED = _BM25_D.split("dl as (select doc_id, coalesce(len(w), 0) as dl from words)\n", 1)[1].lstrip(", \n")
register("merge_clauses", _merge, f"with {_BM25}, {_DESCRIBED}, lists as (select qid, doc_id, score, {_TOP} as r from scored qualify r <= 10 union all select qid, doc_id, score, {_TOP} as r from scored_d qualify r <= 10), merged as (select qid, doc_id, round(sum(score), 6) as score from lists group by all) select qid, {_TOP} as rank, doc_id, score from merged qualify rank <= 10")


def _bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """should: query; must: source of kind wiki (extra clause with wildcard); must_not: German documents."""
    x = _Index(spark, sf_dir).stored()
    found = x.found()
    kinds = x.docs.select("doc_id", F.col("source").like("wiki/%").alias("wiki"), (F.col("lang") == "de").alias("german"))
    tagged = found.join(kinds, "doc_id")
    must = tagged.where("wiki").select("qid", "doc_id", F.lit(1.0).alias("score"))
    return R.page(R.boolean([found], [must], tagged.where("german"))).select("qid", "rank", "doc_id", "score")


register("bool_must_should", _bool, f"with {_BM25}, kept as (select qid, doc_id, round(score + 1, 6) as score from scored join documents using (doc_id) where source like 'wiki/%' and not coalesce(lang = 'de', false)) select qid, {_TOP} as rank, doc_id, score from kept qualify rank <= 10")


def _penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _Index(spark, sf_dir).stored()
    return R.penalties(R.page(x.found()), x.posts, x.terms)


_PENALTY = f"""with {_BM25}, top as (select *, {_TOP} as r from scored qualify r <= 10),
sized as (select qid, doc_id, cast(matched as double) as i, d, q from top join (select doc_id, count(*) as d from post group by 1) using (doc_id) join (select qid, count(*) as q from qt group by 1) using (qid))
select qid, doc_id, strategy, round(penalty, 6) as penalty from (
  select qid, doc_id, unnest(['no-normalization', 'by-query-size', 'by-document-size', 'by-union-size', 'by-intersection-size', 'intersection-size']) as strategy,
    unnest([1.0, i / q, i / d, i / (q + d - i), 1.0, 1 / i]) as penalty from sized)"""
register("penalty_strategies", _penalties, _PENALTY)


def _phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = load(spark, sf_dir, "subject_areas").select(F.explode("content").alias("phrase"))
    return areas.select(F.col("phrase").alias("phrase_id"), T.words(F.col("phrase")).alias("terms")).where(F.size("terms") > 1)


register(
    "phrase_match", lambda s, d: R.phrases(_Index(s, d).tokens, _phrase_table(s, d)).withColumn("start", F.col("start").cast("bigint")),
    rf"with {_TOKENS}, ph as (select phrase as phrase_id, regexp_extract_all(lower(phrase), '[\p{{L}}\p{{N}}]+') as p from (select unnest(content) as phrase from subject_areas)) select phrase_id, a.doc_id, a.pos as start from ph join tok a on a.term = p[1] join tok b on b.doc_id = a.doc_id and b.pos = a.pos + 1 and b.term = p[2] where len(p) = 2",
)
register(
    "phrase_slop", lambda s, d: R.phrases(_Index(s, d).tokens, _phrase_table(s, d), slop=3).groupBy("phrase_id", "doc_id").agg(F.count(F.lit(1)).alias("places")),
    rf"with {_TOKENS}, ph as (select phrase as phrase_id, regexp_extract_all(lower(phrase), '[\p{{L}}\p{{N}}]+') as p from (select unnest(content) as phrase from subject_areas)) select phrase_id, a.doc_id, count(distinct a.pos) as places from ph join tok a on a.term = p[1] join tok b on b.doc_id = a.doc_id and b.term = p[2] and b.pos > a.pos and b.pos - a.pos - 1 <= 3 where len(p) = 2 group by all",
)


def _expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _Index(spark, sf_dir).stored()
    return R.expand(x.terms, R.page(x.found(), size=3), x.posts)


_EXPAND = rf"""with {_BM25}, fb as (select qid, doc_id, {_TOP} as r from scored qualify r <= 3), ts as (select term, count(*) as df, sum(tf) as ttf from post group by term),
n as (select count(distinct doc_id) as n from post),
v as (select qid, term, tf / ttf as v from fb join post using (doc_id) join ts using (term), n where df / n < 0.4 and df > 1 and tf / ttf > 0.25
  union all select qid, term, 1 + boost / sum(boost) over (partition by qid) from qt where not regexp_matches(term, '^([0-9]+\.?[0-9]*|\.[0-9]+)$')),
m as (select qid, term, round(avg(v), 9) as v from v group by all),
best as (select qid, term, v, row_number() over (partition by qid order by v desc, term) as r from m qualify r <= 128)
select qid, term, round(v / min(v) over (partition by qid), 6) as weight from best"""
# the query's share is taken over all its terms, numbers included
_EXPAND = _EXPAND.replace("select qid, term, 1 + boost / sum(boost) over (partition by qid) from qt where", "select qid, term, v from (select qid, term, 1 + boost / sum(boost) over (partition by qid) as v from qt) where")
register("query_expansion", _expansion, _EXPAND)


def _see_also(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _Index(spark, sf_dir).stored()
    return R.min_max(R.more_like(R.page(x.found(), size=1), x.posts), "score", []).select("src", "dst", "score", "scaled")


_SEE = f"""with {_BM25}, src as (select distinct doc_id from (select doc_id, {_TOP} as r from scored qualify r = 1)), n as (select count(distinct doc_id) as n from post),
ts as (select term, count(*) as df from post group by term),
w as (select doc_id, term, round(tf * ln(n / df), 9) as w from post join ts using (term), n where df > 1 and df <= n * 0.1 and doc_id in (select doc_id from src)),
top as (select *, row_number() over (partition by doc_id order by w desc, term) as r from w qualify r <= 10),
f as (select top.doc_id as src, post.doc_id as dst, round(sum(w), 6) as score from top join post using (term) where top.doc_id <> post.doc_id group by all),
g as (select *, row_number() over (partition by src order by score desc, dst) as r from f qualify r <= 5)
select src, dst, score, round(coalesce((score - min(score) over ()) / nullif(max(score) over () - min(score) over (), 0), 0), 6) as scaled from g"""
register("see_also", _see_also, _SEE)


def _suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "relation_names").where("sentence is not null").select(F.trim(F.regexp_replace("sentence", r"#{2,}\s*[A-Za-z]+\s*#{2,}", "")).alias("input"), F.col("count").alias("weight"))
    return R.suggest(names, "co", 10)


register("suggest_prefix", _suggest, r"select lower(trim(regexp_replace(sentence, '#{2,}\s*[A-Za-z]+\s*#{2,}', '', 'g'))) as input, max(\"count\") as weight from relation_names where lower(trim(regexp_replace(sentence, '#{2,}\s*[A-Za-z]+\s*#{2,}', '', 'g'))) like 'co%' group by 1 order by weight desc nulls last, 1 limit 10".replace('\\"', '"'))


def _bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = load(spark, sf_dir, "tagged_docs").select("tagged_id", F.posexplode("content_morphosyntax").alias("pos_no", "t")).select("tagged_id", "pos_no", F.lower(F.trim("t.lemma")).alias("lemma"), F.coalesce("t.pos", F.lit("X")).alias("pos"))
    return R.bag_of_words(tagged.where("lemma <> ''"), ~F.col("pos").isin(*DROPPED_POS), "tagged_id")


#: Parts of speech that queries leave out (fixed values).
DROPPED_POS = ("ADP", "ADV", "AUX", "CONJ", "CCONJ", "DET", "INTJ", "PRON", "PUNCT", "SYM", "SPACE", "NUM")
_DROPPED = ", ".join(f"'{p}'" for p in DROPPED_POS)
register(
    "query_bow", _bow,
    f"""with t as (select tagged_id, i, lower(trim(m[i].lemma)) as lemma, coalesce(m[i].pos, 'X') not in ({_DROPPED}) as keep from (select tagged_id, content_morphosyntax as m, unnest(range(1, len(content_morphosyntax) + 1)) as i from tagged_docs)),
u as (select *, max(cast(keep as int)) over (partition by tagged_id) as anyk from t where lemma <> ''),
c as (select tagged_id, lemma, count(*) as c, min(i) as first from u where keep or anyk = 0 group by all),
w as (select *, cast(floor(c / min(c) over (partition by tagged_id)) as int) as weight from c),
r as (select *, row_number() over (partition by tagged_id order by weight desc, first) as r from w qualify r <= 64)
select tagged_id, string_agg(lemma, ' ' order by r) as bow, string_agg(trim(repeat(lemma || ' ', weight)), ' ' order by r) as boosted from r group by tagged_id""",
)
