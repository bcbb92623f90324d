"""Retrieval over the index tables: clauses, scores, strategies, paging.

Queries are a table (qid, text): all queries run in one job.  The query side is counted before it is broadcast;
above the bound the joins are shuffled.

Defined results: queries without a term find nothing; equal scores go to the smaller document; scores are
rounded to 6 digits before they are ranked; documents without words match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import BROADCAST_ROWS, broadcast_if_small

K1, B = 1.2, 0.75


def query_terms(queries: DataFrame, qid: str = "qid", text: str = "query", terms: Column | None = None, cut: int = 0) -> DataFrame:
    """(qid, term, boost): distinct terms, boost = occurrences in the query, or in its first ``cut`` words."""
    words = terms if terms is not None else T.words(F.col(text))
    w = queries.select(F.col(qid).alias("qid"), F.explode(F.slice(words, 1, cut) if cut > 0 else words).alias("term"))
    return w.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("boost"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weights(posts: DataFrame, dl: DataFrame, k1: float = K1, b: float = B, few_terms: bool = False) -> DataFrame:
    """(doc_id, term, w) for postings already cut to wanted terms; statistics are those of all documents.

    ``few_terms``: the terms were counted to be few enough for their frequencies to be broadcast.
    """
    stats = dl.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = posts if "dl" in posts.columns else posts.join(dl, "doc_id")
    joined = own.join(F.broadcast(df) if few_terms else df, "term").crossJoin(F.broadcast(stats))  # one row
    tf = F.col("tf").cast("double")
    return joined.select("doc_id", "term", (idf(F.col("n"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("w"))


def match_or(posts: DataFrame, dl: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, doc_id, score, matched): sum of the weights of the query's terms in the document.

    With stored postings and a query side within the bound, the only shuffle is that of the partial sums.
    """
    few = terms.count() <= BROADCAST_ROWS
    send = F.broadcast if few else lambda df: df
    near = posts.join(send(terms.select("term").distinct()), "term", "left_semi")
    weights = bm25_weights(near, dl, few_terms=few)
    return weights.join(send(terms), "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("boost")), 6).alias("score"), F.count(F.lit(1)).alias("matched"))


def match_and(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Those of ``match_or`` that have every term of the query."""
    size = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("size"))
    return found.join(size, "qid").where("matched = size").drop("size")


def phrases(toks: DataFrame, phrase_table: DataFrame, slop: int = 0) -> DataFrame:
    """(phrase_id, doc_id, start): places where a phrase's terms follow in order with ``slop`` words between in all.

    phrase_table: (phrase_id, terms array).  Each further term is one join on (document, term) with a bound of places.
    """
    table = phrase_table.where(F.size("terms") > 0)
    terms = table.select(F.explode("terms").alias("term")).distinct()
    near = toks.join(broadcast_if_small(terms), "term", "left_semi")
    state = near.join(broadcast_if_small(table), F.col("term") == F.col("terms")[0]).select("phrase_id", "terms", "doc_id", F.col("pos").alias("start"), F.col("pos").alias("at"))
    done = state.where(F.size("terms") == 1)
    steps = [r["n"] for r in table.select(F.size("terms").alias("n")).distinct().collect()]  # a few numbers
    for k in range(1, max(steps, default=1)):
        nxt = near.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("term").alias("t"))
        on = (F.col("doc_id") == F.col("d")) & (F.get("terms", F.lit(k)) == F.col("t")) & (F.col("p") > F.col("at")) & (F.col("p") - F.col("start") <= k + slop)
        state = state.where(F.size("terms") > k).join(nxt, on).groupBy("phrase_id", "terms", "doc_id", "start").agg(F.min("p").alias("at"))
        done = done.unionByName(state.where(F.size("terms") == k + 1))
    return done.select("phrase_id", "doc_id", "start")


def boolean(should: list[DataFrame], must: list[DataFrame] | None = None, must_not: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score) of clauses of that form: scores of must and should add up, every must has to match."""
    clauses = [c.select("qid", "doc_id", "score") for c in should]
    out = None
    for c in [*clauses, *[m.select("qid", "doc_id", "score") for m in must or []]]:
        out = c if out is None else out.unionByName(c)
    out = out.groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    for m in must or []:
        out = out.join(m.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    return out if must_not is None else out.join(must_not.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")


def page(found: DataFrame, size: int = 10, start: int = 0, by: str = "score") -> DataFrame:
    """Ranks start + 1 to start + size of every query."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), "doc_id"))
    return found.withColumn("rank", rank).where((F.col("rank") > start) & (F.col("rank") <= start + size))


def normalize(found: DataFrame) -> DataFrame:
    """Scores divided by the best of their query."""
    return found.withColumn("normalized", F.round(F.col("score") / F.max("score").over(Window.partitionBy("qid")), 6))


def min_max(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``value`` scaled to 0..1 within its group (of all rows if none is named); 0 where all are equal."""
    bounds = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    joined = df.join(bounds, by) if by else df.crossJoin(F.broadcast(bounds))  # one row
    scaled = F.coalesce((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit(0.0))
    return joined.withColumn("scaled", F.round(scaled, 6)).drop("_low", "_high")


#: Penalties of a document by the sizes of the query's and document's sets of terms.
PENALTIES = {
    "no-normalization": lambda q, d, i: F.lit(1.0),
    "by-query-size": lambda q, d, i: i / F.nullif(q, F.lit(0)),
    "by-document-size": lambda q, d, i: i / F.nullif(d, F.lit(0)),
    "by-union-size": lambda q, d, i: i / F.nullif(q + d - i, F.lit(0)),
    "by-intersection-size": lambda q, d, i: i / F.nullif(i, F.lit(0)),
    "intersection-size": lambda q, d, i: F.lit(1.0) / F.nullif(i, F.lit(0)),
}


def penalties(found: DataFrame, posts: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, doc_id, strategy, penalty) for every candidate and strategy at once."""
    size_d = posts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("d"))
    size_q = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("q"))
    sized = found.select("qid", "doc_id", F.col("matched").alias("i")).join(size_d, "doc_id").join(size_q, "qid")
    q, d, i = (F.col(c).cast("double") for c in "qdi")
    each = F.array(*[F.struct(F.lit(k).alias("strategy"), F.round(F.coalesce(f(q, d, i), F.lit(0.0)), 6).alias("penalty")) for k, f in PENALTIES.items()])
    return sized.select("qid", "doc_id", F.explode(each).alias("x")).select("qid", "doc_id", "x.*")


def expand(terms: DataFrame, feedback: DataFrame, posts: DataFrame, prune: int = 128, widest: float = 0.4, least_part: float = 0.25) -> DataFrame:
    """(qid, term, weight): query expansion from feedback documents (qid, doc_id).

    A document's term counts if it is in less than ``widest`` of the documents, in more than one, and the document holds
    more than ``least_part`` of all its occurrences; its value is that part.  The query's own terms (no numbers) have
    1 + their share of the query.  Values of a term are averaged, the ``prune`` best divided by the smallest of them.
    """
    n = posts.agg(F.countDistinct("doc_id").alias("n"))
    stats = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))
    near = posts.join(broadcast_if_small(feedback.select("qid", "doc_id")), "doc_id").join(stats, "term").crossJoin(F.broadcast(n))  # one row
    valid = near.where((F.col("df") / F.col("n") < widest) & (F.col("df") > 1) & (F.col("tf") / F.col("ttf") > least_part))
    values = valid.select("qid", "term", (F.col("tf") / F.col("ttf")).alias("v"))
    total = F.sum("boost").over(Window.partitionBy("qid"))
    own = terms.withColumn("v", 1 + F.col("boost") / total).where(~T.is_numeric(F.col("term"))).select("qid", "term", "v")
    mean = values.unionByName(own).groupBy("qid", "term").agg(F.round(F.avg("v"), 9).alias("v"))
    best = mean.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("v"), "term"))).where(F.col("r") <= prune)
    return best.select("qid", "term", F.round(F.col("v") / F.min("v").over(Window.partitionBy("qid")), 6).alias("weight"))


def more_like(docs: DataFrame, posts: DataFrame, links: int = 5, terms_each: int = 10, widest: float = 0.1) -> DataFrame:
    """(src, dst, score): see-also graph; documents of ``docs`` (doc_id) against all by their most telling terms."""
    n = posts.agg(F.countDistinct("doc_id").alias("n"))
    stats = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") > 1) & (F.col("df") <= F.col("n") * widest))  # one row
    telling = posts.join(broadcast_if_small(docs.select("doc_id")), "doc_id", "left_semi").join(stats, "term").withColumn("w", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 9))
    top = telling.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("w"), "term"))).where(F.col("r") <= terms_each)
    found = top.select(F.col("doc_id").alias("src"), "term", "w").join(posts.select(F.col("doc_id").alias("dst"), "term"), "term").where("src <> dst")
    scored = found.groupBy("src", "dst").agg(F.round(F.sum("w"), 6).alias("score"))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("r") <= links).drop("r")


def suggest(entries: DataFrame, prefix: str, size: int = 10, text: str = "input", weight: str = "weight") -> DataFrame:
    """(input, weight): completions of a prefix, each once, the heaviest first."""
    safe = prefix.lower()
    found = entries.where(F.lower(F.col(text)).startswith(safe)).groupBy(F.lower(F.col(text)).alias("input")).agg(F.max(weight).alias("weight"))
    return found.orderBy(F.desc("weight"), "input").limit(size)


def bag_of_words(tagged: DataFrame, keep: Column, key: str, lemma: str = "lemma", most: int = 64) -> DataFrame:
    """(key, bow, boosted): distinct lemmas by weight = floor(count / smallest count), then repeated by their weights.

    tagged: (key, pos_no, lemma, pos).  Where no token survives ``keep`` all tokens count.
    """
    w = Window.partitionBy(key)
    rows = tagged.withColumn("_keep", keep).withColumn("_any", F.max(F.col("_keep").cast("int")).over(w))
    rows = rows.where(F.col("_keep") | (F.col("_any") == 0))
    counted = rows.groupBy(key, lemma).agg(F.count(F.lit(1)).alias("c"), F.min("pos_no").alias("first"))
    weighted = counted.withColumn("weight", F.floor(F.col("c") / F.min("c").over(w)).cast("int"))
    top = weighted.withColumn("r", F.row_number().over(w.orderBy(F.desc("weight"), "first"))).where(F.col("r") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("r", lemma, "weight")))  # ``most`` at most
    lists = top.groupBy(key).agg(ordered.alias("l"))
    boosted = F.flatten(F.transform("l", lambda x: F.array_repeat(x[lemma], x["weight"])))
    return lists.select(key, F.array_join(F.transform("l", lambda x: x[lemma]), " ").alias("bow"), F.array_join(boosted, " ").alias("boosted"))
