"""Ranking metrics over a run and its judgements, for all queries and depths in one job.

run: (qid, rank from 1, doc_id, score); qrels: (qid, doc_id, rel).  Each run row is led to its judgement by one join,
then windows over a query's ranks give all metrics.

Defined results: unjudged documents have relevance 0; queries without relevant documents have recall 0;
a query absent from the run has all metrics 0 and Gini and mean score -1; a repeated judgement counts by its largest
value; ties of a run are settled by its ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPTHS = (10, 50, 100, 500)


def metrics(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(qid, k, precision, recall, f1, ndcg, map, mrr, mean_score, gini)."""
    judged = qrels.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))
    deepest = max(depths)
    joined = run.where(F.col("rank") <= deepest).join(judged, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    at = Window.partitionBy("qid").orderBy("rank")
    rows = joined.withColumn("hit", (F.col("rel") > 0).cast("int")).withColumn("hits", F.sum("hit").over(at))
    ideal = judged.where("rel > 0").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"))))
    cuts = F.explode(F.array(*[F.lit(k) for k in depths])).alias("k")
    best = ideal.select("qid", "r", "rel", cuts).groupBy("qid", "k").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= F.col("k"), F.col("rel") / F.log2(F.col("r") + 1))).alias("idcg"))
    cut = rows.select("*", cuts).where(F.col("rank") <= F.col("k"))
    # sum over all pairs |a - b| of a sorted list is a weighted sum, so no list is joined with itself
    order = Window.partitionBy("qid", "k").orderBy("score", "rank")
    cut = cut.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid", "k")))
    got = cut.groupBy("qid", "k").agg(
        F.sum("hit").alias("found"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("ap"),
        F.max(F.when(F.col("hit") == 1, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), F.avg("score").alias("mean_score"),
        (2 * F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("score"))).alias("spread"),
    )
    queries = run.select("qid").union(qrels.select("qid")).distinct().select("qid", cuts)
    out = queries.join(got, ["qid", "k"], "left").join(best, ["qid", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.col("found") / F.col("k")), zero(F.col("found") / F.col("relevant"))
    named = {
        "precision": precision, "recall": recall, "f1": zero(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))), "ndcg": zero(F.col("dcg") / F.col("idcg")),
        "map": zero(F.col("ap") / F.col("relevant")), "mrr": zero(F.col("mrr")), "mean_score": F.coalesce("mean_score", F.lit(-1.0)), "gini": F.coalesce(F.col("spread") / (2 * F.nullif("mean_score", F.lit(0.0))), F.lit(-1.0)),
    }
    return out.select("qid", "k", *[F.round(c, 6).alias(n) for n, c in named.items()])


def overall(per_query: DataFrame) -> DataFrame:
    """Means over all queries for each depth."""
    return per_query.groupBy("k").agg(*[F.round(F.avg(c), 6).alias(c) for c in per_query.columns if c not in ("qid", "k")])


def described(per_query: DataFrame) -> DataFrame:
    """(k, metric, count, mean, std, min, q1, median, q3, max) of every metric over all queries for each depth."""
    names = [c for c in per_query.columns if c not in ("qid", "k")]
    long = per_query.select("k", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in names])).alias("m")).select("k", "m.*")
    quartiles = [F.percentile("x", p).alias(c) for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return long.groupBy("k", "metric").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), *quartiles, F.max("x").alias("max"))


def document_numbers(names: DataFrame, known: DataFrame, first_new: int = 10_000_000) -> DataFrame:
    """(name, number): numbers of known names (name, number), further ones from ``first_new`` on.

    New names are numbered by (two digits of their MD5, name): counted by those digits, and numbered inside them.
    """
    distinct = names.select("name").distinct().join(known, "name", "left")
    new = distinct.where("number is null").select("name", F.substring(F.md5("name"), 1, 2).alias("b"))
    before = new.groupBy("b").agg(F.count(F.lit(1)).alias("n")).selectExpr("b", "sum(n) over (order by b) - n as before")  # 256 rows at most
    own = F.row_number().over(Window.partitionBy("b").orderBy("name"))
    fresh = new.withColumn("own", own).join(F.broadcast(before), "b").select("name", (F.col("before") + F.col("own") - 1 + first_new).cast("bigint").alias("number"))
    return distinct.where("number is not null").unionByName(fresh)
