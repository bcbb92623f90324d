"""Inverted index as tables: tokens, postings, term and field statistics, and its upkeep.

Defined results: null and empty texts have no tokens and length 0; a repeated identifier is indexed as
it comes (``upsert_latest`` removes it); empty tables give empty tables and statistics of 0 documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tokens(df: DataFrame, id_col: str, text_col: str, terms: Column | None = None) -> DataFrame:
    """(doc_id, pos, term): one row for each word."""
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(terms if terms is not None else T.words(F.col(text_col))).alias("pos", "term"))


def postings(toks: DataFrame, positions: bool = False) -> DataFrame:
    """(doc_id, term, tf) and, if wanted, the positions; rows of a document meet in the map-side aggregate."""
    aggregates = [F.count(F.lit(1)).alias("tf")] + ([F.array_sort(F.collect_list("pos")).alias("positions")] if positions else [])
    return toks.groupBy("doc_id", "term").agg(*aggregates)


def stored_postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf, dl): postings that carry their document's length, so that scoring needs no join for it.

    The words are made by a generator of their own, and the length is taken before they are spread: otherwise the
    text would be cut into words again for every row.
    """
    once = df.select(F.col(id_col).alias("doc_id"), F.explode(F.array(T.words(F.col(text_col)))).alias("w")).select("doc_id", F.size("w").cast("bigint").alias("dl"), "w")
    return once.select("doc_id", "dl", F.explode("w").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def lengths(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, dl) of all documents, without any shuffle."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.size(T.words(F.col(text_col))), F.lit(0)).cast("bigint").alias("dl"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df, ttf)."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))


def field_stats(posts: DataFrame) -> DataFrame:
    """(doc_count, sum_df, sum_ttf): one row."""
    per_doc = posts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("t"))
    return per_doc.agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("sum_df"), F.coalesce(F.sum("t"), F.lit(0)).alias("sum_ttf"))


def upsert_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; ranks are cut before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def delete_by_id(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the tombstones (null keys stay)."""
    return df.join(tombstones.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def not_yet_done(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Incremental work: what has no marker yet."""
    return delete_by_id(files, done, key)


def index_documents(docs: DataFrame, kg: str = "kg") -> DataFrame:
    """Index rows of converted documents: identity, joined text, flattened distinct triples and suggestions.

    A triple is one whatever its positions; suggestions are the distinct subjects, weight 100 / number of triples.
    """
    text = F.coalesce(F.concat_ws(" ", "content"), F.lit(""))
    entry = lambda e: F.coalesce(F.array_join(e["content"], " "), F.lit(""))
    triples = F.array_distinct(F.coalesce(F.transform(kg, lambda t: F.struct(entry(t["subject"]).alias("s"), entry(t["property"]).alias("p"), entry(t["value"]).alias("o"))), F.array().cast("array<struct<s:string,p:string,o:string>>")))
    out = docs.select("data_source", "source_doc_id", "title", text.alias("content"), triples.alias("triples"))
    suggest = F.array_distinct(F.transform("triples", lambda t: t["s"]))
    weight = (F.lit(100) / F.greatest(F.size("triples"), F.lit(1))).cast("int")
    return out.select(T.content_id(F.col("title"), F.col("content"), F.col("source_doc_id")).alias("index_id"), "data_source", "source_doc_id", "title", "content", "triples", suggest.alias("suggestions"), weight.alias("suggestion_weight"))
