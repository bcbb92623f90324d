"""Lexicons: building, word normalisation, multi-word expressions and dictionary entities.

A lexicon is a table (pattern array of lower-case tokens, label, weight); the matching joins n-grams of the tokens
with it by equality, so a lexicon of any size works, broadcast only if it was counted to be small.

Defined results: empty patterns and patterns of marks or digits alone are left out; among labels of equal weight
the first in order is taken; null tokens match nothing; overlapping matches are settled from left to
right, the longest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import broadcast_if_small


def build(entries: DataFrame, text: str, label: str, weight: str | None = None, exceptions: DataFrame | None = None, fold: bool = True) -> DataFrame:
    """(pattern, key, n, label, weight): lower case, hyphens apart, folded twins, each pattern and label once."""
    raw = entries.where(F.col(text).isNotNull() & (F.length(text) <= 2048) & F.col(text).rlike(r"\p{L}"))
    if exceptions is not None:
        raw = raw.join(exceptions.select(F.col(exceptions.columns[0]).alias(text)), text, "left_anti")
    low = F.lower(F.trim(F.col(text)))
    forms = F.array_distinct(F.array(low, T.ascii_fold(low))) if fold else F.array(low)
    rows = raw.select(F.explode(forms).alias("f"), F.col(label).alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))
    pattern = F.regexp_extract_all("f", F.lit(r"[\p{L}\p{N}]+|[-&]"), F.lit(0))
    return rows.select(pattern.alias("pattern"), "label", "weight").groupBy("pattern", "label").agg(F.max("weight").alias("weight")).select("pattern", F.array_join("pattern", " ").alias("key"), F.size("pattern").alias("n"), "label", "weight")


def normalize_words(tokens: DataFrame, typos: DataFrame, normal: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` with column normalized: typing errors, then variants replaced, the case pattern kept.

    typos and normal: (form, by) with lower-case forms.
    """
    t = broadcast_if_small(typos.select(F.col("form").alias("_f1"), F.col("by").alias("_by1")))
    n = broadcast_if_small(normal.select(F.col("form").alias("_f2"), F.col("by").alias("_by2")))
    out = tokens.join(t, F.lower(F.col(token)) == F.col("_f1"), "left")
    out = out.join(n, F.coalesce("_by1", F.lower(F.col(token))) == F.col("_f2"), "left")
    by = F.coalesce("_by2", "_by1")
    return out.withColumn("normalized", F.when(by.isNull(), F.col(token)).otherwise(T.reapply_case(F.col(token), by))).drop("_f1", "_by1", "_f2", "_by2")


def candidate_matches(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, start, n, label, weight) of all patterns in token rows (doc_id, pos, term); runs of the lengths that the lexicon has."""
    lengths = sorted(r["n"] for r in lexicon.select("n").distinct().collect())  # a few numbers
    at = Window.partitionBy("doc_id").orderBy("pos")
    n_grams = [F.struct(F.lit(k).alias("n"), F.concat_ws(" ", "term", *[F.lead("term", i).over(at) for i in range(1, k)]).alias("key"), (F.lead("pos", k - 1).over(at) if k > 1 else F.col("pos")).alias("end")) for k in lengths] or [F.struct(F.lit(0).alias("n"), F.lit("").alias("key"), F.lit(None).cast("int").alias("end"))]
    rows = toks.select("doc_id", "pos", F.array(*n_grams).alias("g")).select("doc_id", "pos", F.explode("g").alias("g")).where(F.col("g.end").isNotNull())
    lex = lexicon.select(F.col("key").alias("_k"), F.col("n").alias("_n"), "label", "weight")
    joined = rows.join(broadcast_if_small(lex), (F.col("g.key") == F.col("_k")) & (F.col("g.n") == F.col("_n")))
    return joined.select("doc_id", F.col("pos").alias("start"), F.col("g.n").alias("n"), "label", "weight")


def longest_at_start(matches: DataFrame) -> DataFrame:
    """The longest match of each start with the label of greatest weight."""
    w = Window.partitionBy("doc_id", "start").orderBy(F.desc("n"), F.desc("weight"), "label")
    return matches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def without_overlap(matches: DataFrame) -> DataFrame:
    """Greedy choice from left to right of the longest matches: (doc_id, start, n, label)."""
    spans = F.array_sort(F.collect_list(F.struct("start", "n", "label")))  # of one document
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,n:int,label:string>>").alias("kept"))
    step = lambda acc, s: F.when(s["start"].cast("int") > acc["end"], F.struct((s["start"] + s["n"] - 1).cast("int").alias("end"), F.concat(acc["kept"], F.array(F.struct(s["start"].cast("int").alias("start"), s["n"].cast("int").alias("n"), s["label"].alias("label")))).alias("kept"))).otherwise(acc)
    kept = longest_at_start(matches).groupBy("doc_id").agg(F.aggregate(spans, zero, step)["kept"].alias("k"))
    return kept.select("doc_id", F.explode("k").alias("k")).select("doc_id", "k.*")


def best_label(matches: DataFrame) -> DataFrame:
    """The label of greatest weight of each span."""
    w = Window.partitionBy("doc_id", "start", "n").orderBy(F.desc("weight"), "label")
    return matches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rejoin(toks: DataFrame, words: DataFrame, longest: int = 4) -> DataFrame:
    """(doc_id, start, n, word): words with marks inside that the tokenizer took apart; words: (word) in lower case."""
    at = Window.partitionBy("doc_id").orderBy("pos")
    glued = [F.struct(F.lit(k).alias("n"), F.concat("term", *[F.lead("term", i).over(at) for i in range(1, k)]).alias("w")) for k in range(2, longest + 1)]
    rows = toks.select("doc_id", F.col("pos").alias("start"), F.explode(F.array(*glued)).alias("g")).where(F.col("g.w").isNotNull())
    found = rows.join(broadcast_if_small(words.select(F.col("word").alias("_w")).distinct()), F.col("g.w") == F.col("_w"))
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "start").orderBy(F.desc("g.n")))).where("_r = 1").select("doc_id", "start", F.col("g.n").alias("n"), F.col("g.w").alias("word"))


def drop_overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spans of ``a`` (doc_id, start, n, ...) that overlap none of ``b``: an equi-join on document with a range condition."""
    other = b.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("n").alias("_n"))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("start") < F.col("_s") + F.col("_n")) & (F.col("_s") < F.col("start") + F.col("n"))
    return a.join(other, on, "left_anti")
