"""Keyword extraction by co-occurrence of words in candidate phrases.

Candidates are the longest runs of content words inside a sentence (gaps and islands over the running count
of stop words).  Over the distinct phrases of a document a word's frequency is the number of phrases
that hold it, weighted by how often, and its degree the sum of their lengths; a phrase scores the sum over its
words of degree / frequency (or either alone), cut to an integer.

Defined results: documents without content words have no keyword; a phrase repeated in a document is one,
with the span of its last place; null parts of speech count as content; a last sentence of one token is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of speech that end a phrase (fixed values).
PHRASE_STOPS = ("ADP", "ADV", "AUX", "CONJ", "CCONJ", "DET", "INTJ", "SCONJ", "PRON", "PUNCT", "SYM", "SPACE")
POSSIBLE = ("NOUN", "PROPN", "ADJ", "NUM", "X")
AT_LEAST = ("NOUN", "PROPN")


def tagged_tokens(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(doc, pos_no, sent, lemma, text, pos, is_oov): sentence numbers are running counts of sentence starts."""
    rows = df.select(F.col(id_col).alias("doc"), F.posexplode(tokens).alias("pos_no", "t"))
    at = Window.partitionBy("doc").orderBy("pos_no")
    start = F.sum(F.coalesce(F.col("t.is_sent_start"), F.lit(False)).cast("int")).over(at)
    return rows.select("doc", "pos_no", start.alias("sent"), F.lower(F.trim("t.lemma")).alias("lemma"), F.col("t.text").alias("text"), F.col("t.pos").alias("pos"), F.coalesce("t.is_oov", F.lit(False)).alias("is_oov"))


def candidate_phrases(tokens: DataFrame, longest: int = 10, least: int = 1) -> DataFrame:
    """(doc, phrase, n, start, end): distinct phrases, span of the last place."""
    at = Window.partitionBy("doc").orderBy("pos_no")
    stop = F.coalesce(F.col("pos").isin(*PHRASE_STOPS), F.lit(False)) | F.col("lemma").isNull() | (F.col("lemma") == "")
    island = tokens.withColumn("_stop", stop).withColumn("_island", F.sum(F.col("_stop").cast("int")).over(at)).where(~F.col("_stop"))
    words = F.array_sort(F.collect_list(F.struct("pos_no", "lemma", "pos")))  # a run within one sentence
    runs = island.groupBy("doc", "sent", "_island").agg(words.alias("w")).where((F.size("w") >= least) & (F.size("w") <= longest))
    pos = F.transform("w", lambda x: F.coalesce(x["pos"], F.lit("X")))
    valid = runs.where(F.forall(pos, lambda p: p.isin(*POSSIBLE)) & F.exists(pos, lambda p: p.isin(*AT_LEAST)))
    valid = valid.select("doc", F.array_join(F.transform("w", lambda x: x["lemma"]), " ").alias("phrase"), F.size("w").alias("n"), F.col("w")[0]["pos_no"].alias("start"), (F.element_at("w", -1)["pos_no"] + 1).alias("end"))
    return valid.groupBy("doc", "phrase").agg(F.max("n").alias("n"), F.max(F.struct("start", "end")).alias("s")).select("doc", "phrase", "n", "s.start", "s.end")


def word_scores(phrases: DataFrame) -> DataFrame:
    """(doc, word, freq, degree); no product of words with words is built."""
    words = phrases.select("doc", "n", F.explode(F.split("phrase", " ")).alias("word"))
    return words.groupBy("doc", "word").agg(F.count(F.lit(1)).alias("freq"), F.sum("n").alias("degree"))


def rank(phrases: DataFrame, metric: str = "ratio") -> DataFrame:
    """(doc, phrase, score, start, end); metric ratio, degree or frequency."""
    value = {"ratio": F.col("degree") / F.col("freq"), "degree": F.col("degree").cast("double"), "frequency": F.col("freq").cast("double")}[metric]
    words = phrases.select("doc", "phrase", "start", "end", F.explode(F.split("phrase", " ")).alias("word"))
    scored = words.join(word_scores(phrases), ["doc", "word"]).groupBy("doc", "phrase", "start", "end").agg(F.sum(value).alias("s"))
    return scored.select("doc", "phrase", F.floor(F.col("s") + 1e-9).cast("int").alias("score"), "start", "end")


def rebuild_sentences(tokens: DataFrame, value: str = "text") -> DataFrame:
    """(doc, sent, sentence) of texts or lemmas, in order."""
    words = F.array_sort(F.collect_list(F.struct("pos_no", F.col(value).alias("v"))))  # one sentence
    return tokens.groupBy("doc", "sent").agg(F.array_join(F.transform(words, lambda x: x["v"]), " ").alias("sentence"))
