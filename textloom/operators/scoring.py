"""Frames around model scores: classification, sentiment, answers, summaries, blocks and embeddings.

Scorers are pluggable: anything that gives a column or table of scores.  The built-in ones are deterministic
counts of words from lists, so every frame can be run and checked without a model.

Defined results: documents without sentences have no scores; equal scores go to the first label; a zero
total keeps scores as they are; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import broadcast_if_small


def sentence_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, sent, sentence, n_words)."""
    rows = df.select(F.col(id_col).alias("doc"), F.posexplode(T.sentences(F.col(text_col))).alias("sent", "sentence"))
    return rows.withColumn("n_words", F.size(T.words(F.col("sentence"))))


def overlap_scores(sents: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, sent, n_words, label, score): share of a sentence's words that a class (label, word) lists; 0 where none is."""
    words = sents.where("n_words > 0").select("doc", "sent", "n_words", F.explode(T.words(F.col("sentence"))).alias("word"))
    hits = words.join(broadcast_if_small(classes), "word").groupBy("doc", "sent", "n_words", "label").agg(F.count(F.lit(1)).alias("c"))
    return hits.select("doc", "sent", "n_words", "label", (F.col("c") / F.col("n_words")).alias("score"))


def document_scores(sents: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc, label, score, weighted): mean over all sentences, plain and weighted by their words."""
    total = sents.where("n_words > 0").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    summed = scores.groupBy("doc", "label").agg(F.sum("score").alias("s"), F.sum(F.col("score") * F.col("n_words")).alias("sw"))
    return summed.join(total, "doc").select("doc", "label", F.round(F.col("s") / F.col("n"), 6).alias("score"), F.round(F.col("sw") / F.col("w"), 6).alias("weighted"))


def relabel(scores: DataFrame, master: DataFrame, strategy: str = "max") -> DataFrame:
    """(doc, label, score): sub-classes (label, master) brought together by max, mean or sum, then scaled to a sum of 1."""
    how = {"max": F.max, "mean": F.avg, "sum": F.sum}[strategy]
    joined = scores.join(broadcast_if_small(master), "label").groupBy("doc", F.col("master").alias("label")).agg(how("score").alias("s"))
    total = F.sum("s").over(Window.partitionBy("doc"))
    return joined.select("doc", "label", F.round(F.coalesce(F.col("s") / F.nullif(total, F.lit(0.0)), F.col("s")), 6).alias("score"))


def sentiment(sents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc, positive, negative): each sentence gives its score to its side and the rest to the other; lexicon (word, sign)."""
    words = sents.where("n_words > 0").select("doc", "sent", F.explode(T.words(F.col("sentence"))).alias("word"))
    known = words.join(broadcast_if_small(lexicon), "word", "left")
    per = known.groupBy("doc", "sent").agg(F.sum(F.when(F.col("sign") > 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("sign") < 0, 1).otherwise(0)).alias("n"))
    score = (F.greatest("p", "n") + 1) / (F.col("p") + F.col("n") + 2)
    positive = F.when(F.col("p") >= F.col("n"), score).otherwise(1 - score)
    return per.groupBy("doc").agg(F.round(F.sum(positive) / F.count(F.lit(1)), 6).alias("positive"), F.round(F.sum(1 - positive) / F.count(F.lit(1)), 6).alias("negative"))


def coverage(question: Column, text: Column, stop: list[str]) -> Column:
    """Part of a question's words, stop words aside, that occur in the text."""
    q = F.array_distinct(T.analyze(question, stop))
    low = F.lower(text)
    return F.coalesce(F.size(F.filter(q, lambda w: low.contains(w))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def group_answers(answers: DataFrame) -> DataFrame:
    """(qid, answer, score, count, places): equal answers to a question brought together; answers (qid, answer, score, place)."""
    return answers.groupBy("qid", "answer").agg(F.round(F.avg("score"), 6).alias("score"), F.count(F.lit(1)).alias("count"), F.array_join(F.array_sort(F.collect_set("place")).cast("array<string>"), ",").alias("places"))


def best_answers(grouped: DataFrame, most: int = 3) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("count"), "answer")
    return grouped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def summary_lengths(words: Column, least: int = 0, most: int = 0, least_percent: int = 0, most_percent: int = 0) -> tuple[Column, Column]:
    """(least, most) words of a summary; percentages go before numbers, and most is raised by 10 where it isn't above least."""
    low = F.floor(words * least_percent / 100).cast("int") if least_percent else F.lit(least)
    high = F.floor(words * most_percent / 100).cast("int") if most_percent else F.lit(most)
    return low, F.when(high <= low, high + 10).otherwise(high)


def extractive_summary(sents: DataFrame, most: int = 2) -> DataFrame:
    """(doc, summary): the ``most`` sentences of greatest mean inverse document frequency, in order of the text."""
    words = sents.where("n_words > 0").select("doc", "sent", F.explode(T.words(F.col("sentence"))).alias("word"))
    df = words.groupBy("word").agg(F.countDistinct("doc").alias("df"))
    n = sents.agg(F.countDistinct("doc").alias("n"))
    scored = words.join(df, "word").crossJoin(F.broadcast(n)).groupBy("doc", "sent").agg(F.round(F.avg(F.log(F.col("n") / F.col("df"))), 6).alias("s"))  # one row
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("s"), "sent"))).where(F.col("r") <= most)
    kept = top.join(sents.select("doc", "sent", "sentence"), ["doc", "sent"])
    listed = F.array_sort(F.collect_list(F.struct("sent", "sentence")))  # ``most`` at most
    return kept.groupBy("doc").agg(F.array_join(F.transform(listed, lambda x: x["sentence"]), " ").alias("summary"))


def pack_blocks(items: Column, sizes: Column, capacity: int) -> Column:
    """Items in order in blocks whose sizes sum to ``capacity`` at most; a larger item is a block of its own."""
    zipped = F.arrays_zip(items.alias("v"), sizes.alias("n"))
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        size = F.coalesce(x["n"].cast("int"), F.lit(0))
        fits = (acc["n"] + size <= capacity) | (F.size(acc["open"]) == 0)
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x["v"])).alias("open"), (acc["n"] + size).alias("n"))
        fresh = F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.array(x["v"]).alias("open"), size.alias("n"))
        return F.when(fits, grown).otherwise(fresh)

    return F.aggregate(zipped, zero, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def split_tokens(tokens: Column, longest: int = 64, least: int = 3) -> Column:
    """Token blocks of ``longest`` at most, cut before a mark once a block has ``least`` tokens, else hard.

    Sequences that fit are one block.
    """
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(acc: Column, t: Column) -> Column:
        n = F.size(acc["open"])
        cut = (n >= longest) | ((n >= least) & t.rlike(r"^[^\p{L}\p{N}]+$"))
        return F.when(cut, F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.array(t).alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(t)).alias("open")))

    blocks = F.aggregate(tokens, zero, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(F.size(tokens) <= longest, F.array(tokens)).otherwise(blocks)


def split_phrases(tokens: Column, marks: Column, longest: int = 30) -> Column:
    """Phrases of a long sentence: cut at marked separators (dropped), merged while below ``longest``, hard cut beyond.

    marks: a boolean for each token.
    """
    zipped = F.arrays_zip(tokens.alias("t"), marks.alias("m"))
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))
    pieces = F.aggregate(
        zipped, zero,
        lambda acc, x: F.when(F.coalesce(x["m"], F.lit(False)), F.struct(F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.array().cast("array<string>").alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x["t"])).alias("open"))),
        lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
    )
    hard = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / longest).cast("int")), lambda i: F.slice(p, i * longest + 1, F.lit(longest)))))
    joined = F.transform(hard, lambda p: F.array_join(p, " "))
    merged = pack_blocks(joined, F.transform(hard, lambda p: F.size(p)), longest)
    return F.when(F.size(tokens) <= longest, F.array(F.array_join(tokens, " "))).otherwise(F.transform(merged, lambda b: F.array_join(b, " ")))


def running_offsets(df: DataFrame, by: str, order: str, length: str, ranges: int = 64) -> DataFrame:
    """``df`` with column start: the sum of the lengths before in the group, by a numeric order.

    The order's values are cut into ranges of like size; sums run inside (group, range), and those of the ranges
    before are added, so a group of any size is spread over tasks.
    """
    bounds = df.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.01)
    number = F.lit(0)
    for k, bound in enumerate(sorted(set(bounds)), 1):
        number = F.when(F.col(order) >= bound, k).otherwise(number)
    rows = df.withColumn("_range", number)
    inside = Window.partitionBy(by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, "_range").agg(F.sum(length).alias("_t"))  # ``ranges`` rows a group at most
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    out = rows.withColumn("_inside", F.coalesce(F.sum(length).over(inside), F.lit(0))).join(before, [by, "_range"])
    return out.withColumn("start", F.col("_inside") + F.col("_before")).select(*df.columns, "start")
