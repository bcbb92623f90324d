"""Training corpora: masks, tag projection, event tags, syntax triples and stratification.

Defined results: tokens without a tag are 'O' (or '_' where lemmas are masked); offsets outside a text tag
nothing; sentences without a verb, subject or object give no triple.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of speech whose lemmas are masked (fixed values).
FUNCTION_POS = ("ADP", "AUX", "CCONJ", "DET", "NUM", "PART", "SCONJ", "PRON", "PUNCT", "SYM", "INTJ")
#: Lemmas of these characters alone are masked too.
_MARKS = r"""^[!-/:-@\[-`{-~]*$"""


def mask_lemmas(tokens: Column) -> Column:
    """Lemmas in order, those of function words, of unknown parts of speech and of marks as '_'."""
    hidden = lambda t: F.coalesce(t["pos"].isin(*FUNCTION_POS), F.lit(True)) | F.coalesce(t["lemma"].rlike(_MARKS), F.lit(False))
    return F.array_join(F.transform(tokens, lambda t: F.when(hidden(t), "_").otherwise(F.coalesce(t["lemma"], F.lit("_")))), " ")


def tags_at(length: Column, start: Column, end: Column, tag: Column) -> Column:
    """A tag for each position of a text: ``tag`` in [start, end), 'O' elsewhere."""
    return F.when(length <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when((i >= start) & (i < end), tag).otherwise("O")))


def tag_line(length: Column, start: Column, end: Column, tag: str) -> Column:
    """``tags_at`` as one string, for tags of one letter: three runs, however long the text is."""
    size = F.greatest(length, F.lit(0))
    known = start.isNotNull() & end.isNotNull()
    first = F.when(known, F.least(F.greatest(start, F.lit(0)), size)).otherwise(size)
    last = F.when(known, F.least(F.greatest(end, first), size)).otherwise(size)
    return F.concat(*[F.repeat(F.lit(t), n.cast("int")) for t, n in (("O", first), (tag, last - first), ("O", size - last))])


def map_labels(df: DataFrame, label: str, names: dict[str, str | None]) -> DataFrame:
    """Rows with the label's short name; labels mapped to nothing are dropped, unknown ones stay."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v).cast("string"))]
    table = F.create_map(*pairs)
    known = F.col(label).isin(*names)
    return df.withColumn(label, F.when(known, table[F.col(label)]).otherwise(F.col(label))).where(F.col(label).isNotNull())


def stratify(df: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """(by..., n, first, last): sizes and bounds of the strata."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first"), F.max(id_col).alias("last"))


def splits(df: DataFrame, id_col: str, dev: int = 10, test: int = 10, seed: int = 0) -> DataFrame:
    """``df`` with column split by a hash of the identifier, in percent; stable for the same rows."""
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(100))
    return df.withColumn("split", F.when(h < test, "test").when(h < test + dev, "dev").otherwise("train"))


def syntax_triples(tokens: DataFrame, sent: list[str]) -> DataFrame:
    """(sent..., subject, verb, object) of dependency tokens (sent..., id, form, lemma, upos, head, deprel).

    Subjects are nsubj children of verbs, objects obj, obl or dobj children; verbs joined by conj or xcomp take the subject of their
    head where they have none. Edges are joined on (sentence, head), so a sentence is never gathered.
    """
    verb = tokens.where(F.col("upos").isin("VERB", "AUX")).select(*sent, F.col("id").alias("v"), F.col("lemma").alias("verb"), F.col("head").alias("above"), F.col("deprel").alias("link"))
    child = lambda kinds, name: tokens.where(F.split_part("deprel", F.lit(":"), F.lit(1)).isin(*kinds)).select(*sent, F.col("head").alias("v"), F.col("form").alias(name))
    subjects, objects = child(("nsubj", "csubj"), "subject"), child(("obj", "dobj", "obl", "pobj"), "object")
    own = verb.join(subjects, [*sent, "v"])
    heirs = verb.where(F.col("link").isin("conj", "xcomp", "acl")).join(subjects.select(*sent, "v").distinct(), [*sent, "v"], "left_anti")
    inherited = heirs.join(subjects.withColumnRenamed("v", "above"), [*sent, "above"])
    every = own.select(*sent, "v", "verb", "subject").unionByName(inherited.select(*sent, "v", "verb", "subject"))
    return every.join(objects, [*sent, "v"]).select(*sent, "subject", "verb", "object")


def adjacent_triples(tokens: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, sent, s, p, o, start) of noun group, verb group, noun group that follow each other in a sentence.

    tokens: (doc, pos_no, sent, text, pos).  Groups are islands of like parts of speech; a triple is read off each verb
    group and its two neighbours by ``lag`` and ``lead``.  A leading preposition of the second group goes to the verb.
    """
    from pyspark.sql import Window

    kind = F.when(F.col("pos").isin("NOUN", "PROPN", "ADJ", "DET", "NUM"), "n").when(F.col("pos").isin("VERB", "AUX"), "v").when(F.col("pos") == "ADP", "a").otherwise("x")
    at = Window.partitionBy(doc, "sent").orderBy("pos_no")
    rows = tokens.withColumn("kind", kind).withColumn("before", F.lag("kind").over(at))
    # a preposition right behind a verb group belongs to it
    rows = rows.withColumn("kind", F.when((F.col("kind") == "a") & (F.col("before") == "v"), "v").otherwise(F.col("kind")))
    rows = rows.withColumn("new", (F.coalesce(F.lag("kind").over(at), F.lit("")) != F.col("kind")).cast("int")).withColumn("g", F.sum("new").over(at))
    words = F.array_sort(F.collect_list(F.struct("pos_no", "text", "pos")))  # one group of a sentence
    groups = rows.groupBy(doc, "sent", "g", "kind").agg(words.alias("w"))
    groups = groups.withColumn("w", F.when(F.col("kind") == "n", F.filter("w", lambda x: x["pos"] != "DET")).otherwise(F.col("w")))
    groups = groups.withColumn("phrase", F.array_join(F.transform("w", lambda x: x["text"]), " ")).withColumn("start", F.get("w", F.lit(0))["pos_no"])
    order = Window.partitionBy(doc, "sent").orderBy("g")
    near = groups.select(doc, "sent", "kind", "phrase", "start", F.lag("kind").over(order).alias("k1"), F.lag("phrase").over(order).alias("s"), F.lead("kind").over(order).alias("k2"), F.lead("phrase").over(order).alias("o"))
    return near.where("kind = 'v' and k1 = 'n' and k2 = 'n' and s <> '' and o <> ''").select(doc, "sent", "s", F.col("phrase").alias("p"), "o", "start")
