"""Annotation without models: parts of speech by rule, patterns over them, entities, concepts, hashed vectors.

Each step takes and gives tables, so that a model can take its place; the rules are built-in expressions.

Defined results: null texts have no tokens; tokens no rule knows are nouns (capitalised: proper nouns);
entities whose tokens fail the rules are dropped; overlapping spans are settled by ``lexicon.drop_overlapping``.
"""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Function words by part of speech (fixed values).
CLOSED = {
    "DET": "a an the this that these those every each some any no both".split(),
    "ADP": "of in on at by for from with without to into over under before after about near between through since as".split(),
    "PRON": "i you he she it we they me him her us them who which what somebody nobody".split(),
    "AUX": "is are was were be been being am has have had do does did can could may might must shall should will would".split(),
    "CCONJ": "and or but nor".split(),
    "SCONJ": "because if when while although whether once unless".split(),
    "ADV": "not now then there here very too also only often never soon still again".split(),
}
#: One letter for each part of speech, for patterns.
CODES = {"NOUN": "n", "PROPN": "p", "ADJ": "j", "VERB": "v", "AUX": "x", "DET": "d", "ADP": "a", "PRON": "r", "ADV": "b", "NUM": "m", "CCONJ": "c", "SCONJ": "s", "PUNCT": "u", "PART": "t"}
#: Patterns over those letters: groups of nouns, of verbs, numbers with a noun.
PATTERNS = {"noun_group": "d?j*[np]+(?:a[dj]*[np]+)?", "verb_group": "x*b?v+a?|x+", "quantity": "m+[np]+"}


def tag_words(tokens: DataFrame, word: str = "term") -> DataFrame:
    """``tokens`` with column pos by word lists and endings."""
    w = F.lower(F.col(word))
    out = T.token_class(F.col(word))
    for pos, words in CLOSED.items():
        out = F.coalesce(out, F.when(w.isin(*words), pos))
    out = F.coalesce(out, F.when(F.col(word).rlike(r"^\p{Lu}\p{Ll}"), "PROPN").when(w.rlike("(ed|ing|ise|ize|ises|izes|ised|ized)$"), "VERB").when(w.rlike("ly$"), "ADV").when(w.rlike("(ous|ful|able|ible|al|ic|ive|ary|less)$"), "ADJ"))
    return tokens.withColumn("pos", F.coalesce(out, F.lit("NOUN")))


def retag_marks(pos: Column, text: Column) -> Column:
    """Marks that taggers miss as PUNCT."""
    return F.when(text.isin("*", ",", ";", "?", "!", "/"), "PUNCT").otherwise(pos)


def pretag(pos: Column, lexicon_pos: Column) -> Column:
    """The lexicon's part of speech where it has one."""
    return F.coalesce(lexicon_pos, pos)


def pattern_spans(tokens: DataFrame, patterns: dict[str, str] | None = None, doc: str = "doc") -> DataFrame:
    """(doc, sent, label, start, n): the longest matches, from left to right, of each pattern in a sentence.

    A sentence's parts of speech are one string of letters; matches are read off it with their places.
    """
    pairs = [x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))]
    code = F.coalesce(F.create_map(*pairs)[F.col("pos")], F.lit("z"))
    seq = tokens.groupBy(doc, "sent").agg(F.array_sort(F.collect_list(F.struct("pos_no", code.alias("c")))).alias("w"))  # one sentence
    seq = seq.select(doc, "sent", F.array_join(F.transform("w", lambda x: x["c"]), "").alias("s"), F.col("w")[0]["pos_no"].alias("base"))
    out = None
    for label, pattern in (patterns or PATTERNS).items():
        cut = F.split(F.regexp_replace("s", f"({pattern})", "<$1>"), "[<>]")  # odd pieces are matches
        before = F.transform(cut, lambda p, i: F.aggregate(F.slice(cut, 1, i), F.lit(0), lambda a, x: a + F.length(x)))
        spans = F.transform(F.arrays_zip(cut.alias("p"), before.alias("b")), lambda x, i: F.struct(i.alias("i"), x["b"].alias("at"), F.length(x["p"]).alias("n")))
        found = seq.select(doc, "sent", "base", F.explode(F.filter(spans, lambda x: (x["i"] % 2 == 1) & (x["n"] > 0))).alias("m")).select(doc, "sent", F.lit(label).alias("label"), (F.col("base") + F.col("m.at")).alias("start"), F.col("m.n").alias("n"))
        out = found if out is None else out.unionByName(found)
    return out


def regex_entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, label, text, n): addresses of web and mail, and cited persons ('Name et al')."""
    kinds = {"url": T.URL, "email": T.EMAIL, "cite_person": r"\p{Lu}[\p{L}'-]+ et al\b"}
    each = F.concat(*[F.transform(F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(0)), _labelled(k)) for k, p in kinds.items()])
    return df.select(F.col(id_col).alias("doc"), F.explode(each).alias("e")).select("doc", "e.*").groupBy("doc", "label", "text").agg(F.count(F.lit(1)).alias("n"))


def _labelled(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("label"), x.alias("text"))


def valid_entities(spans: DataFrame, tokens: DataFrame, rules: dict[str, tuple[set[str], set[str]]], doc: str = "doc") -> DataFrame:
    """Spans (doc, start, n, label) whose tokens' parts of speech are all possible for the label and one of the needed ones.

    rules: label -> (possible, at least one of); labels without a rule pass. A single function word is no entity.
    """
    tok = tokens.select(F.col(doc).alias("_d"), F.col("pos_no").alias("_p"), F.coalesce("pos", F.lit("X")).alias("_pos"))
    joined = spans.join(tok, (F.col(doc) == F.col("_d")) & (F.col("_p") >= F.col("start")) & (F.col("_p") < F.col("start") + F.col("n")))
    grouped = joined.groupBy(doc, "start", "n", "label").agg(F.collect_set("_pos").alias("_set"))
    ok = F.lit(True)
    for label, (possible, least) in rules.items():
        fits = (F.size(F.array_except("_set", F.array(*map(F.lit, sorted(possible))))) == 0) & F.arrays_overlap("_set", F.array(*map(F.lit, sorted(least))))
        ok = F.when(F.col("label") == label, fits).otherwise(ok)
    single = (F.col("n") == 1) & F.arrays_overlap("_set", F.array(*map(F.lit, CLOSED)))
    return grouped.where(ok & ~single).drop("_set")


def concept_triples(matches: DataFrame) -> DataFrame:
    """(doc_id, s, p, o): 'label rel:has-concept' of lexicon matches (doc_id, label), each once a document."""
    return matches.select("doc_id", F.col("label").alias("s"), F.lit("rel:has-concept").alias("p"), F.lit("concept").alias("o")).distinct()


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, embedding): hashed term weights of unit length, where no model gives vectors."""
    words = df.select(F.col(id_col).alias("id"), F.coalesce(T.analyze(F.col(text_col), T.STOP_WORDS), F.array().cast("array<string>")).alias("w"))
    counted = HashingTF(inputCol="w", outputCol="tf", numFeatures=dim).transform(words)
    weighted = IDF(inputCol="tf", outputCol="idf").fit(counted).transform(counted)
    return Normalizer(inputCol="idf", outputCol="v", p=2.0).transform(weighted).select("id", vector_to_array("v", "float32").alias("embedding"))


def stop_filter(tokens: DataFrame, drop: tuple[str, ...], weaker: tuple[str, ...], doc: str = "doc") -> DataFrame:
    """Tokens of wanted parts of speech; a document none of whose tokens is left is filtered by the weaker list."""
    keep, soft = (~F.coalesce(F.col("pos").isin(*x), F.lit(False)) for x in (drop, weaker))
    flagged = tokens.withColumn("_k", keep).withColumn("_any", F.max(F.col("_k").cast("int")).over(Window.partitionBy(doc)))
    return flagged.where(F.col("_k") | ((F.col("_any") == 0) & soft)).drop("_k", "_any")
