"""Column functions over text; all built-in expressions but the stemmer.

Defined results: null in, null out, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
URL = r"https?://[^\s<>\"]+|www\.[a-zA-Z0-9.-]+"
#: English function words left out by the stopping analyzers (fixed values).
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def words(text: Column) -> Column:
    """Words in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def analyze(text: Column, stop: list[str] | None = None, fold: bool = False) -> Column:
    """Analyzer chain: words, stop words removed, accents folded."""
    w = words(ascii_fold(text) if fold else text)
    return w if stop is None else F.filter(w, lambda x: ~x.isin(*stop))


def ascii_fold(text: Column) -> Column:
    """Accented Latin letters without their accents, one for one."""
    return F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Split behind a full stop, question or exclamation mark and white space."""
    marked = F.regexp_replace(collapse(text), r"([.!?]) ", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def space_punctuation(text: Column) -> Column:
    """Marks of a question set apart as tokens."""
    return collapse(F.regexp_replace(text, r"([.;,!?()])", " $1 "))


def clean_mail_text(text: Column) -> Column:
    """Quote marks, tabs and line breaks of a mail to blanks."""
    return collapse(F.regexp_replace(text, r"[>|\t\r\n]+", " "))


def is_numeric(text: Column) -> Column:
    return text.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")


def is_email(text: Column) -> Column:
    return F.lower(text).rlike(r"^[a-z0-9]+[._]?[a-z0-9]+@\w+[.]\w{2,3}$")


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "1", "t", "y", "yes", "on"), F.lit(False))


def coerce(text: Column) -> Column:
    """(long, double, boolean) that a configuration string stands for, each null if it doesn't."""
    return F.struct(text.try_cast("bigint").alias("long"), text.try_cast("double").alias("double"), F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true").alias("bool"))


def reapply_case(original: Column, replacement: Column) -> Column:
    """``replacement`` in the case pattern of ``original``: all capitals, initial capital, or as it is."""
    initial = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 10_000))
    return F.when((original == F.upper(original)) & (F.length(original) > 1), F.upper(replacement)).when(F.substring(original, 1, 1) == F.upper(F.substring(original, 1, 1)), initial).otherwise(replacement)


def token_class(token: Column) -> Column:
    """A guess from the form: marks PUNCT, addresses of the web NOUN, of mail ADJ, numbers NUM."""
    return F.when(token.rlike(r"^[^\p{L}\p{N}\s]+$"), "PUNCT").when(token.rlike(f"^({URL})$"), "NOUN").when(token.rlike(f"^({EMAIL})$"), "ADJ").when(token.rlike(r"^[0-9]+([.,][0-9]+)*$"), "NUM")


def strip_tags(html: Column) -> Column:
    blocks = F.regexp_replace(html, r"(?is)<(nav|header|footer|script|style)\b.*?</\1>", " ")
    return collapse(F.regexp_replace(blocks, r"<[^>]+>", " "))


def html_title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-5][^>]*>(.*?)</h[1-5]>"), F.lit(1)), strip_tags)


def content_id(*parts: Column) -> Column:
    """Identity of a document by its content."""
    return F.concat(F.lit("doc-"), F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def unescape_unicode(text: Column) -> Column:
    """``\\uXXXX`` sequences as characters."""
    piece = F.split(text, r"\\u(?=[0-9a-fA-F]{4})")
    rest = F.transform(F.slice(piece, 2, 10_000_000), lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 4)), "UTF-16BE"), F.substring(p, 5, 1_000_000_000)))
    return F.concat(F.get(piece, F.lit(0)), F.array_join(rest, ""))


def file_language(path: Column) -> Column:
    """Language named by a corpus file: before the first underscore, or the third part between hyphens."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("_"), F.split_part(name, F.lit("_"), F.lit(1))).otherwise(F.nullif(F.split_part(name, F.lit("-"), F.lit(3)), F.lit("")))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of vectors where the mask is set; the mask's sum counts as 1e-9 at least."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] > 0)
    total = F.aggregate(F.slice(kept, 2, 1_000_000), F.get(kept, F.lit(0))["v"].cast("array<double>"), lambda acc, x: F.zip_with(acc, x["v"].cast("array<double>"), lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def _stem(word: str) -> str:
    """English suffixes stripped in steps: plurals, -ed and -ing, then derivational endings."""
    if len(word) <= 2 or not word.isascii():
        return word
    for suffix, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + by
            break
    vowel = lambda s: any(c in "aeiouy" for c in s)
    for suffix in ("ing", "ed"):
        root = word[: -len(suffix)]
        if word.endswith(suffix) and vowel(root) and len(root) > 2:
            word = root
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 2 and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            break
    if word.endswith("y") and vowel(word[:-1]):
        word = word[:-1] + "i"
    for suffix, by in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("iveness", "ive"), ("ousness", "ous"), ("tional", "tion"), ("ement", ""), ("ment", ""), ("ness", ""), ("able", ""), ("ible", ""), ("ance", ""), ("ence", ""), ("ation", "ate"), ("ful", ""), ("ive", ""), ("ize", "")):
        root = word[: -len(suffix)]
        if word.endswith(suffix) and len(root) > 3 and vowel(root):
            return root + by
    return word


def stemmer() -> Callable[[Column], Column]:
    """Vectorised stemming of an array of words."""
    @F.pandas_udf("array<string>")
    def stem(tokens: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return tokens.map(lambda ws: None if ws is None else [known.setdefault(w, _stem(w)) for w in ws])

    return stem
