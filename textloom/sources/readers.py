"""Sources: document folders, envelopes, mails, web pages, patent and column files, lexicons, corpora.

Defined results: files that can't be parsed give a row with error = true; null input gives an error row;
empty folders give empty tables.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from .. import schemas
from ..functions import text as T

_EMPTY_TRIPLE = "array<struct<s:string,p:string,o:string>>"


def json_documents(spark: SparkSession, folder: str, exclude: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """Documents of all JSON files below a folder (gzip too), files named in ``exclude`` (file) left out."""
    read = spark.read.schema(schemas.DOCUMENT).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*")
    docs = read.json(folder).withColumn("file", F.col("_metadata.file_path"))
    return docs if exclude is None else docs.join(exclude.select("file").distinct(), "file", "left_anti")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        self.skip += tag in ("script", "style", "nav", "header", "footer")

    def handle_endtag(self, tag):  # noqa: ANN001
        self.skip -= tag in ("script", "style", "nav", "header", "footer") and self.skip > 0

    def handle_data(self, data):  # noqa: ANN001
        if not self.skip:
            self.parts.append(data)


def html_text(html: str) -> str:
    parser = _Text()
    parser.feed(unescape(html))
    return " ".join(" ".join(parser.parts).split())


_MAIL = types.StructType([*[types.StructField(n, types.StringType()) for n in ("title", "body", "sender", "recipients", "cc", "bcc", "sent")], types.StructField("error", types.BooleanType())])


@F.pandas_udf(_MAIL)
def parse_mail(raw: pd.Series) -> pd.DataFrame:
    """Header fields and plain body of RFC 822 messages; HTML bodies without tags."""

    def one(text: str | None) -> tuple:
        if not text:
            return ("", "", "", "", "", "", "", True)
        try:
            m = email.message_from_string(text, policy=email.policy.default)
            part = m.get_body(preferencelist=("plain", "html"))
            body = part.get_content() if part is not None else ""
            if part is not None and part.get_content_type() == "text/html":
                body = html_text(body)
            return (str(m["subject"] or ""), body, str(m["from"] or ""), str(m["to"] or ""), str(m["cc"] or ""), str(m["bcc"] or ""), str(m["date"] or ""), False)
        except (ValueError, KeyError, LookupError, AttributeError):
            return ("", "", "", "", "", "", "", True)

    return pd.DataFrame([one(t) for t in raw], columns=["title", "body", "sender", "recipients", "cc", "bcc", "sent", "error"])


def _pair(subject: Column, relation: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(subject.alias("s"), F.lit(relation).alias("p"), x.alias("o"))


def _as_subject(relation: str, kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x.alias("s"), F.lit(relation).alias("p"), F.lit(kind).alias("o"))


def header_triples(sender: str = "m.sender", recipients: str = "m.recipients", cc: str = "m.cc", bcc: str = "m.bcc", sent: str = "m.sent") -> Column:
    """Distinct triples of a parsed mail's header: persons, addresses, the date, and who was written to."""
    # names stand without the quotation marks that headers may put around them
    from_name = F.trim(F.regexp_replace(F.col(sender), r'<[^>]*>|"', ""))
    names = lambda c: F.filter(F.transform(F.split(F.col(c), ","), lambda x: F.trim(F.regexp_replace(x, r'<[^>]*>|"', ""))), lambda x: x != "")
    made = [
        F.transform(F.filter(F.array(from_name), lambda x: x != ""), lambda x: F.struct(x.alias("s"), F.lit("rel:instanceof").alias("p"), F.lit("person").alias("o"))),
        F.transform(F.regexp_extract_all(F.concat_ws(",", sender, recipients, cc, bcc), F.lit(T.EMAIL), F.lit(0)), lambda x: F.struct(x.alias("s"), F.lit("rel:instanceof").alias("p"), F.lit("email").alias("o"))),
        F.transform(F.filter(F.array(F.col(sent)), lambda x: x != ""), lambda x: F.struct(x.alias("s"), F.lit("rel:instanceof").alias("p"), F.lit("date").alias("o"))),
        *[F.transform(names(c), _pair(from_name, rel)) for c, rel in ((recipients, "rel:mailto"), (cc, "rel:mailcc"), (bcc, "rel:mailbcc"))],
    ]
    return F.array_distinct(F.concat(*made)).cast(_EMPTY_TRIPLE)


def mails(raw: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Converted mails: (source_doc_id, title, content, triples, error)."""
    parsed = raw.select(F.col(id_col).cast("string").alias("source_doc_id"), parse_mail(F.col(text_col)).alias("m"))
    return parsed.select("source_doc_id", F.col("m.title").alias("title"), F.array("m.body").alias("content"), header_triples().alias("triples"), F.col("m.error").alias("error"))


def pages(raw: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Converted web pages: furniture dropped, headings as keyword triples."""
    html = F.col(html_col)
    heads = F.transform(T.html_headings(html), lambda h: F.struct(h.alias("s"), F.lit("rel:is_a").alias("p"), F.lit("keyword").alias("o"))).cast(_EMPTY_TRIPLE)
    return raw.select(F.col(id_col).cast("string").alias("source_doc_id"), T.html_title(html).alias("title"), F.array(T.strip_tags(html)).alias("content"), F.coalesce(heads, F.array().cast(_EMPTY_TRIPLE)).alias("triples"), html.isNull().alias("error"))


#: Kinds of input that envelopes may hold.
MANAGED = ("document", "raw", "email", "html")


def envelopes(df: DataFrame, passthrough: str = "document") -> DataFrame:
    """Documents of envelopes (datatype, data base64, source), dispatched by type; unknown or empty ones are errors."""
    rows = df.select("datatype", "source", F.unbase64("data").cast("string").alias("raw"))
    known = rows.withColumn("bad", F.coalesce(~F.col("datatype").isin(*MANAGED), F.lit(True)) | F.col("raw").isNull() | (F.trim("raw") == ""))
    none = F.array().cast(_EMPTY_TRIPLE)
    good = known.where("not bad")
    as_is = good.where(F.col("datatype") == passthrough).select(F.from_json("raw", schemas.DOCUMENT).alias("d"), "source")
    as_is = as_is.select(F.coalesce("d.source_doc_id", "source").alias("source_doc_id"), F.coalesce("d.title", F.lit("")).alias("title"), F.coalesce("d.content", F.array().cast("array<string>")).alias("content"), none.alias("triples"), F.coalesce("d.error", F.lit(False)).alias("error"))
    plain = good.where("datatype = 'raw'").select(F.col("source").alias("source_doc_id"), F.lit("").alias("title"), F.array(T.strip_tags(F.col("raw"))).alias("content"), none.alias("triples"), F.lit(False).alias("error"))
    web = pages(good.where("datatype = 'html'"), "source", "raw")
    mail = mails(good.where("datatype = 'email'"), "source", "raw")
    failed = known.where("bad").select(F.col("source").alias("source_doc_id"), F.lit("").alias("title"), F.array().cast("array<string>").alias("content"), none.alias("triples"), F.lit(True).alias("error"))
    out = as_is
    for part in (plain, web, mail, failed):
        out = out.unionByName(part)
    return out


def columns_to_documents(df: DataFrame, id_col: str, title: list[str], content: list[str], kg: list[str], lon: str | None = None, lat: str | None = None) -> DataFrame:
    """Documents of a column file: titles and contents joined, the other columns as 'value rel:is_a column' triples."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    triples = F.filter(F.array(*[F.struct(text(c).alias("s"), F.lit("rel:is_a").alias("p"), F.lit(c).alias("o")) for c in kg]), lambda t: t["s"] != "")
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), ",", ".").try_cast("double")
    position = F.struct(number(lon).alias("lon"), number(lat).alias("lat")) if lon and lat else F.lit(None).cast("struct<lon:double,lat:double>")
    return df.select(F.col(id_col).cast("string").alias("source_doc_id"), F.concat_ws(" ", *map(text, title)).alias("title"), F.array(F.concat_ws(" ", *map(text, content))).alias("content"), triples.alias("triples"), position.alias("position"))


#: How a column of a patent export is read: how many '|'-parts are cut off first, whether parentheses are removed, the relation's object.
PATENT_RULES = {"keywords": (0, False, "keyword"), "inventors": (0, True, "author"), "assignees": (1, False, "organization"), "cpc": (2, False, "cpc"), "ipc": (2, False, "ipc")}


def patents(df: DataFrame, id_col: str, title: str, abstract: str, description: str, rules: dict[str, tuple[int, bool, str]] | None = None) -> DataFrame:
    """Documents of patent rows; short descriptions (under 256 characters) are marked as not converted."""
    parts = []
    for c, (cut, no_brackets, kind) in (rules or PATENT_RULES).items():
        if c in df.columns:
            text = F.coalesce(c, F.lit(""))
            items = F.transform(F.split(F.regexp_replace(text, r"\([^)]*\)", "") if no_brackets else text, r"\|"), lambda x: F.lower(F.trim(x)))
            items = F.filter(F.slice(items, cut + 1, 1_000_000), lambda x: x != "")
            parts.append(F.transform(items, _as_subject("rel:is_a", kind)))
    triples = F.array_distinct(F.concat(*parts)) if parts else F.array()
    return df.select(F.col(id_col).cast("string").alias("source_doc_id"), F.split_part(F.coalesce(title, F.lit("")), F.lit("|"), F.lit(1)).alias("title"), F.filter(F.array(abstract, description), lambda x: x.isNotNull()).alias("content"), triples.cast(_EMPTY_TRIPLE).alias("triples"), (F.coalesce(F.length(description), F.lit(0)) >= 256).alias("converted"))


def list_lexicon(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(word, label): one entry a line."""
    return spark.read.text(path).select(F.trim("value").alias("word"), F.lit(label).alias("label")).where("word <> ''")


def table_lexicon(spark: SparkSession, path: str, columns: list[int], label: str, sep: str = ",", header: bool = True, split_on: str | None = None) -> DataFrame:
    """(word, label, parent): entries of a column file; a second column names what the entry is an instance of."""
    df = spark.read.csv(path, sep=sep, header=header)
    word = F.col(df.columns[columns[0]])
    words = F.explode(F.split(word, split_on)) if split_on else word
    parent = F.col(df.columns[columns[1]]) if len(columns) > 1 else F.lit(None).cast("string")
    return df.select(words.alias("word"), F.lit(label).alias("label"), F.trim(parent).alias("parent")).select(F.trim("word").alias("word"), "label", "parent").where("word <> ''")


def conll_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent_id, text, id, form, lemma, upos, head, deprel): tokens of CoNLL-U files."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    rows = blocks.select("file", F.regexp_extract("value", r"# sent_id = (.*)", 1).alias("sent_id"), F.regexp_extract("value", r"# text = (.*)", 1).alias("text"), F.explode(F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^[0-9]+\t"))).alias("line"))
    c = F.split("line", "\t")
    return rows.select("file", "sent_id", "text", c[0].cast("int").alias("id"), c[1].alias("form"), c[2].alias("lemma"), c[3].alias("upos"), c[6].cast("int").alias("head"), c[7].alias("deprel"))


def line_items(df: DataFrame, text_col: str) -> DataFrame:
    """(line_no, line): the lines of a text column."""
    return df.select(F.posexplode(F.split(text_col, r"\r?\n")).alias("line_no", "line")).where("trim(line) <> ''")



def binary_documents(spark: SparkSession, folder: str, extract: Callable[[bytes, str], str], pattern: str = "*") -> DataFrame:
    """Documents of office and PDF files below a folder, by an extractor (content, mime type) -> text that the caller brings."""
    kinds = {".pdf": "application/pdf", ".rtf": "application/rtf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".odt": "application/vnd.oasis.opendocument.text", ".ppt": "application/vnd.ms-powerpoint", ".html": "text/html"}
    mime = F.lit("application/octet-stream")
    for suffix, kind in kinds.items():
        mime = F.when(F.lower("path").endswith(suffix), kind).otherwise(mime)

    @F.pandas_udf(types.StringType())
    def text(content: pd.Series, kind: pd.Series) -> pd.Series:
        out = []
        for c, k in zip(content, kind, strict=True):
            try:
                out.append(extract(c, k))
            except Exception:  # noqa: BLE001 - an extractor's failure is a document with error = true
                out.append(None)
        return pd.Series(out, dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    done = files.select(F.col("path").alias("source_doc_id"), text(F.col("content"), mime).alias("t"))
    return done.select("source_doc_id", F.lit("").alias("title"), F.when(F.col("t").isNotNull(), F.array("t")).otherwise(F.array().cast("array<string>")).alias("content"), F.col("t").isNull().alias("error"))


def tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, pos_no, token, pos, ner): sentences a line, tokens 'token|pos|ner' between blanks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("sent"), F.posexplode(F.split("value", " ")).alias("pos_no", "t")).where("t <> ''")
    c = F.split("t", r"\|")
    return rows.select("file", "sent", "pos_no", F.get(c, F.lit(0)).alias("token"), F.get(c, F.lit(1)).alias("pos"), F.get(c, F.lit(2)).alias("ner"))
