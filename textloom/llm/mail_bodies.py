"""New text of e-mails: SQL windows over exploded lines.

Every body is exploded into lines.  Windows over a mail's lines find what is quoted (prefixed lines,
introductions, everything below a forwarding or reply header), paragraphs that open like a
disclaimer, and signatures (closing formulas, the sender's name or initials and the contact lines below).
What the forms leave live is judged by windows over the whole collection, which know no words:

* a line counts for the participant who wrote it first in its thread, by date (those who write to each other, where the
  header names anybody), unless it occurs in ``COMMON`` threads and so is nobody's;
* lines that end a good part of a sender's mails are the sender's signature, and so are name and initials of the header;
* lines that mostly stand right above their senders' signatures are closings, and lines that mostly stand below them
  are notices, if enough senders have them.

The lists of closings, disclaimers and devices only serve what no window can know, such as the only mail of a sender.  All
windows run over rows aggregated by (thread, line, sender), (sender, line) or line before, so mails delivered many times weigh no
more than one.

Defined results: null and blank contents give no line; line_no counts all lines from 0; mails sent twice
are judged each; mails of one date are ranked by their identifier; without sender or title only the rules
that need neither apply; empty tables give no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: Threads that have a line, for it to be nobody's.
COMMON = 5
#: Mails that a sender ends with a line, and their part of all the sender's mails, for it to be a signature.
RECURRENT, RECURRENT_PART = 3, 0.1
#: Part of a line's places that must be at the end of mails, for it to be a signature or notice.
ENDING = 0.8
#: Senders of a line that is a closing or notice, and part of its places right above their signatures.
SENDERS, ABOVE = 5, 0.5

QUOTED = r"^(\t| *>| *\|( |$)| *:( |$|>))"
TABLE_ROW = r"^ *\|\s*[^|\s][^|]*(\|[^|]*){2}\|"
INTRODUCTION = r"(?i)^(on|am|le|el|il) .*\d.*(wrote|schrieb|a écrit|escribió|ha scritto)\b.*:$|^.*<[^ >]+@[^ >]+> (writes|wrote):$"
INTRODUCTION_HEAD = r"(?i)^(on|am|le) .*\d.*<[^ >]+@[^ >]+>$"
INTRODUCTION_TAIL = r"(?i)^(wrote|writes|schrieb|a écrit)\s*:$"
REST = (
    r"(?i)^-{2,} ?(original message|message d'origine|ursprüngliche nachricht|forwarded message|weitergeleitete nachricht|message transféré) ?-{2,}$"
    r"|^begin forwarded message:$|^-{5,} ?forwarded by |^\S+@\S+ \d{4}-\d\d-\d\d \d\d:\d\d >>>$"
)
HEADER = r"(?i)^\*?(from|von|de)\*? ?:"
HEADER_NEXT = r"(?i)^\*?(sent|date|to|cc|subject|gesendet|datum|an|betreff|envoyé|objet|à)\*? ?:"
DATE_LINE = r"^\d\d/\d\d/\d{4} \d\d:\d\d(:\d\d)? [AP]M$"
NAME_DATE = r"^\S.* on \d\d/\d\d/\d{4} \d\d:\d\d(:\d\d)? [AP]M$"
SEPARATOR = r"^[-=_*~#]{2,}$"
_NAME = r"\p{Lu}[\p{L}.'-]*( \p{Lu}[\p{L}.'-]*){0,2}"
CLOSING = (
    r"^((?i)best regards|kind regards|warm regards|regards|best wishes|best|cheers|thanks|thank you|many thanks|thx|cordialement|bien cordialement|bien à vous"
    r"|mit freundlichen grüßen|mit besten grüßen|viele grüße|beste grüße|sincerely|yours sincerely|yours faithfully|yours)(?-i)[,.!]?( " + _NAME + r")?$"
)
NAME_LIKE = r"^\p{Lu}\p{Ll}+( \p{Lu}\.?)?( \p{Lu}[\p{L}'-]+)$"
CONTACT = r"(?i)^(m|t|tel|phone|mobile|fax|mob)[.:]|^(www\.|https?://)\S+$|^[+(]?\d[\d ()+./-]{5,}( \| .*)?$"
CARD = r"^[^|]{2,60} \| [^|]{2,60} \| [^|]{2,60}$"
DEVICE = r"(?i)^(sent from (my|a) |envoyé (de|depuis) mon |von unterwegs gesendet|von meinem .* gesendet|gesendet von (meinem|mein) |get outlook )"
_MAIL_WORD = r"(mail|e-mail|email|message|note|transmission|communication)"
DISCLAIMER = (
    r"(?i)^((confidentiality notice|disclaimer|legal notice|important|notice|note) ?[:.-] ?)?"
    rf"(views expressed in this {_MAIL_WORD}|if you are not the intended recipient|the information in this {_MAIL_WORD}|please think of the \S+ before printing"
    rf"|this {_MAIL_WORD} and any |[^.]{{2,60}} accepts no liability)"
)
GATEWAY = r"(?i)^\[external\]|^\*{3} .* \*{3}$|^(caution|warning|attention) ?[:!-] ?.*\b(sender|links|attachments|external|outside)\b|^this (message|mail|e-mail|email) (comes|came|originated) from outside\b"
LIST_NOTICE = r"(?i)^(to (leave|unsubscribe from) (the|this) list\b|.{2,80} (announcements|discussion|mailing) list$)"


def _first_of(kg: Column, value: str) -> Column:
    """Subject of the first header triple that says 'is a ``value``'."""
    triple = F.filter(kg, lambda t: (F.array_join(t["property"]["content"], " ") == "rel:instanceof") & (F.array_join(t["value"]["content"], " ") == value))
    return F.array_join(F.get(triple, F.lit(0))["subject"]["content"], " ")


def _all_of(kg: Column, link: str) -> Column:
    """Values of the header triples of that property."""
    triple = F.filter(kg, lambda t: F.array_join(t["property"]["content"], " ") == link)
    return F.coalesce(F.transform(triple, lambda t: F.array_join(t["value"]["content"], " ")), F.array().cast("array<string>"))


def _lines(mails: DataFrame, id_col: str) -> DataFrame:
    sent = F.try_to_timestamp(F.regexp_extract(F.coalesce(_first_of(F.col("kg"), "date"), F.lit("")), r"(\d{1,2} \w{3} \d{4} \d\d:\d\d:\d\d)", 1), F.lit("d MMM yyyy HH:mm:ss"))
    thread = F.nullif(F.trim(F.lower(F.regexp_replace("title", r"(?i)^\s*((re|aw|fw|fwd|wg|tr)\s*:\s*)+", ""))), F.lit(""))
    base = mails.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("mail"), F.coalesce("source_doc_id", F.lit("")).alias("source"), thread.alias("thread"), F.nullif(_first_of(F.col("kg"), "person"), F.lit("")).alias("sender"),
        F.coalesce(sent, F.col("ingested_at").cast("timestamp")).alias("sent"), F.concat_ws("\n", "content").alias("body"), _all_of(F.col("kg"), "rel:mailto").alias("recipients"),
    )
    return base.select("mail", "source", "thread", "sender", "sent", "recipients", F.posexplode(F.split("body", "\n")).alias("line_no", "raw")).withColumn("raw", F.regexp_replace("raw", r"\s+$", "")).withColumn("t", F.trim("raw"))


def mark_lines(mails: DataFrame, id_col: str = "mail_id") -> DataFrame:
    """Every line with its kind: blank, quoted, header, closing, signature, notice or new."""
    at = Window.partitionBy("mail").orderBy("line_no")
    back = Window.partitionBy("mail").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    para = Window.partitionBy("mail", "para")
    whole = Window.partitionBy("mail")
    t = F.col("t")
    rows = _lines(mails, id_col)
    rows = rows.withColumn("blank", t == "").withColumn("marked", ~F.col("blank") & F.col("raw").rlike(QUOTED) & ~F.col("raw").rlike(TABLE_ROW))
    # "more than" a number, alone among lines without prefix, is no quotation
    alone = F.col("raw").rlike(r"^>\d") & ~F.coalesce(F.lag("marked").over(at), F.lit(False)) & ~F.coalesce(F.lead("marked").over(at), F.lit(False)) & ~F.coalesce(F.lag("t").over(at), F.lit("")).rlike(r":$")
    rows = rows.withColumn("_alone", alone).withColumn("marked", F.col("marked") & ~F.col("_alone"))
    first, last = F.element_at(F.split("sender", " "), 1), F.element_at(F.split("sender", " "), -1)
    initials = F.array_join(F.transform(F.split("sender", " "), lambda w: F.substring(w, 1, 1)), "")
    named = F.coalesce((t == F.col("sender")) | (t == first) | (t == last) | (t == initials), F.lit(False))
    # the end of a quoted line that was wrapped again stands without prefix between prefixed lines
    above = F.coalesce(F.lag(F.when(F.col("marked"), F.regexp_replace("raw", r"^[\s>|:]+", ""))).over(at), F.lit(""))
    broken = ~F.col("blank") & ~F.col("marked") & (above != "") & (~above.rlike(r"[.?!:]$") | F.coalesce(F.lead("marked").over(at), F.lit(False))) & ~t.rlike(CLOSING) & ~named & ~t.rlike(DEVICE) & ~t.rlike(SEPARATOR)
    rows = rows.withColumn("quoted", F.col("marked") | broken)
    after, after2, before = (F.coalesce(x, F.lit("")) for x in (F.lead("t", 1).over(at), F.lead("t", 2).over(at), F.lag("t", 1).over(at)))
    rows = rows.withColumns({"after": after, "after2": after2, "before": before, "next_quoted": F.coalesce(F.last(F.when(~F.col("blank"), F.col("quoted")), ignorenulls=True).over(back), F.lit(False))})
    open_ = ~F.col("blank") & ~F.col("quoted")
    intro_tail = t.rlike(INTRODUCTION_TAIL) & F.col("before").rlike(INTRODUCTION_HEAD)
    intro = open_ & (t.rlike(INTRODUCTION) | intro_tail | (t.rlike(INTRODUCTION_HEAD) & F.col("after").rlike(INTRODUCTION_TAIL)))
    header = t.rlike(REST) | (t.rlike(HEADER) & F.col("after").rlike(HEADER_NEXT)) | (F.col("after").rlike(DATE_LINE) & F.col("after2").rlike(HEADER_NEXT)) | (t.rlike(NAME_DATE) & F.col("after").rlike(HEADER_NEXT))
    # an introduction without prefixed lines below it opens an unmarked quotation that fills the rest
    bare = intro & ~F.col("next_quoted") & ~(t.rlike(INTRODUCTION_HEAD) & F.col("after").rlike(INTRODUCTION_TAIL))
    rows = rows.withColumn("intro", intro).withColumn("rest", F.min(F.when(open_ & (header | bare), F.col("line_no"))).over(whole))
    rows = rows.withColumn("old", F.coalesce(F.col("line_no") >= F.col("rest"), F.lit(False)))
    cut = F.col("blank") | F.col("quoted") | F.col("intro") | t.rlike(SEPARATOR)
    rows = rows.withColumn("para", F.sum(cut.cast("int")).over(at))
    unknown = F.col("sender").isNull() & ((t.rlike(NAME_LIKE) & (F.col("before").rlike(CLOSING) | F.col("before").rlike(r"^--$") | F.col("after2").rlike(CONTACT) | F.lead("t", 3).over(at).rlike(CONTACT) | F.lag("t", 2).over(at).rlike(CLOSING))) | (t.rlike(r"^\p{Lu}\p{Ll}+$") & (F.col("before").rlike(CLOSING) | ((F.col("before") == "") & F.lag("t", 2).over(at).rlike(CLOSING)))) | (t.rlike(r"^\p{Lu}{2,3}$") & F.col("before").rlike(r"^$|[.?!]$")))
    live = open_ & ~F.col("old") & ~F.col("intro")
    sign = live & (named | unknown | t.rlike(CARD))
    # narrow lines break the opening words apart: a line is read with those below it in its paragraph
    in_para = Window.partitionBy("mail", "para").orderBy("line_no")
    opening = F.concat_ws(" ", t, *[F.lead("t", k).over(in_para) for k in range(1, 7)])
    rows = rows.withColumns({"live": live, "closing": live & t.rlike(CLOSING), "sign": sign, "notice": live & (t.rlike(DEVICE) | t.rlike(LIST_NOTICE) | t.rlike(GATEWAY)), "disclaimer": live & opening.rlike(DISCLAIMER)})
    # "--" closes nothing by itself, but opens a signature in its paragraph
    rows = rows.withColumn("opens", F.min(F.when(F.col("sign"), F.col("line_no"))).over(para)).withColumn("warns", F.min(F.when(F.col("disclaimer"), F.col("line_no"))).over(para))
    contact = t.rlike(CONTACT) | ((F.length(t) < 60) & ~t.rlike(r"[.?!;]$"))
    below = F.coalesce(F.col("line_no") > F.col("opens"), F.lit(False)) & contact
    kind = (
        F.when(F.col("blank"), "blank").when(F.col("quoted") | F.col("old"), "quoted").when(F.col("intro"), "header").when(t.rlike(SEPARATOR), "separator")
        .when(F.col("notice") | F.coalesce(F.col("line_no") >= F.col("warns"), F.lit(False)), "notice").when(F.col("closing"), "closing").when(F.col("sign") | below | t.rlike(CONTACT), "signature").otherwise("new")
    )
    return rows.select("mail", "source", "thread", "sender", "sent", "recipients", "line_no", t.alias("text"), kind.alias("kind"), named.alias("named"))


def judged_lines(mails: DataFrame, id_col: str = "mail_id") -> DataFrame:
    """(mail, line_no, text, kind, window): live lines, kind by form and list, window the rule over the collection that refuses it or null."""
    key = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    live = mark_lines(mails, id_col).where(F.col("kind").isin("new", "closing", "signature", "notice")).withColumn("key", key)
    of_mail = Window.partitionBy("mail").orderBy("line_no")
    up = Window.partitionBy("mail").orderBy(F.desc("line_no"))
    live = live.withColumn("from_end", F.row_number().over(up)).withColumn("ends", F.col("from_end") < F.row_number().over(of_mail))
    # written once: the rules read it, and the windows before are the costly part
    rows = materialize(live.drop("from_end"), "live-lines")
    keyed = rows.where("key <> ''")

    # first-authored: the participant who wrote the line first in its thread
    written = keyed.where("thread is not null and sender is not null").groupBy("thread", "key", "sender").agg(F.min(F.struct("sent", "mail")).alias("m"), F.array_distinct(F.flatten(F.collect_set("recipients"))).alias("to"))
    shared = written.groupBy("key").agg(F.countDistinct("thread").alias("threads"), F.count(F.lit(1)).alias("n")).where((F.col("threads") < COMMON) & (F.col("n") > 1)).select("key")
    first = Window.partitionBy("thread", "key").orderBy("m", "sender")
    author, to = F.first("sender").over(first), F.first("to").over(first)
    later = written.join(shared, "key").withColumn("author", author).withColumn("author_to", to)
    later = later.where((F.col("author") != F.col("sender")) & (F.array_contains("to", F.col("author")) | F.array_contains("author_to", F.col("sender")) | ((F.size("to") == 0) & (F.size("author_to") == 0)))).select("thread", "key", "sender", F.lit(True).alias("_later"))

    # recurrent: what ends a good part of the sender's mails
    mails_of = rows.where("sender is not null").groupBy("sender").agg(F.countDistinct("source").alias("mails"))
    once = keyed.where("sender is not null").groupBy("sender", "key", "source").agg(F.max(F.col("ends").cast("int")).alias("ends"))
    often = once.groupBy("sender", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("ends").alias("ending")).join(mails_of, "sender")
    often = often.where((F.col("ending") >= RECURRENT) & (F.col("ending") >= RECURRENT_PART * F.col("mails")) & (F.col("ending") >= ENDING * F.col("n"))).select("sender", "key", F.lit(True).alias("_recurrent"))
    rows = materialize(rows.join(later, ["thread", "key", "sender"], "left").join(often, ["sender", "key"], "left"), "judged-lines")

    # closings and notices by their places around the signatures
    signed = F.coalesce((F.col("_recurrent") & F.col("ends")) | F.col("named"), F.lit(False))
    placed = rows.withColumn("signed", signed).withColumn("above", ~F.col("signed") & F.coalesce(F.lead("signed").over(of_mail), F.lit(False)))
    placed = placed.withColumn("below", ~F.col("signed") & F.coalesce(F.max("signed").over(of_mail.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).withColumn("has", F.max("signed").over(Window.partitionBy("mail")))
    told = placed.where("key <> '' and sender is not null and not signed").groupBy("key", "sender").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in ("above", "below", "has")])
    told = told.groupBy("key").agg(F.count(F.lit(1)).alias("senders"), *[F.sum(c).alias(c) for c in ("above", "below", "has")]).where(F.col("senders") >= SENDERS)
    closing = (F.col("above") >= ABOVE * F.col("senders")) & (F.col("above") >= RECURRENT)
    below = (F.col("below") >= ENDING * F.col("has")) & (F.col("below") >= RECURRENT)
    told = told.where(closing | below).select("key", F.when(closing, "closing").otherwise("notice").alias("_told"))
    out = placed.join(told, "key", "left")
    at_place = (F.col("_told") == "notice") | F.col("above") | F.col("ends")
    window = F.when(F.col("_later"), "first author").when(F.col("signed"), "signature").when(F.coalesce(at_place, F.lit(False)), F.col("_told"))
    return out.select("mail", "line_no", "text", "kind", window.alias("window"))


def new_lines(mails: DataFrame, id_col: str = "mail_id", lists: bool = True) -> DataFrame:
    """(mail, line_no, text) of the lines newly written by the sender; without ``lists`` by forms of quotation and the windows alone."""
    rows = judged_lines(mails, id_col).where("window is null")
    return (rows.where("kind = 'new'") if lists else rows).select("mail", "line_no", "text")


def new_bodies(mails: DataFrame, id_col: str = "mail_id") -> DataFrame:
    """(mail, body): each mail reduced to its new text, line order kept."""
    lines = new_lines(mails, id_col).groupBy("mail").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    return mails.select(F.col(id_col).alias("mail")).where("mail is not null").join(lines.select("mail", body.alias("body")), "mail", "left").select("mail", F.coalesce("body", F.lit("")).alias("body"))
