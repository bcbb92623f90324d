"""Knowledge-graph triples as rows: building, matching, grouping and class statistics.

Defined results: null or empty graphs have no triple; a null role counts as the empty text; triples are
one if their three texts are equal, whatever their positions; unknown classes are -1.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ROLES = ("subject", "property", "value")
_TRIPLE = "array<struct<s:string,p:string,o:string>>"


def triples(df: DataFrame, id_col: str, kg: str = "kg", lemma: bool = False, placed: bool = False) -> DataFrame:
    """(doc, no, s, p, o, cs, cp, co): a row for each triple with the classes of its roles.

    ``placed``: without triples that have the positions [-1], which stand for none, in any role.
    """
    rows = df.select(F.col(id_col).alias("doc"), F.posexplode(kg).alias("no", "t"))
    if placed:
        for r in ROLES:
            rows = rows.where(~F.coalesce(F.col(f"t.{r}.positions") == F.array(F.lit(-1)), F.lit(False)))
    field = "lemma_content" if lemma else "content"
    text = [F.coalesce(F.array_join(f"t.{r}.{field}", " "), F.lit("")).alias(x) for r, x in zip(ROLES, "spo", strict=True)]
    classes = [F.coalesce(F.col(f"t.{r}.class"), F.lit(-1)).alias(f"c{x}") for r, x in zip(ROLES, "spo", strict=True)]
    return rows.select("doc", "no", *text, *classes, F.coalesce("t.field_type", F.lit("")).alias("field_type"), F.col("t.confidence").alias("confidence"))


def distinct_triples(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "s", "p", "o").dropDuplicates()


def header_triples(mail: DataFrame, id_col: str, sender: str, recipients: str) -> DataFrame:
    """(doc, s, p, o) of header fields: names are persons, addresses e-mails, mails are sent to."""
    names = F.regexp_extract_all(F.col(sender), F.lit(r"([^<,]+)(?:<[^>]*>)?"), F.lit(1))
    made = F.concat(
        F.transform(names, lambda n: F.struct(F.trim(n).alias("s"), F.lit("rel:instanceof").alias("p"), F.lit("person").alias("o"))),
        F.transform(F.regexp_extract_all(F.concat_ws(",", sender, recipients), F.lit(f"({T.EMAIL})"), F.lit(1)), lambda m: F.struct(m.alias("s"), F.lit("rel:instanceof").alias("p"), F.lit("email").alias("o"))),
        F.transform(F.regexp_extract_all(F.col(recipients), F.lit(r"([^<,]+)(?:<[^>]*>)?"), F.lit(1)), lambda n: F.struct(F.trim(sender).alias("s"), F.lit("rel:mailto").alias("p"), F.trim(n).alias("o"))),
    )
    return mail.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(made)).alias("t")).select("doc", "t.*").where("s <> '' and o <> ''")


def tag_triples(tags: Column) -> Column:
    """A triple 'tag is a tag' for each tag given with a document."""
    return F.transform(tags, lambda t: F.struct(t.alias("s"), F.lit("rel:is_a").alias("p"), F.lit("tag").alias("o"))).cast(_TRIPLE)


def shared_triples(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples of both sides."""
    return a.select("s", "p", "o").intersect(b.select("s", "p", "o"))


def joined_triples(graphs: list[DataFrame]) -> DataFrame:
    """Triples of any of the graphs, each once."""
    out = graphs[0].select("s", "p", "o")
    for g in graphs[1:]:
        out = out.unionByName(g.select("s", "p", "o"))
    return out.dropDuplicates()


def graph_overlap(rows: DataFrame, queries: DataFrame, block: int = 1000) -> DataFrame:
    """(query, doc, shared): documents by the number of triples they have in common with each of ``queries`` (doc).

    Every triple counts, however many documents have it; a common one's documents are divided among tasks in blocks.
    """
    own = distinct_triples(rows)
    key = own.select("doc", F.sha2(F.concat_ws("\u0001", "s", "p", "o"), 256).alias("k"))
    asked = key.join(queries.select("doc").distinct(), "doc", "left_semi").select("k", F.col("doc").alias("query"))
    parts = key.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    sides = asked.join(parts, "k").select("k", "query", F.col("parts"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = key.join(parts, "k").select("k", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "doc")
    return sides.join(held, ["k", "part"]).where("query <> doc").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("shared"))


def match(df: DataFrame, id_col: str, kg: str = "kg", **roles: str) -> DataFrame:
    """Documents with one triple that has all the given texts (subject=, property=, value=) in the same triple; no explode."""
    def hit(t: Column) -> Column:
        out = F.lit(True)
        for role, text in roles.items():
            out = out & (F.lower(F.array_join(t[role]["content"], " ")) == text.lower())
        return F.coalesce(out, F.lit(False))

    return df.where(F.exists(kg, hit)).select(F.col(id_col).alias("doc"))


def role_groupings(rows: DataFrame) -> DataFrame:
    """(grouping, key, n): triples counted with one to three roles replaced by their class.

    One pass over the triples: each is spread over the seven role sets before a map-side combined count.
    """
    sets = [c for k in (3, 2, 1) for c in combinations("spo", k)]
    spread = [F.struct(F.lit("".join(c)).alias("grouping"), F.concat_ws("|", *[F.concat(F.lit("#"), F.col(f"c{x}").cast("string")) if x in c else F.col(x) for x in "spo"]).alias("key")) for c in sets]
    return rows.select(F.explode(F.array(*spread)).alias("x")).select("x.*").groupBy("grouping", "key").agg(F.count(F.lit(1)).alias("n"))


def scaled_boosts(counts: DataFrame, by: str, n: str = "n", most: int = 10, skip: int = 0) -> DataFrame:
    """Counts rescaled to integers 1..most within their group, the ``skip`` highest left out.

    Only the ``skip`` highest are ranked; the bounds are aggregates, so no group stands in one task.
    """
    kept = counts
    if skip:
        top = counts.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(n), "key"))).where(F.col("_r") <= skip)
        kept = counts.join(top.select(by, "key"), [by, "key"], "left_anti")
    bounds = kept.groupBy(by).agg(F.min(n).alias("_low"), F.max(n).alias("_high"))
    boost = F.when(F.col("_high") == F.col("_low"), F.lit(1)).otherwise(F.floor(1 + (F.col(n) - F.col("_low")) * (most - 1) / (F.col("_high") - F.col("_low")) + 1e-9))
    return kept.join(bounds, by).withColumn("boost", boost.cast("int")).select(*counts.columns, "boost")


def relation_units(rows: DataFrame) -> DataFrame:
    """(triple_type, sentence, count, n_contexts): texts of each role with the number of their distinct contexts."""
    label = F.concat_ws("#", "s", "o")
    units = [("subject", F.col("s"), F.concat_ws("#", "p", "o")), ("relation", F.col("p"), label), ("object", F.col("o"), F.concat_ws("#", "s", "p"))]
    spread = F.array(*[F.struct(F.lit(k).alias("triple_type"), t.alias("sentence"), c.alias("context")) for k, t, c in units])
    return rows.select(F.explode(spread).alias("u")).select("u.*").where("sentence <> ''").groupBy("triple_type", "sentence").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("context").alias("n_contexts"))


def keyword_units(phrases: DataFrame) -> DataFrame:
    """Units of (doc, phrase): how often each keyword was taken; keywords have one context."""
    return phrases.where("phrase <> ''").groupBy(F.lit("keyword").alias("triple_type"), F.col("phrase").alias("sentence")).agg(F.count(F.lit(1)).alias("count"), F.lit(1).cast("long").alias("n_contexts"))


def add_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, no, cs, cp, co) by the classes (triple_type, sentence, class) of role texts, -1 where there is none."""
    out = rows.select("doc", "no", "s", "p", "o")
    for x, kind in (("s", "subject"), ("p", "relation"), ("o", "object")):
        own = classes.where(F.col("triple_type") == kind).select(F.col("sentence").alias(x), F.col("class").alias(f"c{x}"))
        out = out.join(own, x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", F.lit(-1)))
    return out.select("doc", "no", "cs", "cp", "co")


def class_statistics(rows: DataFrame, most: int = 10) -> DataFrame:
    """(role, class, n, top): counts of classes by role with their most frequent texts."""
    spread = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"c{x}").alias("class"), F.col(x).alias("text")) for r, x in zip(ROLES, "spo", strict=True)])
    counted = rows.select(F.explode(spread).alias("u")).select("u.*").groupBy("role", "class", "text").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("role", "class")
    ranked = counted.withColumn("r", F.row_number().over(w.orderBy(F.desc("c"), "text"))).where(F.col("r") <= most)
    total = counted.groupBy("role", "class").agg(F.sum("c").alias("n"))
    top = ranked.groupBy("role", "class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ## ").alias("top"))
    return total.join(top, ["role", "class"])


def trimmed_bounds(df: DataFrame, id_col: str, kg: str, drop: tuple[str, ...]) -> DataFrame:
    """(doc, no, subject, value): leading and trailing words of the given parts of speech cut off both ends' texts."""
    def cut(entry: Column) -> Column:
        keep = F.transform(entry["pos"], lambda p: ~F.coalesce(p.isin(*drop), F.lit(False)))
        first = F.array_position(keep, True)
        last = F.size(keep) - F.array_position(F.reverse(keep), True) + 1
        words = F.when(F.coalesce(first, F.lit(0)) > 0, F.slice(entry["content"], first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.when(F.size(keep) > 0, F.array().cast("array<string>")).otherwise(entry["content"]))
        return F.coalesce(F.array_join(words, " "), F.lit(""))

    rows = df.select(F.col(id_col).alias("doc"), F.posexplode(kg).alias("no", "t"))
    return rows.select("doc", "no", cut(F.col("t.subject")).alias("subject"), cut(F.col("t.value")).alias("value"))


def pivot_values(rows: DataFrame, values: list[str]) -> DataFrame:
    """A column for each value: the subjects of its triples, joined by '|'."""
    wanted = rows.where(F.col("o").isin(*values))
    columns = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("o") == v, F.col("s")))), "|").alias(v.replace(" ", "_")) for v in values]
    return wanted.groupBy("doc").agg(*columns)


def spo_units(rows: DataFrame) -> DataFrame:
    """(s, p, o, count, types): whole triples with the kinds of field they come from."""
    return rows.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("count"), F.array_join(F.array_sort(F.collect_set("field_type")), ",").alias("types"))


def concept_boosts(counts: DataFrame, most: float = 10.0, by: list[str] | None = None) -> DataFrame:
    """Counts n as boosts most * (n - min + 0.001) / (max - min); equal counts as if max were min + 1."""
    bounds = counts.groupBy(*(by or [])).agg(F.min("n").alias("_low"), F.max("n").alias("_high"))
    joined = counts.join(bounds, by) if by else counts.crossJoin(F.broadcast(bounds))  # one row
    width = F.when(F.col("_high") == F.col("_low"), F.lit(1)).otherwise(F.col("_high") - F.col("_low"))
    return joined.withColumn("boost", F.round(F.lit(most) * (F.col("n") - F.col("_low") + 0.001) / width, 6)).drop("_low", "_high")


def role_clauses(docs: DataFrame, query: DataFrame, groupings: tuple[str, ...] = ("spo", "sp", "so", "po", "s", "p", "o"), boost: float = 1.0) -> DataFrame:
    """(qid, doc, score): documents whose triples equal a query's in one of the mixes of classes and texts.

    docs: (doc, s, p, o, cs, cp, co), query: (qid, the same).  Each mix is a key of both sides, so that all seven clauses are one equi-join;
    a document scores ``boost`` for every distinct (mix, key) it shares.  Unknown classes (-1) match nothing by class.
    """
    def keys(df: DataFrame, who: str) -> DataFrame:
        spread = [
            F.when(F.lit(True) if not (known := [F.col(f"c{x}") >= 0 for x in g]) else _all(known), F.struct(F.lit(g).alias("grouping"), F.concat_ws("|", *[F.concat(F.lit("#"), F.col(f"c{x}").cast("string")) if x in g else F.lower(x) for x in "spo"]).alias("key")))
            for g in groupings
        ]
        return df.select(who, F.explode(F.array_compact(F.array(*spread))).alias("k")).select(who, "k.*").distinct()

    return keys(docs, "doc").join(keys(query, "qid"), ["grouping", "key"]).groupBy("qid", "doc").agg((F.count(F.lit(1)) * boost).alias("score"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


#: Questions that explain an entity, by its kind (fixed values).
EXPLAIN = {"person": "Who is {}?", "organization": "What is {}?", "organisation": "What is {}?", "location": "Where is {}?", "date": "What happened on {}?"}


def entity_questions(rows: DataFrame) -> DataFrame:
    """(doc, entity, question) for 'entity rel:instanceof kind' triples of kinds that can be explained."""
    asked = F.lit(None).cast("string")
    for kind, template in EXPLAIN.items():
        asked = F.when(F.col("o") == kind, F.concat(F.lit(template.split("{}")[0]), F.col("s"), F.lit(template.split("{}")[1]))).otherwise(asked)
    return rows.where(F.col("p") == "rel:instanceof").select("doc", F.col("s").alias("entity"), asked.alias("question")).where("question is not null").distinct()
