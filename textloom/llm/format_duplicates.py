"""Duplicates hidden by formatting: progressive partition refinement.

Rows are split into ever finer classes by ever costlier keys, and a key is only computed for rows
that still share their class with another row:

1. stripped lengths of the compared fields,
2. a letter histogram of the stripped text,
3. a SHA-256 of the stripped text itself.

Every class count is a map-side combined aggregate, so a class holding a third of all rows costs one
counter per task.  Rows are led back to their class by salted joins, so that class is never
gathered in one task.

Defined results: a null or unparsable record has no fields, is in no class and gives no row of
``duplicate_rows`` (it is its own copy in ``collapse``); an absent or null field counts as empty;
a repeated row is a copy like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: Letters counted together by the histogram; what is in none of them counts through the length.
HISTOGRAM_GROUPS = ("ae", "io", "nr", "st", "dlu", "cmp", "bfgh", "0123456789")
SALTS = 16


def strip_format(text: Column) -> Column:
    """Letters and digits of ``text`` in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def json_text(record: Column, path: str) -> Column:
    """The text at ``path`` of a parsed record: a string, or an array of strings joined."""
    return F.coalesce(
        F.array_join(F.try_variant_get(record, path, "array<string>"), "", ""),
        F.try_variant_get(record, path, "string"),
        F.lit(""),
    )


def triple_fields(json: Column) -> list[Column]:
    """The six compared fields of a triple written as JSON."""
    record = F.try_parse_json(json)
    return [json_text(record, f"$.{part}.{key}") for part in ("subject", "property", "value") for key in ("content", "lemma_content")]


def _histogram(text: Column) -> Column:
    return F.concat_ws(",", *[(F.length(text) - F.length(F.translate(text, group, ""))).cast("string") for group in HISTOGRAM_GROUPS])


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` occur in more than one row."""
    salt = F.pmod(F.hash("_id"), F.lit(SALTS))
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    several = several.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(several, [*keys, "_salt"], "left_semi").drop("_salt")


def classes(df: DataFrame, id_col: str, fields: list[Column], valid: Column | None = None) -> DataFrame:
    """(kept_id, row_id, n_copies) for every row of a class of two or more."""
    stripped = [strip_format(f) for f in fields]
    rows = df.where(F.col(id_col).isNotNull() & (valid if valid is not None else F.lit(True))).select(F.col(id_col).alias("_id"), F.array(*stripped).alias("_s"))
    rows = rows.select("_id", F.concat_ws(",", F.transform("_s", lambda x: F.length(x).cast("string"))).alias("_lengths"), F.array_join("_s", "\u0001").alias("_text"))
    rows = materialize(rows, "stripped")
    by_length = _shared(rows, ["_lengths"])
    by_letters = _shared(by_length.withColumn("_letters", _histogram(F.col("_text"))), ["_lengths", "_letters"])
    keyed = materialize(by_letters.select("_id", F.sha2("_text", 256).alias("_key")), "keyed")
    kept = keyed.groupBy("_key").agg(F.min("_id").alias("kept_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    kept = kept.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("_salt", F.pmod(F.hash("_id"), F.lit(SALTS))).join(kept, ["_key", "_salt"]).select("kept_id", F.col("_id").alias("row_id"), "n_copies")


def duplicate_rows(df: DataFrame, id_col: str, fields: list[Column], valid: Column | None = None) -> DataFrame:
    """(kept_id, copy_id): every copy with the row kept of its class."""
    return classes(df, id_col, fields, valid).where("row_id > kept_id").select("kept_id", F.col("row_id").alias("copy_id"))


def collapse(df: DataFrame, id_col: str, fields: list[Column], valid: Column | None = None) -> DataFrame:
    """(kept_id, n_copies): one row for each class, single rows with 1 copy."""
    found = materialize(classes(df, id_col, fields, valid), "classes")
    single = df.select(F.col(id_col).alias("row_id")).join(found.select("row_id"), "row_id", "left_anti").select(F.col("row_id").alias("kept_id"), F.lit(1).cast("bigint").alias("n_copies"))
    return found.where("row_id = kept_id").select("kept_id", "n_copies").unionByName(single)


def kg_duplicates(kg_lines: DataFrame) -> DataFrame:
    return duplicate_rows(kg_lines, "kg_id", triple_fields(F.col("kg")), F.try_parse_json("kg").isNotNull())
