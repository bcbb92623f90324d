"""Sinks: documents, stage tables, tables by identity, evaluation files, training files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_documents(df: DataFrame, folder: str, compress: bool = True) -> None:
    df.write.mode("overwrite").json(folder, compression="gzip" if compress else "none")


def stage_table(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """Each stage writes a table of its own, never over its input."""
    path = f"{folder}/{stage}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def create_tables(spark: SparkSession, database: str, tables: dict[str, str]) -> list[str]:
    """Create those tables (name: DDL of columns) that don't exist; the names made."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    made = [t for t in tables if not spark.catalog.tableExists(f"{database}.{t}")]
    for t in made:
        spark.sql(f"CREATE TABLE {database}.{t} ({tables[t]}) USING parquet")
    return made


def merge_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both sides, the new row for every key it has (of several, the last by all columns)."""
    order = [F.desc(c) for c in new.columns if c != key and new.schema[c].dataType.typeName() not in ("map", "variant")]
    newest = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r") if order else new.dropDuplicates([key])
    return old.join(newest.select(key), key, "left_anti").unionByName(newest)


def embedding_rows(df: DataFrame, id_col: str, items: str) -> DataFrame:
    """One row a block of text: (row_id 'no/document', document, field, content, embedding)."""
    rows = df.select(F.col(id_col).alias("document"), F.posexplode(items).alias("no", "e"))
    return rows.select(F.concat_ws("/", F.col("no").cast("string"), F.md5(F.col("document").cast("string"))).alias("row_id"), "document", "e.field", "e.content", "e.embedding")


def trec_run(run: DataFrame, path: str, name: str) -> None:
    """Tab-separated qid Q0 docid rank score name."""
    run.select("qid", F.lit("Q0"), "doc_id", "rank", "score", F.lit(name)).write.mode("overwrite").csv(path, sep="\t")


def trec_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select("qid", F.lit(0), "doc_id", "rel").write.mode("overwrite").csv(path, sep="\t")


def training_files(parts: dict[str, DataFrame], path: str, seed: int = 0) -> DataFrame:
    """Splits of several tasks brought together in random order: (split, prefix, language, input_text, target_text)."""
    out = None
    for split, df in parts.items():
        own = df.select(F.lit(split).alias("split"), "prefix", "language", "input_text", "target_text")
        out = own if out is None else out.unionByName(own)
    shuffled = out.repartition(F.xxhash64("input_text", F.lit(seed))).sortWithinPartitions(F.xxhash64("input_text", "target_text", F.lit(seed)))
    shuffled.write.mode("overwrite").partitionBy("split").csv(path, sep="\t", header=True)
    return out
