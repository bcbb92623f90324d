"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import load
from . import containers, eval_leaks, format_duplicates, mail_bodies, near_duplicates, personal_data, similar_vectors, similarity_groups, subject_areas, term_counts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_vectors.near_pairs(load(spark, sf_dir, "doc_embeddings"), "emb_id", "embedding")
    return pairs.select(F.col("id_a").alias("emb_id_a"), F.col("id_b").alias("emb_id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_bodies.new_lines(load(spark, sf_dir, "mail_docs")).select(F.col("mail").alias("mail_id"), "line_no")


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_bodies.new_bodies(load(spark, sf_dir, "mail_docs")).withColumnRenamed("mail", "mail_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similarity_groups.group_rows(load(spark, sf_dir, "relation_names"), "relation_id", "triple_type", "embedding")
    return rows.withColumnRenamed("id", "relation_id")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups.describe(load(spark, sf_dir, "relation_names"), "relation_id", "triple_type", "embedding", "sentence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(load(spark, sf_dir, "converted_docs"), "record_id", F.concat_ws(" ", "content"))
    return pairs.select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(load(spark, sf_dir, "converted_docs"), "record_id", F.concat_ws(" ", "content"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.marked_terms(load(spark, sf_dir, "tagged_docs"), load(spark, sf_dir, "relation_names"))


def p5_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.frequencies(load(spark, sf_dir, "tagged_docs"), load(spark, sf_dir, "relation_names"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(load(spark, sf_dir, "converted_docs"), "record_id", *personal_data.record_texts())
    return found.select(F.col("id").alias("record_id"), "place", "kind", "found").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = personal_data.redact(load(spark, sf_dir, "converted_docs"), "record_id", *personal_data.record_texts())
    return texts.select(F.col("id").alias("record_id"), F.array_join("content", "\n").alias("content"), F.array_join("kg_content", " | ").alias("kg_content"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.kg_duplicates(load(spark, sf_dir, "kg_lines"))


def p7_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "kg_lines")
    return format_duplicates.collapse(lines, "kg_id", format_duplicates.triple_fields(F.col("kg")), F.try_parse_json("kg").isNotNull())


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = containers.pack_texts(load(spark, sf_dir, "documents"), "doc_id", "text")
    return packed.withColumnRenamed("item", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_queries")).select("qid", "doc_id")


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_queries"))


def p9_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.clean(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_queries")).select("doc_id", "source")


def _subject_model(spark: SparkSession, sf_dir: str) -> subject_areas.SubjectModel:
    return subject_areas.fit_from(*(load(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas.classify(load(spark, sf_dir, "documents"), _subject_model(spark, sf_dir)).distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas.composition(load(spark, sf_dir, "documents"), _subject_model(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}
