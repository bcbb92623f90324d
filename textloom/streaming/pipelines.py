"""Streaming: files as they land, exactly once by content, stages in order; windows over events.

A folder is watched by a file source; every document is identified by its content's hash, and only its first
arrival is passed on.  Stages write tables of their own, each with a checkpoint, so a stage goes on where it stopped.
Event windows carry watermarks, so their state is bounded.

Defined results: late rows beyond the watermark are dropped from windows (not from files); null times fall in no
window; empty folders end at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text as T


def watch(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "json", files: int = 1000) -> DataFrame:
    """Rows of files that land in a folder, at most ``files`` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).format(kind).load(folder)


def first_arrivals(docs: DataFrame, *parts: str, within: str | None = None, time: str | None = None) -> DataFrame:
    """Each content once; with ``within`` only repetitions inside that time are found, and state stays bounded."""
    hashed = docs.withColumn("doc_hash", T.content_id(*[F.col(p) for p in parts]))
    if within and time:
        return hashed.withWatermark(time, within).dropDuplicatesWithinWatermark(["doc_hash"])
    return hashed.dropDuplicates(["doc_hash"])


def run_stage(docs: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """One stage of the pipeline: all there is (``once``) or every 5 seconds."""
    writer = transform(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def run_pipeline(spark: SparkSession, folder: str, schema: StructType | str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], root: str, kind: str = "json") -> list[dict]:
    """All stages over what has landed, each reading the one before; the status of each."""
    status, at, current, fmt = [], folder, schema, kind
    for name, transform in stages:
        q = run_stage(watch(spark, at, current, fmt), transform, f"{root}/{name}", f"{root}/_state/{name}")
        q.awaitTermination()
        status.append({"stage": name, "status": "finished", "error": q.exception() is not None, "rows": sum(p["numInputRows"] for p in q.recentProgress)})
        at, fmt = f"{root}/{name}", "parquet"
        current = spark.read.parquet(at).schema
    return status


def tumbling(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, by, n, total) by fixed windows; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", step: str = "30 minutes", late: str = "2 days") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(by, start, end, n): runs of events with gaps below ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def update_centroids(state: dict[str, tuple[float, list[float]]], batch: DataFrame, label: str, vec: str, weight: str) -> dict[str, tuple[float, list[float]]]:
    """Centroids (total weight, mean) by label, moved by a micro-batch's weighted vectors; rows without label, vector or weight above 0 don't count."""
    rows = batch.where(F.col(label).isNotNull() & F.col(vec).isNotNull() & (F.col(weight) > 0)).select(label, F.col(weight).cast("double").alias("w"), F.posexplode(vec).alias("i", "x"))
    parts = rows.groupBy(label, "i").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.sum("w").alias("w")).collect()  # labels x dimensions
    sums: dict[str, dict[int, tuple[float, float]]] = {}
    for r in parts:
        sums.setdefault(str(r[label]), {})[r["i"]] = (r["s"], r["w"])
    out = dict(state)
    for k, by_dim in sums.items():
        before, mean = state.get(k, (0.0, [0.0] * len(by_dim)))
        out[k] = before + by_dim[0][1], [(m * before + by_dim.get(i, (0.0, 0.0))[0]) / (before + by_dim.get(i, (0.0, 0.0))[1]) for i, m in enumerate(mean)]
    return out
