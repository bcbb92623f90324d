"""Vectors: nearest rows of a query set, centroids and weighted k-means by role.

Defined results: null, empty and zero vectors and those of another length take no part; equal cosines go
to the smaller identifier; a role with fewer vectors than clusters gets as many clusters as vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS


def usable(df: DataFrame, vec: str, dim: int = 64) -> DataFrame:
    v = F.col(vec)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(v) == dim) & finite & F.exists(vec, lambda x: x != 0))


def mean_vectors(df: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, dim, n, mean): mean vector of each group, a row for each dimension; partial sums before the shuffle, so no group is gathered."""
    numbers = df.select(by, F.posexplode(vec).alias("dim", "x"))
    return numbers.groupBy(by, "dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _best_of_task(queries_b, k: int):
    """The k best of a task's rows for every query: blocks of products, then only the best are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = queries_b.value
        best_id, best = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0), np.int64)
        for b in batches:
            if not len(b) or not len(qid):
                continue
            column = b.column(1)
            at = column.offsets.to_numpy()
            x = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(len(b), -1).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            order = np.argsort(b.column(0).to_numpy(), kind="stable")  # of equal cosines the smaller identifier
            ids, x = b.column(0).to_numpy()[order], x[order]
            cos = np.rint(q @ x.T * 1e6).astype(np.int64)
            width = min(k, len(ids))
            key = cos * (1 << 20) + np.arange(len(ids), 0, -1)
            near = np.argpartition(-key, width - 1, axis=1)[:, :width]
            ids, cos = np.concatenate([best_id, ids[near]], axis=1), np.concatenate([best, np.take_along_axis(cos, near, 1)], axis=1)
            first = np.lexsort((ids, -cos), axis=1)[:, :k]
            best_id, best = np.take_along_axis(ids, first, 1), np.take_along_axis(cos, first, 1)
        n = best.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(best_id.ravel()), pa.array(best.ravel() / 1e6)], names=["qid", "id", "cos"])

    return run


def cosine_top(queries: DataFrame, rows: DataFrame, id_col: str, vec: str, k: int = 10, most: int = 4096) -> DataFrame:
    """(qid, id, cos, rank): exact search of a stated query set (qid, vec) against all rows; usable vectors of one length.

    The query set goes to all tasks in blocks of at most ``most`` rows; a task hands on k rows a query.
    """
    n = queries.count()
    if n > BROADCAST_ROWS:
        raise ValueError("an exact search is for a stated query set, not for all rows")
    blocks, out = max(1, -(-n // most)), None
    slim = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("v"))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select(F.col("qid").cast("bigint"), "vec").toPandas()
        q = np.array([np.asarray(v, np.float64) for v in part["vec"]]).reshape(len(part), -1)
        unit = q / np.linalg.norm(q, axis=1, keepdims=True) if len(q) else q
        sent = rows.sparkSession.sparkContext.broadcast((part["qid"].to_numpy(np.int64), unit))
        found = slim.mapInArrow(_best_of_task(sent, k), "qid bigint, id bigint, cos double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, centroid): element-wise mean."""
    parts = df.select(F.col(label).alias("label"), F.posexplode(vec).alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))  # one vector


def nearest_centroid(df: DataFrame, id_col: str, vec: str, cents: DataFrame, most: int = 100_000) -> DataFrame:
    """(id, label, distance) of the nearest of a model's centroids (label, centroid), ``most`` at most; the smaller label on ties."""
    model = cents.orderBy("label").limit(most + 1).toPandas()
    if len(model) > most:
        raise ValueError(f"a model of more than {most} centroids")
    labels, c = model["label"].to_numpy(np.int64), np.array([np.asarray(x, np.float64) for x in model["centroid"]])
    sent = df.sparkSession.sparkContext.broadcast((labels, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, c = sent.value
        for b in batches:
            ids, rows = b.column(0), b.column(1).to_pylist()
            at = [i for i, v in enumerate(rows) if v is not None and len(c) and len(v) == c.shape[1]]
            x = np.array([rows[i] for i in at], np.float64).reshape(len(at), -1)
            d = np.round(np.sqrt(np.stack([((x - m) ** 2).sum(axis=1) for m in c], axis=1)), 6) if at else np.zeros((0, 1))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(labels[near] if at else np.zeros(0, np.int64)), pa.array(d[np.arange(len(at)), near])], names=["id", "label", "distance"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec)).mapInArrow(run, "id bigint, label bigint, distance double")


def kmeans_by_role(df: DataFrame, id_col: str, role: str, vec: str, weight: str, k: int = 16, seed: int = 7, rounds: int = 20) -> DataFrame:
    """(role, id, class): one weighted k-means model for each role."""
    rows = usable(df, vec).select(F.col(id_col).alias("id"), F.col(role).alias("role"), array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.greatest(F.coalesce(F.col(weight), F.lit(1)), F.lit(1)).cast("double").alias("w"))
    out = None
    for r in sorted(x["role"] for x in rows.where("role is not null").select("role").distinct().collect()):  # the roles of a triple
        own = rows.where(F.col("role") == r)
        n = min(k, own.limit(k).count())
        if n < 2:
            found = own.select("role", "id", F.lit(0).alias("class"))
        else:
            model = KMeans(k=n, seed=seed, maxIter=rounds, weightCol="w", featuresCol="features", predictionCol="class").fit(own)
            found = model.transform(own).select("role", "id", "class")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.select("role", "id", F.lit(0).alias("class"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(label, drift): how far each centroid moved between two models."""
    sq = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return before.select("label", F.col("centroid").alias("a")).join(after.select("label", F.col("centroid").alias("b")), "label").select("label", F.round(F.sqrt(sq), 6).alias("drift"))

