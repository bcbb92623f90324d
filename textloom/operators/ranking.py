"""The best documents of every query, without a table of their pairs.

Nearly every document holds a word of nearly every query, so pairs grow as queries times documents.  Here documents are
written once as numbers of the queries' terms; a task scores its own documents in blocks and hands on no more than the
best ``size`` of each query.

Defined results: those of ``retrieval``.  Where an identifier is repeated, its rows' terms are counted together and scored
with each of the rows' lengths, and these are summed (a join of postings with lengths); rows without an identifier count
in the statistics and are never found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import broadcast_if_small, discard, materialize
from .retrieval import K1, B

#: Rows (qid, term) of the query side that one pass over the documents holds; more take further passes.
QUERY_ROWS = 200_000
#: Cells of a task's block of terms times documents.
CELLS = 8_000_000
#: Scores are rounded to this part of one.
PARTS = 1e6


@dataclass(frozen=True)
class QuerySide:
    """Distinct terms, and for each query of each list its terms' numbers with their boosts."""

    vocabulary: pa.Array
    lists: pa.Array
    qids: pa.Array
    terms: list[np.ndarray]
    boosts: list[np.ndarray]

    @staticmethod
    def of(rows: pa.Table) -> QuerySide:
        numbers, qid, term, boost = (rows[c].combine_chunks() for c in ("list", "qid", "term", "boost"))
        vocabulary = pc.unique(term)
        codes = pc.index_in(term, value_set=vocabulary).to_numpy()
        named = pc.dictionary_encode(qid, null_encoding="encode")
        key = numbers.to_numpy().astype(np.int64) * max(1, len(named.dictionary)) + named.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        keys, starts = np.unique(key[order], return_index=True)
        parts = lambda x: np.split(x[order], starts[1:]) if len(keys) else []
        lists, qids = np.divmod(keys, max(1, len(named.dictionary)))
        return QuerySide(vocabulary, pa.array(lists, pa.int32()), named.dictionary.take(pa.array(qids)), parts(codes), parts(boost.to_numpy()))


def _coder(side) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, words) to (doc_id, dl, codes, tfs): its length and its terms that queries have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = side.value.vocabulary
        for batch in batches:
            words, width = batch.column(1), max(1, len(vocabulary))
            dl = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
            code = pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), -1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), dl)[code >= 0]
            key, tf = np.unique(row * width + code[code >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * width), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % width, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl), *lists], ["doc_id", "dl", "codes", "tfs"])

    return run


def _scorer(side, sizes: list[int], idf: np.ndarray, avgdl: float, k1: float, b: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, lens, codes, tfs) to (list, qid, doc_id, score): a task's best documents of each query."""
    width = max(1, CELLS // max(1, len(idf)))

    def weights(rows: pa.RecordBatch, row: np.ndarray, codes: np.ndarray) -> np.ndarray:
        n, lens = pc.list_value_length(rows.column(1)).to_numpy(), rows.column(1).flatten().to_numpy()
        first, tf, out = np.cumsum(n) - n, rows.column(3).flatten().to_numpy().astype(float), np.zeros(len(codes))
        for j in range(n.max(initial=0)):  # once, but for repeated identifiers
            has = np.flatnonzero(n[row] > j)
            out[has] += idf[codes[has]] * tf[has] * (k1 + 1) / (tf[has] + k1 * (1 - b + b * lens[first[row[has]] + j] / avgdl))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, kind = side.value, None
        most = [sizes[i] for i in s.lists.to_pylist()]
        low = [0.0] * len(most)  # a score must be above it
        kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(most)
        block = None
        for batch in batches:
            kind = batch.column(0).type
            block = np.zeros((len(s.vocabulary), width)) if block is None else block
            for at in range(0, batch.num_rows, width):
                rows = batch.slice(at, width)
                row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column(2)).to_numpy())
                codes, ids = rows.column(2).flatten().to_numpy(), rows.column(0).to_numpy(zero_copy_only=False)
                block[codes, row] = weights(rows, row, codes)
                part = block[:, : rows.num_rows]
                for q, (terms, boosts) in enumerate(zip(s.terms, s.boosts, strict=True)):
                    raw = boosts @ part[terms]
                    hit = np.flatnonzero(raw > low[q])
                    if not len(hit):
                        continue
                    score, doc = np.floor(raw[hit] * PARTS + 0.5) / PARTS, ids[hit]
                    if kept[q] is not None:
                        score, doc = np.concatenate([kept[q][0], score]), np.concatenate([kept[q][1], doc])
                    if len(score) > most[q]:
                        order = np.lexsort((doc, -score))[: most[q]]
                        score, doc = score[order], doc[order]
                    if len(score) == most[q]:
                        low[q] = max(0.0, score.min() - 1 / PARTS)
                    kept[q] = score, doc
                block[codes, row] = 0.0
        for q, x in enumerate(kept):
            if x is not None:
                score, doc = x
                same = pa.array(np.full(len(score), q))
                yield pa.RecordBatch.from_arrays([s.lists.take(same), s.qids.take(same), pa.array(doc, kind), pa.array(score)], ["list", "qid", "doc_id", "score"])

    return run


def _by_document(coded: DataFrame) -> DataFrame:
    """(doc_id, lens, codes, tfs): one row for each identifier; ``coded`` is given up where some are repeated."""
    repeated = materialize(coded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated")
    single = coded.select("doc_id", F.array("dl").alias("lens"), "codes", "tfs")
    if repeated.isEmpty():
        discard(repeated)
        return single
    same, known = F.col("doc_id").eqNullSafe(F.col("again")), broadcast_if_small(repeated)  # a shuffled join would move all documents, twice
    rows = coded.join(known, same, "left_semi")
    lens = rows.groupBy(F.col("doc_id").alias("again")).agg(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.col("dl"))).alias("lens"))
    each = rows.select("doc_id", F.explode(F.arrays_zip("codes", "tfs")).alias("x")).groupBy("doc_id", F.col("x.codes").alias("code")).agg(F.sum("x.tfs").cast("int").alias("tf"))
    lists = each.groupBy("doc_id").agg(F.collect_list(F.struct("code", "tf")).alias("x"))  # no longer than the queries' terms
    whole = lists.join(lens, same).select("doc_id", "lens", F.col("x.code").alias("codes"), F.col("x.tf").alias("tfs"))
    out = materialize(single.join(known, same, "left_anti").unionByName(whole), "coded")
    discard(coded, repeated)
    return out


def _pass(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame, sizes: list[int], k1: float, b: float) -> DataFrame:
    spark, named = docs.sparkSession, {"doc_id": docs.schema[id_col].dataType.simpleString(), "qid": asked.schema["qid"].dataType.simpleString()}
    known = QuerySide.of(asked.toArrow())
    side = spark.sparkContext.broadcast(known)
    words = docs.select(F.col(id_col).alias("doc_id"), T.words(F.col(text_col)).alias("words"))
    coded = materialize(words.mapInArrow(_coder(side), f"doc_id {named['doc_id']}, dl bigint, codes array<int>, tfs array<int>"), "coded")
    n, avgdl = coded.agg(F.count(F.lit(1)), F.avg(F.col("dl").cast("double"))).first()
    rows = _by_document(coded)
    df = np.ones(len(known.vocabulary))
    counted = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).toArrow()  # terms of queries
    df[counted["code"].to_numpy()] = counted["df"].to_numpy()
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    best = rows.where("doc_id is not null").mapInArrow(_scorer(side, sizes, idf, avgdl or 1.0, k1, b), f"list int, qid {named['qid']}, doc_id {named['doc_id']}, score double")
    rank = F.row_number().over(Window.partitionBy("list", "qid").orderBy(F.desc("score"), "doc_id"))
    most = F.get(F.array(*[F.lit(x) for x in sizes]), F.col("list"))
    out = materialize(best.withColumn("rank", rank).where(F.col("rank") <= most), "best")
    discard(rows)
    return out


def passes(docs: DataFrame, id_col: str, text_col: str, asked: list[tuple[DataFrame, int]], k1: float = K1, b: float = B) -> Iterator[DataFrame]:
    """Tables (list, qid, rank, doc_id, score) of all queries of ``asked``, each query in one of them; made when they are asked for, the caller's to discard."""
    rows = None
    for i, (terms, _) in enumerate(asked):
        own = terms.select(F.lit(i).alias("list"), "qid", "term", "boost")
        rows = own if rows is None else rows.unionByName(own)
    n = max(1, -(-rows.count() // QUERY_ROWS))
    for p in range(n):
        yield _pass(docs, id_col, text_col, rows.where(F.pmod(F.hash("qid"), F.lit(n)) == p), [size for _, size in asked], k1, b)


def lists(found: DataFrame, n: int) -> list[DataFrame]:
    """(qid, rank, doc_id, score) of each of the ``n`` lists."""
    return [found.where(F.col("list") == i).select("qid", "rank", "doc_id", "score") for i in range(n)]


def best(docs: DataFrame, id_col: str, text_col: str, asked: list[tuple[DataFrame, int]], k1: float = K1, b: float = B) -> list[DataFrame]:
    """For each (terms, size) of ``asked`` the first ``size`` ranks of every query by BM25: (qid, rank, doc_id, score).

    terms: (qid, term, boost).  The documents are cut into words once for all lists.
    """
    out = None
    for found in passes(docs, id_col, text_col, asked, k1, b):
        out = found if out is None else out.unionByName(found)
    return lists(out, len(asked))


def asked_once(queries: DataFrame, *terms: DataFrame) -> DataFrame:
    """(qid, asked), materialized: the smallest identifier of the queries that have the same terms in each of ``terms`` and the same other columns.

    queries: (qid, ...), one row each; terms: (qid, term, boost).  Queries without identifier are in no row.
    """
    for i, t in enumerate(terms):
        bag = t.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "boost"))).alias(f"bag{i}"))  # no longer than a query
        queries = queries.join(bag, "qid", "left")
    known = queries.where("qid is not null")
    told = Window.partitionBy(*[c for c in known.columns if c != "qid"])
    return materialize(known.withColumn("asked", F.min("qid").over(told)).select("qid", "asked"), "asked")
