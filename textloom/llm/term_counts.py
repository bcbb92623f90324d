"""Frequency of every distinct term: last-seen counters.

Tokens arrive ordered by record.  Every term has a counter (occurrences, records, last record): a
token adds an occurrence, and a record only if the record differs from the last one the term was
seen in; so no set of records is kept.  Each task runs such counters over its own records before
anything is shuffled, which leaves at most one counter for each term and task of even the most
frequent term; counters are then hash-partitioned by term and summed.

A record's occurrences of a term must stand in one task.  That holds where a record is a row with an
array of tokens, and where (record, term) is unique.

Defined results: null and blank terms are not counted; null flags are false and null weights 0; a
record repeated under its identifier has to be removed before, as ``latest`` and
``relation_terms`` do (ties of the time go to the larger row identifier); empty tables give no term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms held by one task's counters before they are handed on; a bound of memory, not of terms.
COUNTERS_PER_TASK = 500_000
_COUNTER = "origin string, term string, occurrences bigint, records bigint, weight bigint, flagged boolean"


class LastSeen:
    """Counters of one task, fed with blocks of tokens ordered by record."""

    def __init__(self) -> None:
        self.index: dict[tuple[str, str], int] = {}
        self.occurrences = self.records = self.weight = np.zeros(0, np.int64)
        self.flagged, self.last = np.zeros(0, bool), np.zeros(0, np.int64)

    def _grow(self, n: int) -> None:
        more = n - len(self.occurrences)
        if more > 0:
            more = max(more, len(self.occurrences))
            pad = np.zeros(more, np.int64)
            self.occurrences, self.records, self.weight = (np.concatenate([x, pad]) for x in (self.occurrences, self.records, self.weight))
            self.flagged, self.last = np.concatenate([self.flagged, np.zeros(more, bool)]), np.concatenate([self.last, pad - 1])

    def add(self, origin: str, terms: pa.Array, record: np.ndarray, weight: np.ndarray, flag: np.ndarray) -> None:
        """``record``: ever larger numbers of this task's records, one for each term."""
        coded = terms.dictionary_encode()
        names = coded.dictionary.to_pylist()
        slot = np.array([self.index.setdefault((origin, t), len(self.index)) for t in names], np.int64)
        self._grow(len(self.index))
        code = slot[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(code, kind="stable")
        code, record, weight, flag = code[order], record[order], weight[order], flag[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        which = code[starts]
        seen_before = np.empty(len(code), np.int64)  # the last record of the term before each token
        seen_before[1:] = record[:-1]
        seen_before[starts] = self.last[which]
        self.occurrences[which] += np.diff(np.r_[starts, len(code)])
        self.records[which] += np.add.reduceat((record != seen_before).astype(np.int64), starts)
        self.weight[which] += np.add.reduceat(weight, starts)
        self.flagged[which] |= np.logical_or.reduceat(flag, starts)
        self.last[which] = record[np.r_[starts[1:], len(code)] - 1]

    def flush(self) -> Iterator[pa.RecordBatch]:
        n, keys = len(self.index), list(self.index)
        for a in range(0, n, 20_000):
            b = min(a + 20_000, n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys[a:b]]), pa.array([k[1] for k in keys[a:b]]), pa.array(self.occurrences[a:b]), pa.array(self.records[a:b]), pa.array(self.weight[a:b]), pa.array(self.flagged[a:b])], names=["origin", "term", "occurrences", "records", "weight", "flagged"])
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters, at = LastSeen(), 0
    for b in batches:
        tokens = b.column("tokens")
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        record = np.repeat(np.arange(at, at + len(b)), lengths)
        at += len(b)
        flat = tokens.flatten()
        origin = b.column("origin")
        per_token = pc.take(origin, pa.array(record - (at - len(b)))) if len(record) else None
        for name in pc.unique(origin).to_pylist():
            keep = pc.equal(per_token, name).to_numpy(zero_copy_only=False) if len(record) else np.zeros(0, bool)
            if keep.any():
                own = flat.filter(pa.array(keep))
                counters.add(name, own.field(0), record[keep], own.field(1).to_numpy(zero_copy_only=False), own.field(2).to_numpy(zero_copy_only=False))
        if len(counters.index) > COUNTERS_PER_TASK:
            yield from counters.flush()
    yield from counters.flush()


def count_terms(records: DataFrame) -> DataFrame:
    """(origin, term, occurrences, records, weight, flagged).

    ``records``: origin string, tokens array<struct<term string, weight bigint, flag boolean>>, one
    row for a record; weight is summed, flag is true if it is for any token of the term.
    """
    counters = records.select("origin", "tokens").mapInArrow(_count, _COUNTER)
    return counters.groupBy("origin", "term").agg(*[F.sum(c).alias(c) for c in ("occurrences", "records", "weight")], F.max("flagged").alias("flagged"))


def latest(df: DataFrame, key: str, time: str, row_id: str, value: str) -> DataFrame:
    """(key, value) of the row with the latest time; the row's identifier breaks ties.

    Only (key, time, identifier) is aggregated, with partial aggregates; values are not shuffled for it
    but fetched by the rows that won.
    """
    rank = F.struct(F.col(time).alias("t"), F.col(row_id).alias("i"))
    best = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(rank)["i"].alias("_i"))
    return df.select(F.col(key), F.col(row_id).alias("_i"), F.col(value)).join(best.select("_i"), "_i").select(key, value)


def lemma_records(tagged: DataFrame) -> DataFrame:
    """A record for each tagged document, by its latest run; tokens are cut to what is counted before any join."""
    kept = F.filter("content_morphosyntax", lambda t: ~F.coalesce(t["pos"], F.lit("")).isin("NUM", "PUNCT") & (F.trim(F.coalesce(t["lemma"], F.lit(""))) != ""))
    tokens = F.transform(kept, lambda t: F.struct(F.lower(F.trim(t["lemma"])).alias("term"), F.lit(1).cast("bigint").alias("weight"), F.coalesce(t["is_oov"], F.lit(False)).alias("flag")))
    slim = tagged.select("source_doc_id", "tagged_at", "tagged_id", F.coalesce(tokens, F.array().cast("array<struct<term:string,weight:bigint,flag:boolean>>")).alias("tokens"))
    return latest(slim, "source_doc_id", "tagged_at", "tagged_id", "tokens").select(F.lit("lemma").alias("origin"), "tokens")


#: The mark of the role that some names carry.
ROLE_MARK = r"#{2,}\s*[A-Za-z]+\s*#{2,}"


def relation_terms(relations: DataFrame) -> DataFrame:
    """(origin, batch, term, count): rows sent again for a batch counted once, the first sent kept."""
    term = F.trim(F.lower(F.regexp_replace("sentence", ROLE_MARK, "")))
    rows = relations.where(F.col("triple_type").isNotNull()).select(F.col("triple_type").alias("origin"), "batch_id", F.trim(F.regexp_replace(term, r"^\s+|\s+$", "")).alias("term"), "relation_id", F.coalesce("count", F.lit(0)).alias("_c"))
    return rows.where("term <> ''").groupBy("origin", "batch_id", "term").agg(F.min_by("_c", "relation_id").alias("count"))


def relation_records(relations: DataFrame) -> DataFrame:
    return relation_terms(relations).select("origin", F.array(F.struct("term", F.col("count").alias("weight"), F.lit(False).alias("flag"))).alias("tokens"))


def frequencies(tagged: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of every lemma and name, with its mark (null for useful ones).

    Lemmas: common in over 20 % of the records, rare (rare_oov if unknown) in fewer than 3.
    Names: rare if counted at most twice, common from 5000 on.
    """
    docs = tagged.where(F.col("source_doc_id").isNotNull()).agg(F.countDistinct("source_doc_id").alias("_docs"))
    lemmas = count_terms(lemma_records(tagged)).crossJoin(F.broadcast(docs))  # one row
    mark = F.when(F.col("records") * 5 > F.col("_docs"), "common").when(F.col("records") < 3, F.when(F.col("flagged"), "rare_oov").otherwise("rare"))
    names = count_terms(relation_records(relations)).withColumn("mark", F.when(F.col("weight") <= 2, "rare").when(F.col("weight") >= 5000, "common"))
    out = ("origin", "term", F.col("occurrences"), "records", F.col("weight").alias("total"), "mark")
    return lemmas.withColumn("mark", mark).select(*out).unionByName(names.select(*out))


def marked_terms(tagged: DataFrame, relations: DataFrame) -> DataFrame:
    return frequencies(tagged, relations).where("mark is not null").select("origin", "term", "mark")
