"""The engine's front: build an index once, then search, suggest, expand, relate and evaluate.

    engine = Engine.build(documents, "doc_id", "text")
    engine.search(queries, SearchPolicy(size=10))
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchPolicy
from ..operators import evaluation, index, retrieval
from ..runtime import materialize


@dataclass(frozen=True)
class Engine:
    documents: DataFrame
    id_col: str
    postings: DataFrame
    lengths: DataFrame
    tokens: DataFrame

    @staticmethod
    def build(documents: DataFrame, id_col: str, text_col: str) -> Engine:
        """Postings and lengths are written once, each query reads them."""
        toks = index.tokens(documents, id_col, text_col)
        return Engine(documents, id_col, materialize(index.stored_postings(documents, id_col, text_col), "postings"), materialize(index.lengths(documents, id_col, text_col), "lengths"), toks)

    def search(self, queries: DataFrame, policy: SearchPolicy | None = None, qid: str = "qid", text: str = "query") -> DataFrame:
        """(qid, rank, doc_id, score) and the documents' columns but those excluded; all queries in one job."""
        policy = policy or SearchPolicy()
        terms = retrieval.query_terms(queries, qid, text, cut=policy.cut_query)
        found = retrieval.match_or(self.postings, self.lengths, terms)
        wide = retrieval.page(found, policy.start + policy.size + policy.expand_results)
        if policy.penalty != "no-normalization":
            penalty = retrieval.penalties(wide, self.postings, terms).where(F.col("strategy") == policy.penalty).drop("strategy")
            wide = wide.join(penalty, ["qid", "doc_id"]).withColumn("score", F.round(F.col("score") * F.col("penalty"), 6)).drop("penalty")
        out = retrieval.page(wide.drop("rank"), policy.size, policy.start)
        if policy.normalize:
            out = retrieval.normalize(out)
        shown = self.documents.drop(*policy.excludes)
        return out.join(shown.withColumnRenamed(self.id_col, "doc_id"), "doc_id")

    def expand(self, queries: DataFrame, feedback: DataFrame, policy: SearchPolicy | None = None, qid: str = "qid", text: str = "query") -> DataFrame:
        policy = policy or SearchPolicy()
        return retrieval.expand(retrieval.query_terms(queries, qid, text), feedback, self.postings, policy.prune_terms, policy.widest_term, policy.least_part)

    def see_also(self, docs: DataFrame, policy: SearchPolicy | None = None) -> DataFrame:
        return retrieval.min_max(retrieval.more_like(docs, self.postings, (policy or SearchPolicy()).cross_links), "score", [])

    def suggest(self, entries: DataFrame, prefix: str, size: int = 10) -> DataFrame:
        return retrieval.suggest(entries, prefix, size)

    def evaluate(self, queries: DataFrame, qrels: DataFrame, depth: int = 500, qid: str = "qid", text: str = "query") -> DataFrame:
        run = retrieval.page(retrieval.match_or(self.postings, self.lengths, retrieval.query_terms(queries, qid, text)), depth)
        return evaluation.metrics(run, qrels)
