"""Evaluation texts leaking into training text: suffix arrays over the training side.

Documents are cut into words and gathered in shards of bounded size, each with a suffix array over
its words.  Every suffix of every test passage is searched in it by binary search; the longest
verbatim match and all places with at least ``min_words`` words in common are read off the
neighbourhood of the place found.  Test passages are the small side: they are sent to all tasks as
long as they have at most ``MAX_TEST_WORDS`` words, and in blocks of that size beyond.

Words that no test passage has can't be part of a match, so a shard only keeps runs of ``min_words``
or more known words; that leaves the matches as they are.

Defined results: null or short passages and texts match nothing; a passage under several items
leaks for each of them; a repeated document is found each time; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 13
#: Words of test passages held by a task at once; more are searched in further rounds.
MAX_TEST_WORDS = 2_000_000
#: Known words gathered in one suffix array; a longer document has one of its own.
SHARD_WORDS = 400_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_HIT = "qid bigint, doc_id bigint, matched_words int, test_start int, doc_start int"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def suffix_array(a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``a`` beginning there, by prefix doubling."""
    rank, k = np.unique(a, return_inverse=True)[1].astype(np.int64) + 1, 1
    n = len(a)
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:]
        key = rank * (int(rank.max(initial=1)) + 1) + second
        distinct, new = np.unique(key, return_inverse=True)
        same, rank, k = len(distinct) == n or k > n, new.astype(np.int64) + 1, 2 * k
        if same:
            return starts[np.argsort(rank[starts], kind="stable")]


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of a[i:] and b[j:], elementwise; a and b end with differing negatives."""
    out, live = np.zeros(len(i), np.int64), np.arange(len(i))
    step = 0
    while len(live):
        live = live[a[np.minimum(i[live] + step, len(a) - 1)] == b[np.minimum(j[live] + step, len(b) - 1)]]
        out[live] += 1
        step += 1
    return out


class TestSide:
    """Test passages as one array of word numbers, each passage closed by a number of its own."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        arrays, qid, start, rest, closing = [], [], [], [], -2
        for q, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            arrays.append(np.array([*w, closing], np.int64))
            closing -= 2  # even negatives close passages, odd ones documents
            qid.append(np.full(len(w) + 1, q, np.int64))
            start.append(np.arange(len(w) + 1))
            rest.append(np.arange(len(w), -1, -1))
        self.a = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        self.qid, self.start, self.rest = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (qid, start, rest))


def _search(test: TestSide, a: np.ndarray, where: np.ndarray, doc: np.ndarray, min_words: int) -> pd.DataFrame:
    """Matches of every test suffix in one shard: a are its words, where and doc the place and document of each."""
    probe = np.flatnonzero(test.rest >= min_words)
    starts = np.flatnonzero(a > 0)
    empty = pd.DataFrame({k: np.zeros(0, np.int64) for k in ("qid", "doc_id", "matched_words", "test_start", "doc_start")})
    if not len(probe) or not len(starts):
        return empty
    sa = suffix_array(a, starts)
    low, high = np.zeros(len(probe), np.int64), np.full(len(probe), len(sa), np.int64)
    while (open_ := low < high).any():
        at, mid = probe[open_], (low[open_] + high[open_]) // 2
        n = _common(test.a, at, a, sa[mid])
        less = a[np.minimum(sa[mid] + n, len(a) - 1)] < test.a[np.minimum(at + n, len(test.a) - 1)]
        low[open_] = np.where(less, mid + 1, low[open_])
        high[open_] = np.where(less, high[open_], mid)
    # suffixes that share min_words words lie together; a group is a run of them
    near = _common(a, sa[:-1], a, sa[1:]) >= min_words
    group = np.r_[0, np.cumsum(~near)]
    first = np.flatnonzero(np.r_[True, ~near])
    last = np.r_[first[1:], len(sa)]
    hits = []
    for side in (low - 1, low):
        inside = (side >= 0) & (side < len(sa))
        p, s = probe[inside], side[inside]
        full = _common(test.a, p, a, sa[s]) >= min_words
        hits.append(pd.DataFrame({"probe": p[full], "group": group[s[full]]}))
    found = pd.concat(hits).drop_duplicates()
    if not len(found):
        return empty
    size = (last - first)[found.group.to_numpy()]
    p = np.repeat(found.probe.to_numpy(), size)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    s = sa[np.repeat(first[found.group.to_numpy()], size) + offset]
    out = pd.DataFrame({"qid": test.qid[p], "doc_id": doc[s], "matched_words": _common(test.a, p, a, s), "test_start": test.start[p], "doc_start": where[s]})
    out = out[out.matched_words >= min_words].sort_values(["matched_words", "test_start", "doc_start"], ascending=[False, True, True], kind="stable")
    return out.drop_duplicates(["qid", "doc_id"])


def _runs(w: np.ndarray, min_words: int) -> np.ndarray:
    """Places of ``w`` in runs of at least ``min_words`` known words."""
    edge = np.flatnonzero(np.diff(np.r_[False, w > 0, False].astype(np.int8)))
    keep = edge[1::2] - edge[::2] >= min_words
    lengths = (edge[1::2] - edge[::2])[keep]
    offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(edge[::2][keep], lengths) + offset


def _searcher(test_b, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: TestSide = test_b.value
        known = test.vocabulary.get
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, closing = 0, -1

        def shard() -> pa.RecordBatch:
            a, where, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            found = _search(test, a, where, doc, min_words)
            return pa.RecordBatch.from_pandas(found.astype({"matched_words": "int32", "test_start": "int32", "doc_start": "int32"}), preserve_index=False)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text or doc is None:
                    continue
                w = np.array([known(x, 0) for x in words(text)], np.int64)
                at = _runs(w, min_words)
                if len(at):
                    cut = np.flatnonzero(np.diff(at) > 1) + 1  # a closing number after each run
                    a = np.insert(w[at], [*cut, len(at)], closing - 2 * np.arange(len(cut) + 1))
                    where = np.insert(at, [*cut, len(at)], -1)
                    closing -= 2 * (len(cut) + 1)
                    parts.append((a, where, np.full(len(a), doc, np.int64)))
                    held += len(a)
                if held >= SHARD_WORDS:
                    yield shard()
                    parts, held = [], 0
        if parts:
            yield shard()

    return run


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", qid: str = "qid", passage: str = "description") -> DataFrame:
    """(qid, doc_id, matched_words, test_start, doc_start): the longest match of each item and document, places in words."""
    spark = documents.sparkSession
    rows = items.where(F.col(qid).isNotNull() & F.col(passage).isNotNull()).select(F.col(qid).cast("bigint"), passage)
    blocks: list[list[tuple[int, str]]] = [[]]
    held = 0
    for q, p in rows.toLocalIterator():  # the held-out side, in blocks of bounded size
        held += len(p) // 2
        if held > MAX_TEST_WORDS and blocks[-1]:
            blocks.append([])
            held = len(p) // 2
        blocks[-1].append((q, p))
    docs = documents.select(F.col(doc_id).cast("bigint"), text)
    out = None
    for block in blocks:
        found = docs.mapInArrow(_searcher(spark.sparkContext.broadcast(TestSide(block)), min_words), _HIT)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("matched_words", "test_start", "doc_start"), F.struct("matched_words", -F.col("test_start"), -F.col("doc_start")))
    return out.groupBy("qid", "doc_id").agg(best.alias("m")).select("qid", "doc_id", "m.*")


def clean(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` without those that hold a passage."""
    return documents.join(leaks(documents, items, min_words).select("doc_id").distinct(), "doc_id", "left_anti")
