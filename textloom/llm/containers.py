"""Filling fixed-capacity containers: minimum bin slack over the histogram of lengths.

Items of one length are interchangeable, so the packing is planned on the number of items of each
length, at most ``capacity`` numbers whatever the collection's size.  The planner opens a window at
the longest length left and picks, by a subset-sum dynamic programme on a bitset, the multiset of
remaining lengths whose sum comes closest to the room left; the counts are backtracked through the
stored layers.  The pattern found is used as often as the remaining counts allow.

Size of the plan: each pattern leaves one of its lengths l with fewer items than it needs, so fewer
than capacity / l.  A length gets there once, and a later pattern limited by it uses up an item of it, so
there are at most capacity + sum(capacity / l) < capacity * (2 + ln capacity) patterns (19 700 for
2048), however many items there are.  This is what is held by the driver and broadcast.

Items are numbered within their length without gathering a length in one task: by a hash bucket,
counted, summed up over buckets, and numbered inside the bucket.

Defined results: null and empty texts need no room, their container is null; a longer text is cut at
token boundaries into full pieces and one rest, the only splits there are; repeated rows are items of
their own (they need identifiers of their own); no items give no containers.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, parallelism

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern of the vocabulary's tokenizer (fixed value).
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts go to the tokenizer in stretches of about this many characters, cut before a blank that follows a letter or digit.
STRETCH = 100_000
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, made once for each worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def stretches(text: str, length: int = STRETCH) -> Iterator[str]:
    """Parts of a text that are tokenized alone as in the whole: a blank after a word begins a new token."""
    a = 0
    while len(text) - a > length:
        b = a + length
        while b < len(text) and not (text[b] == " " and text[b - 1].isalnum() and b + 1 < len(text) and text[b + 1].isalpha()):
            b += 1
        yield text[a:b]
        a = b
    if a < len(text):
        yield text[a:]


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [sum(len(enc.encode_ordinary(s)) for s in stretches(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["item", "tokens"])

    return run


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("item"), text_col).mapInArrow(_sizes(tokenizer), "item bigint, tokens bigint")


def best_fill(lengths: list[int], counts: Counter[int] | dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (with these counts) whose sum is as near to ``room`` as can be."""
    mask, reached = (1 << (room + 1)) - 1, 1
    layers: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left > 0:
            part = min(part, left)
            layers.append((reached, length, part))
            reached |= (reached << (length * part)) & mask
            left, part = left - part, part * 2
        if reached >> room & 1:
            break
    at, used = reached.bit_length() - 1, Counter()
    for before, length, part in reversed(layers):
        if not before >> at & 1:  # reached only with this part
            used[length] += part
            at -= length * part
    return dict(used)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, containers, items of each length in each) for every pattern."""
    left = {length: n for length, n in histogram.items() if n > 0 and 0 < length <= capacity}
    lengths, out, container = sorted(left, reverse=True), [], 0
    while lengths:
        anchor = lengths[0]
        left[anchor] -= 1
        fill = Counter(best_fill(lengths, left, capacity - anchor))
        left[anchor] += 1
        fill[anchor] += 1
        times = min(left[length] // n for length, n in fill.items())
        out.append((container, times, dict(fill)))
        container += times
        for length, n in fill.items():
            left[length] -= n * times
        lengths = [length for length in lengths if left[length]]
    return out


def _assigner(plan_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, needs, firsts = plan_b.value
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("n_tokens", "rank"))
            out = np.zeros(len(size), np.int64)
            for length in np.unique(size):
                own = size == length
                k = np.searchsorted(starts[length], rank[own], side="right") - 1
                out[own] = firsts[length][k] + (rank[own] - starts[length][k]) // needs[length][k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out)], names=["item", "piece", "first_token", "n_tokens", "container"])

    return run


def pack(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, piece, first_token, n_tokens, container) of ``sized`` (item, tokens)."""
    spark = sized.sparkSession
    sized = materialize(sized, "sizes")
    last = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    pieces = sized.where("tokens > 0").select("item", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    pieces = pieces.select("item", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - first).alias("n_tokens"))
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    starts: dict[int, list[int]] = {}
    needs: dict[int, list[int]] = {}
    firsts: dict[int, list[int]] = {}
    for container, times, fill in plan(histogram, capacity):
        for length, n in fill.items():
            s = starts.setdefault(length, [0])
            needs.setdefault(length, []).append(n)
            firsts.setdefault(length, []).append(container)
            s.append(s[-1] + n * times)
    table = spark.sparkContext.broadcast(tuple({k: np.array(v, np.int64) for k, v in x.items()} for x in (starts, needs, firsts)))
    buckets = 8 * parallelism(spark)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)))
    counts = pieces.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr("n_tokens", "bucket", "sum(n) over (partition by n_tokens order by bucket rows between unbounded preceding and current row) - n as before")
    ranked = pieces.selectExpr("*", "row_number() over (partition by n_tokens, bucket order by item, piece) - 1 as own")
    ranked = ranked.join(before, ["n_tokens", "bucket"]).select("item", "piece", "first_token", "n_tokens", (F.col("before") + F.col("own")).alias("rank"))
    packed = ranked.mapInArrow(_assigner(table), "item bigint, piece int, first_token bigint, n_tokens bigint, container bigint")
    empty = sized.where("tokens = 0").selectExpr("item", "0 as piece", "0L as first_token", "0L as n_tokens", "cast(null as bigint) as container")
    return packed.unionByName(empty)


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack(token_counts(df, id_col, text_col, tokenizer), capacity)
