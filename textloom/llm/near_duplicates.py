"""Near-duplicate records with small edits: BK-trees over set fingerprints.

A record is the set of its sequences of ``WIDTH`` consecutive words, and two records are similar if
their sets' Jaccard similarity is ``threshold`` or more.  The fingerprint of a set is a bitmap in which
every member flips one bit, so that the Hamming distance of two fingerprints never exceeds the size of
the sets' symmetric difference.  As Jaccard >= t is the same as |A ^ B| <= (|A| + |B|)(1 - t)/(1 + t), a
search of that integer radius in a BK-tree of fingerprints loses no similar pair of the tree.  A fingerprint has some
``SPARSE`` bits for each member, so that unrelated sets stay far apart; as its halves can be laid over each other, the sets of one
tree are compared at the length of the shortest.

Shards say which records share a tree, and lose no pair: in an order of all sequences, rare ones first (by a count sketch of fixed
size), similar sets share one of their first |A| - t|A| + 1, so a shard is the records that have a sequence among these.  Shards with the
same records are one, and shards of one record none; fingerprints only travel to what remains.  In a shard the first level of the trees is the sets' size, in
steps of ``STEP``, and a query only visits the sizes it may be similar to, with the radius that the size allows; below it, edges are
integer Hamming distances, and only those within the radius are followed.  A shard's trees are built in the task that holds the shard, as the trees of
a whole collection have no bounded size to be broadcast.  A shard of more than ``SHARD`` records is cut into blocks, each with trees of its own which the
records of all its blocks search.  What the trees find is compared exactly.

Records with the same set are one node: its smallest identifier; the others are led to it by
``members``.

Defined results: records without ``WIDTH`` words (null, blank) are in no set and no pair; rows sent
twice are members of one node; ties don't occur, as all pairs are returned; empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize

WIDTH, THRESHOLD = 3, 0.5
#: Bits of a fingerprint for each member, and its least number of bits.
SPARSE, LEAST_BITS = 8, 256
#: Ratio between the sizes that share a first-level edge.
STEP = 1.15
SHARD = 20_000
#: Counters of the sketch that orders sequences; a bound of what is sent to the tasks (one byte each).
SKETCH = 1 << 22
#: (query, node) pairs held at once by a search.
FRONTIER = 2_000_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SEEN: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def word_sequences(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` consecutive words."""
    if len(_SEEN) > 500_000:
        _SEEN.clear()
    hashed = np.array([_SEEN.get(w) or _SEEN.setdefault(w, xxhash.xxh64_intdigest(w)) for w in _WORD.findall(text.lower())], np.uint64)
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = _mix(h * _M3 + hashed[k : k + n])
    return np.unique(h)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, sets = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = word_sequences(text or "", width)
                if len(s) and i is not None:
                    ids.append(i)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sets.append(s.view(np.int64))
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "key", "members"])

    return run


def fingerprint(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of a power of two of bits, at least ``SPARSE`` for each member."""
    bits = max(LEAST_BITS, 1 << (SPARSE * len(s) - 1).bit_length())
    return np.packbits(np.bincount((_mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).view(np.uint64)


def folded(prints: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint laid over itself to ``words`` words of 64 bits; what a shorter bitmap of the same set would be."""
    while len(prints) > words:
        half = len(prints) // 2
        prints = prints[:half] ^ prints[half:]
    return prints


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, bounds) of a column of hashes."""
    return column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for b in batches:
        counts += np.bincount((_lists(b.column(0))[0] % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    slot = np.flatnonzero(counts > 1)  # once in a task: as good as rare
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "n"])


def _prefixes(threshold: float, levels_b):
    """(shard, id, size, first): the members that a similar set has one of; first: among those that a larger one has one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = levels_b.value
        for b in batches:
            flat, at = _lists(b.column(1))
            size = np.diff(at)
            owner = np.repeat(np.arange(len(b)), size)
            order = np.lexsort((flat, levels[(flat % np.uint64(SKETCH)).astype(np.int64)], owner))
            place = np.arange(len(flat)) - np.repeat(at[:-1], size)
            first = place <= np.repeat(size - np.ceil(threshold * size - 1e-9).astype(np.int64), size)
            # a set no larger than its partner shares one of its first |A| - 2t/(1 + t)|A| + 1
            small = (place <= np.repeat(size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64), size))[first]
            shard, owner = flat[order][first].view(np.int64), owner[first]
            ids = b.column(0).to_numpy()
            for k in range(0, len(shard), 50_000):
                o = owner[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(shard[k : k + 50_000]), pa.array(ids[o]), pa.array(size[o].astype(np.int32)), pa.array(small[k : k + 50_000])], names=["shard", "id", "size", "first"])

    return run


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, at = _lists(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(flat[at[k] : at[k + 1]]).tobytes() for k in range(len(b))], pa.binary())], names=["id", "print"])


class BKForest:
    """BK-trees, one for each value of ``tree`` (sorted), in arrays.

    A node's children are keyed by their integer Hamming distance to it; fingerprints equal to a
    node's are kept with it.  Built level by level: of the items below a node at one distance, the first
    becomes the child and the others go below it.
    """

    def __init__(self, prints: np.ndarray, tree: np.ndarray) -> None:
        self.prints, n = prints, len(prints)
        self.edge, self.parent, self.home = np.zeros(n, np.int64), np.full(n, -1), np.arange(n)
        self.root = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[self.root, n])
        self.root_of = np.repeat(self.root, size)
        below, item = self.root_of.copy(), np.arange(n)
        keep = below != item
        below, item = below[keep], item[keep]
        while len(item):
            d = np.bitwise_count(prints[item] ^ prints[below]).sum(axis=1, dtype=np.int64)
            self.home[item[d == 0]] = below[d == 0]
            item, below, d = item[d > 0], below[d > 0], d[d > 0]
            order = np.lexsort((item, d, below))
            item, below, d = item[order], below[order], d[order]
            first = np.r_[True, (below[1:] != below[:-1]) | (d[1:] != d[:-1])][: len(item)]
            child = item[first]
            self.parent[child], self.edge[child] = below[first], d[first]
            below = np.repeat(child, np.diff(np.r_[np.flatnonzero(first), len(item)]))
            item, below = item[~first], below[~first]
        node = np.flatnonzero(self.parent >= 0)
        self.children = node[np.argsort(self.parent[node], kind="stable")]
        self.child_at = np.searchsorted(self.parent[self.children], np.arange(n + 1))
        self.kept = np.argsort(self.home, kind="stable")
        self.kept_at = np.searchsorted(self.home[self.kept], np.arange(n + 1))

    @staticmethod
    def _spread(at: np.ndarray, values: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in node, value) of all values that nodes have."""
        size = at[node + 1] - at[node]
        which = np.repeat(np.arange(len(node)), size)
        return which, values[np.repeat(at[node] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def search(self, query: np.ndarray, prints: np.ndarray, start: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, item, distance) within the radius of each entry (query, root); follows only edges that can hold one."""
        node = start
        self.visited = 0
        while len(node):
            self.visited += len(node)
            d = np.bitwise_count(prints[query] ^ self.prints[node]).sum(axis=1, dtype=np.int64)
            near = d <= radius
            which, item = self._spread(self.kept_at, self.kept, node[near])
            yield query[near][which], item, d[near][which]
            which, child = self._spread(self.child_at, self.children, node)
            follow = np.abs(self.edge[child] - d[which]) <= radius[which]
            query, node, radius = query[which[follow]], child[follow], radius[which[follow]]


def within(threshold: float, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The largest symmetric difference that sets of these sizes may have."""
    return np.floor((size_a + size_b) * (1 - threshold) / (1 + threshold) + 1e-9)


def search_shards(shard: np.ndarray, ids: np.ndarray, size: np.ndarray, prints: np.ndarray, threshold: float, home: np.ndarray | None = None, work: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller, larger identifier) that may be similar, as they are found; shard is sorted, prints of one length.

    home: if given, only pairs of one true and one false.  work: gets the nodes visited.
    """
    step = np.floor(np.log(np.maximum(size, 1)) / np.log(STEP)).astype(np.int64)
    order = np.lexsort((ids, step, shard))
    shard, ids, size, prints, step = shard[order], ids[order], size[order], prints[order], step[order]
    home = None if home is None else home[order]
    edge = np.r_[True, (shard[1:] != shard[:-1]) | (step[1:] != step[:-1])][: len(shard)]
    forest = BKForest(prints, np.cumsum(edge))
    root_shard, root_step = shard[forest.root], step[forest.root]
    most = np.maximum.reduceat(size, forest.root) if len(size) else size
    least = np.minimum.reduceat(size, forest.root) if len(size) else size
    # every record searches the first-level edges of its shard whose sizes it may be similar to
    begin, end = np.searchsorted(root_shard, shard, "left"), np.searchsorted(root_shard, shard, "right")
    bounds = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    rows = np.diff(np.r_[bounds, len(shard)])
    load = np.cumsum(np.repeat(rows, rows))  # nodes that the queries up to here can visit
    at = 0
    while at < len(shard):
        stop = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + FRONTIER, side="right")))
        q = np.arange(at, stop)
        n = end[q] - begin[q]
        query = np.repeat(q, n)
        root = np.repeat(begin[q] - np.cumsum(n) + n, n) + np.arange(n.sum())
        fits = (most[root] >= threshold * size[query] - 1e-9) & (threshold * least[root] <= size[query] + 1e-9)
        query, root = query[fits], root[fits]
        radius = within(threshold, size[query], most[root])
        for a, item, d in forest.search(query, prints, forest.root[root], radius):
            keep = (ids[a] < ids[item]) & (d <= within(threshold, size[a], size[item])) & (np.minimum(size[a], size[item]) >= threshold * np.maximum(size[a], size[item]) - 1e-9)
            if home is not None:
                keep &= home[a] != home[item]
            if keep.any():
                yield ids[a[keep]], ids[item[keep]]
        if work is not None:
            work.append(forest.visited)
        at = stop


def _whole_groups(work, keys: tuple[str, ...], hold: int):
    """A task over sorted rows: ``work`` gets tables of whole groups of about ``hold`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= hold:
                t = pa.Table.from_batches(held).combine_chunks()
                other = np.zeros(len(t), bool)
                for k in keys:
                    v = t.column(k).to_numpy()
                    other |= v != v[-1]
                cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last group may go on
                if cut:
                    yield from work(t.slice(0, cut).combine_chunks())
                held, n = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


def _met(group: np.ndarray, size: np.ndarray, first: np.ndarray, threshold: float) -> np.ndarray:
    """Rows with a partner of fitting size in their group, the smaller one being ``first``; sorted by group, size, first ones before."""
    n = len(group)
    place = np.arange(n)
    before = np.r_[-1, np.maximum.accumulate(np.where(first, place, -1))[:-1]]  # the last first one before
    at = np.maximum(before, 0)
    behind = (before >= 0) & (group[at] == group) & (size[at] >= threshold * size - 1e-9)
    nxt = np.minimum(place + 1, n - 1)
    return behind | (first & (nxt > place) & (group[nxt] == group) & (threshold * size[nxt] <= size + 1e-9))


def _alike(threshold: float):
    """(shard, block, id, size, home) of records that meet another in a shard; shards with the same records are one."""
    return lambda t: _meetings(t, threshold)


def _meetings(t: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    shard, block, ids, size = (t.column(c).to_numpy() for c in ("shard", "block", "id", "size"))
    home, first = (t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "first"))
    group = np.cumsum(np.r_[True, (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])])
    order = np.lexsort((~first, size, group))
    order = order[_met(group[order], size[order], first[order], threshold)]
    if not len(order):
        return
    shard, block, ids, size, home = shard[order], block[order], ids[order], size[order], home[order]
    edge = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])])
    n = np.diff(np.r_[edge, len(shard)])
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(_mix(ids.view(np.uint64) + np.uint64(1)) * np.where(home, _M1, _M2), edge)  # a sum: order doesn't matter
    whole = np.where(block[edge] == 0, whole, _mix(whole + shard[edge].view(np.uint64)))  # blocks stay apart
    _, at = np.unique(whole, return_index=True)
    keep = np.zeros(len(edge), bool)
    keep[at] = True
    keep &= n > 1
    rows = np.repeat(keep, n)
    name = np.repeat(whole.view(np.int64), n)[rows]
    block, ids, size, home = block[rows], ids[rows], size[rows], home[rows]
    for k in range(0, len(ids), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in (name, block, ids, size, home)], names=["shard", "block", "id", "size", "home"])


def _search_task(threshold: float):
    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, block, ids, size = (t.column(c).to_numpy() for c in ("shard", "block", "id", "size"))
        home = t.column("home").to_numpy(zero_copy_only=False)
        prints = [np.frombuffer(p, np.uint64) for p in t.column("print").to_pylist()]
        edge = np.r_[True, (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])]
        tree = np.cumsum(edge) - 1
        words = np.minimum.reduceat(np.array([len(p) for p in prints]), np.flatnonzero(edge))[tree]  # the shortest of the tree
        for w in np.unique(words):
            for cross in (False, True):  # two different blocks of a large shard: only pairs across
                part = np.flatnonzero((words == w) & ((block < 0) == cross))
                if len(part):
                    same = np.stack([folded(prints[k], w) for k in part])
                    for a, b in search_shards(tree[part], ids[part], size[part].astype(np.int64), same, threshold, home[part] if cross else None):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return _whole_groups(work, ("shard", "block"), 20_000)


def similar_records(df: DataFrame, id_col: str, text: Column, threshold: float = THRESHOLD, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (id_a, id_b, similarity) of nodes, members (node, id) of every record with a set."""
    spark = df.sparkSession
    sets = materialize(df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).mapInArrow(_sets(width), "id bigint, key binary, members array<bigint>"), "sets")
    node = sets.groupBy("key").agg(F.min("id").alias("node"))
    members = materialize(sets.select("key", "id").join(node, "key").select("node", "id"), "members")
    nodes = sets.join(members.where("node = id").select("id"), "id", "left_semi").select("id", "members")
    nodes = materialize(nodes, "nodes")
    discard(sets)
    counts = nodes.select("members").mapInArrow(_sketch, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most ``SKETCH`` rows
    levels = np.zeros(SKETCH, np.uint8)
    levels[counts.column("slot").to_numpy()] = np.ceil(np.log2(counts.column("n").to_numpy() + 1)).astype(np.uint8)
    shards = nodes.mapInArrow(_prefixes(threshold, spark.sparkContext.broadcast(levels)), "shard bigint, id bigint, size int, first boolean")
    rows = shards.select("shard", F.lit(0).alias("block"), "id", "size", "first", F.lit(True).alias("home"))
    if levels.max(initial=0) >= SHARD.bit_length():  # only then can a shard be large
        large = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("shard", F.ceil(F.col("n") / SHARD).cast("int").alias("blocks"))
        cut = shards.join(large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        i, j = F.least(F.col("own"), F.col("other")), F.greatest(F.col("own"), F.col("other"))
        block = F.when(F.col("own") == F.col("other"), F.col("own") + F.when(F.col("blocks") > 1, 1).otherwise(0)).otherwise(-1 - (i * F.col("blocks") + j))
        rows = cut.select("shard", block.cast("int").alias("block"), "id", "size", "first", (F.col("own") == i).alias("home"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    alike = rows.repartition(n, "shard", "block").sortWithinPartitions("shard", "block").mapInArrow(_whole_groups(_alike(threshold), ("shard", "block"), 200_000), "shard bigint, block int, id bigint, size int, home boolean")
    alike = alike.dropDuplicates(["shard", "block", "id"])
    prints = nodes.mapInArrow(_prints, "id bigint, print binary")
    trees = alike.join(prints, "id").repartition(n, "shard", "block").sortWithinPartitions("shard", "block", "id")
    found = materialize(trees.select("shard", "block", "id", "size", "home", "print").mapInArrow(_search_task(threshold), "a bigint, b bigint").distinct(), "found")
    with_a = found.join(nodes.select(F.col("id").alias("a"), F.col("members").alias("m_a")), "a")
    both = with_a.join(nodes.select(F.col("id").alias("b"), F.col("members").alias("m_b")), "b")
    shared = F.size(F.array_intersect("m_a", "m_b"))
    pairs = both.select("a", "b", shared.alias("s"), (F.size("m_a") + F.size("m_b")).alias("n"))
    pairs = pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), (F.col("s") / (F.col("n") - F.col("s"))).alias("similarity")).where(F.col("similarity") >= threshold)
    return pairs, members


def similar_pairs(df: DataFrame, id_col: str, text: Column, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(id_a, id_b) of all records, copies written out, id_a < id_b."""
    pairs, members = similar_records(df, id_col, text, threshold, width)
    a, b = (members.select(F.col("node").alias(f"id_{x}"), F.col("id").alias(x)) for x in "ab")
    across = pairs.join(a, "id_a").join(b, "id_b").select("a", "b")
    inside = members.select("node", F.col("id").alias("a")).join(members.select("node", F.col("id").alias("b")), "node").where("a < b").select("a", "b")
    return across.unionByName(inside).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def groups(df: DataFrame, id_col: str, text: Column, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(group_id, id, links): every record in pairs or copies, by the smallest record it hangs together with."""
    from .components import components

    pairs, members = similar_records(df, id_col, text, threshold, width)
    pairs = materialize(pairs, "pairs")
    links = pairs.select(F.col("id_a").alias("node")).unionAll(pairs.select(F.col("id_b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    group = components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    copies = members.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    out = members.join(copies, "node").join(links, "node", "left").join(group, "node", "left")
    return out.where("copies > 1 or links > 0").select(F.coalesce("group_id", "node").alias("group_id"), "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
