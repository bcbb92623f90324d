"""Grouping records into clusters of mutually similar vectors.

1. Rows with the same class and vector are one node.
2. An approximate nearest-neighbour graph is built by neighbour descent: leaves of a few random-hyperplane
   forests give the first neighbours, then neighbours of neighbours (with reverse ones) are compared until
   hardly a list improves.
3. Communities of the graph's edges of at least ``threshold`` are detected by modularity: nodes move to
   the neighbouring community of greatest gain until hardly one moves, communities are contracted and moved again, until a level
   moves none.
4. Every community has a representative, the member of highest internal weighted degree.  Modularity divides large
   groups, and the graph is approximate, so a representative that reaches the threshold with one of higher degree joins it, if that one joins no other
   itself; what is left is compared again, by the same descent over representatives, until no two reach it.  Nothing is chained:
   members whose cosine to their new representative is below the threshold stay with their former one's other
   members, or alone.
5. Degrees and sizes are those of the groups returned.

All vectors of a class are in one graph however skewed: leaves above ``LEAF`` rows are cut into chunks,
differently in each tree, and reverse neighbours are ranked and cut to the best ``REVERSE`` of a
round; what that leaves apart is joined by step 4.

Defined results: rows without class, or without 64 finite numbers not all zero, are in no group; rows
sent twice are members; ties of degree go to the smaller identifier; empty tables give no group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialize
from .similar_vectors import DIM, _fixed, pack, unit_rows, unpack

THRESHOLD = 0.8
NEIGHBOURS, REVERSE, TREES, LEAF = 8, 8, 4, 400
#: Share of the lists' places that may still change where the descent is settled, and rounds after which that must be so.
SETTLED, ROUNDS = 0.01, 50
#: Share of the nodes that may still move where communities count as settled, and rounds after which that must be so.
STILL, MOST_MOVES, RESOLUTION = 0.001, 400, 1.0
#: Edges, counted in both directions, that one task holds while their nodes move; more are moved by joins until fewer are left.
TOGETHER = 2_000_000
_NODE = "id bigint, class string, same binary, vec binary, scale float"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, x = unit_rows(b.column(2), DIM)
        packed, scale = pack(x) if len(x) else (np.zeros((0, DIM), np.int16), np.zeros(0, np.float32))
        where = pa.array(at)
        classes = b.column(1).take(where)
        same = pa.array([xxhash.xxh3_128_digest(v.tobytes() + c.encode()) for v, c in zip(x, classes.to_pylist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0).take(where), classes, same, _fixed(packed), pa.array(scale)], names=["id", "class", "same", "vec", "scale"])


def _leaves(bits: int, trees: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((trees * bits, DIM)).astype(np.float32)
        for b in batches:
            x = unpack(b.column(2).to_pylist(), b.column(3).to_numpy()) if len(b) else np.zeros((0, DIM), np.float32)
            side = (x @ planes.T > 0).reshape(len(x), trees, bits)
            number = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2) if bits else np.zeros((len(x), trees), np.int64)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(b), t, np.int32)), pa.array(number[:, t]), b.column(2), b.column(3)], names=["id", "class", "tree", "leaf", "vec", "scale"])

    return run


def _by_group(work, key_columns: int, hold: int = 20_000):
    """A task over rows sorted by their first columns; ``work`` gets tables of whole groups and the groups' bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bounds(t: pa.Table) -> np.ndarray:
            edge = np.zeros(len(t), bool)
            edge[:1] = True
            for c in range(key_columns):
                v = t.column(c).to_numpy()
                edge[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(edge)

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= hold:
                t = pa.Table.from_batches(held).combine_chunks()
                at = bounds(t)
                if len(at) > 1:
                    yield from work(t.slice(0, at[-1]).combine_chunks(), at)
                    held, n = t.slice(at[-1]).combine_chunks().to_batches(), len(t) - at[-1]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from work(t, np.r_[bounds(t), len(t)])

    return run


def _vectors(t: pa.Table) -> np.ndarray:
    return unpack(t.column("vec").to_pylist(), t.column("scale").to_numpy())


def _rows(a: list[np.ndarray], b: list[np.ndarray], cos: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if a:
        a, b, cos = np.concatenate(a), np.concatenate(b), np.concatenate(cos).astype(np.float32)
        for s in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 50_000]) for x in (a, b, cos)], names=["a", "b", "cos"])


def _leaf_neighbours(k: int):
    def work(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, ids = _vectors(t), t.column("id").to_numpy()
        a, b, cos = [], [], []
        for s, e in zip(at[:-1], at[1:], strict=True):
            width = min(k, e - s - 1)
            for q in range(s, e if width > 0 else s, 1000):
                sims = x[q : min(q + 1000, e)] @ x[s:e].T
                n = len(sims)
                sims[np.arange(n), np.arange(q - s, q - s + n)] = -2
                near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
                a.append(np.repeat(ids[q : q + n], width))
                b.append(ids[s:e][near].ravel())
                cos.append(np.take_along_axis(sims, near, 1).ravel())
        yield from _rows(a, b, cos)

    return work


def _local_join(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of a node's neighbours that would improve the list of one of them."""
    x, ids, least = _vectors(t), t.column("v").to_numpy(), t.column("least").to_numpy()
    a, b, cos = [], [], []
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s < 2:
            continue
        sims = x[s:e] @ x[s:e].T
        np.fill_diagonal(sims, -2)
        i, j = np.nonzero(sims > least[s:e, None] + 1e-6)
        a.append(ids[s:e][i])
        b.append(ids[s:e][j])
        cos.append(sims[i, j])
    yield from _rows(a, b, cos)


def _best(pairs: DataFrame, by: str, other: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cos"), other))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def neighbour_graph(nodes: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, rounds: int = ROUNDS, leaf: int = LEAF, seed: int = 5) -> DataFrame:
    """(a, b, cos): up to ``k`` nearest nodes of the same class for each node; nodes (id, class, vec, scale), materialized."""
    n = nodes.count()
    bits = min(24, max(0, math.ceil(math.log2(max(n, 1) / leaf))))
    leaves = nodes.select("id", "class", "vec", "scale").mapInArrow(_leaves(bits, trees, seed), "id bigint, class string, tree int, leaf bigint, vec binary, scale float")
    keyed = leaves.select(F.xxhash64("class", "tree", "leaf").alias("key"), "class", "id", "tree", "vec", "scale")
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf).select("key", F.ceil(F.col("n") / leaf).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("id", "tree"), F.coalesce("chunks", F.lit(1))).cast("int")
    spread = keyed.join(large, "key", "left").select("key", chunk.alias("chunk"), "id", "vec", "scale")
    first = spread.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(_by_group(_leaf_neighbours(k), 2), "a bigint, b bigint, cos float")
    graph = materialize(_best(first.groupBy("a", "b").agg(F.max("cos").alias("cos")), "a", "b", k), "graph")
    for _ in range(rounds):
        back = _best(graph.select(F.col("b").alias("u"), F.col("a").alias("v"), "cos"), "u", "v", REVERSE).select("u", "v")
        around = graph.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(back).distinct()
        # a list with room takes any neighbour
        least = graph.groupBy(F.col("a").alias("v")).agg(F.when(F.count(F.lit(1)) >= k, F.min("cos")).otherwise(F.lit(-2.0).cast("float")).alias("least"))
        known = nodes.select(F.col("id").alias("v"), "vec", "scale").join(least, "v", "left").withColumn("least", F.coalesce("least", F.lit(-2.0).cast("float")))
        met = around.join(known, "v").select("u", "v", "vec", "scale", "least").repartition("u").sortWithinPartitions("u")
        better = met.mapInArrow(_by_group(_local_join, 1), "a bigint, b bigint, cos float")
        merged = graph.withColumn("new", F.lit(0)).unionByName(better.withColumn("new", F.lit(1))).groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
        merged = materialize(_best(merged, "a", "b", k), "graph")
        changed = merged.agg(F.sum("new").alias("s")).first()["s"] or 0
        discard(graph)
        graph = merged.drop("new")
        if changed <= SETTLED * n * k:
            return graph
    raise RuntimeError(f"neighbour descent isn't settled after {rounds} rounds")


def _turns(ids: np.ndarray, x: int) -> np.ndarray:
    """Lowest bit of Spark's xxhash64(id, x) for identifiers of 64 bits and an x of 32."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(h: np.ndarray, n: int) -> np.ndarray:
        return (h << np.uint64(n)) | (h >> np.uint64(64 - n))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    h = mixed(turned((np.full(1, 50, np.uint64) + p5) ^ (turned(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
    h = mixed(turned((h + p5 + np.uint64(4)) ^ (np.full(1, x & 0xFFFFFFFF, np.uint64) * p1), 23) * p2 + p3)
    return (h & np.uint64(1)).astype(np.int64)


def _moved_together(level: int, total: float, resolution: float, still: float, most: int):
    """A task over all edges (a, b, w) left: the moves and levels of ``communities``; (node, community, null), or (null, level, nodes that still move)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in x.columns] for x in batches]
        a, b, w = (np.concatenate([x[i] for x in parts]) for i in range(3)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        known = np.unique(a)
        ids, of_node, a, b = known, np.arange(len(known)), np.searchsorted(known, a), np.searchsorted(known, b)
        at, moved_any = level, True
        while moved_any:
            n = len(ids)
            k, c, links = np.bincount(a, w, n), np.arange(n), a != b  # numbers of communities are in the order of their identifiers
            la, lb, lw = a[links], b[links], w[links]
            move, recent, moved_any = 0, [], False
            while len(recent) < 2 or sum(recent[-2:]) > still * n:
                if move >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([at]), pa.array([sum(recent[-2:])])], ["node", "community", "moving"])
                    return
                tot = np.bincount(c, k, n)
                here = (_turns(ids, move // 2 + 1000 * at) == move % 2)[la]
                key, row = np.unique(la[here] * n + c[lb[here]], return_inverse=True)
                inside = np.bincount(row, lw[here], len(key))
                node, to = np.divmod(key, max(n, 1))
                own = c[node] == to
                gain = inside - resolution * k[node] * (tot[to] - np.where(own, k[node], 0.0)) / max(total, 1e-9)
                stay = -resolution * k * (tot[c] - k) / max(total, 1e-9)
                stay[node[own]] = gain[own]
                order = np.lexsort((to, -gain, node))
                first = order[np.r_[True, node[order][1:] != node[order][:-1]]] if len(order) else order
                first = first[gain[first] > stay[node[first]] + 1e-9]
                c[node[first]] = to[first]
                recent.append(len(first))
                moved_any |= len(first) > 0
                move += 1
            if moved_any:
                left, c = np.unique(c, return_inverse=True)
                ids, of_node = ids[left], c[of_node]
                key, row = np.unique(c[a] * len(left) + c[b], return_inverse=True)
                w = np.bincount(row, w, len(key))
                a, b = np.divmod(key, max(len(left), 1))
            at += 1
        for s in range(0, len(known), 50_000):
            nodes = known[s : s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ids[of_node[s : s + 50_000]]), pa.nulls(len(nodes), pa.int64())], ["node", "community", "moving"])

    return run


def communities(edges: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """(node, community) by modularity; edges (a, b, w) in both directions, each once, w > 0.  Raises if the moves don't settle."""
    edges = materialize(edges, "weights")
    total = edges.agg(F.sum("w").alias("s")).first()["s"] or 0.0
    of_node = materialize(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("community")), "communities")
    level, moved_any = 0, True
    while moved_any:
        if edges.count() <= TOGETHER:
            ended = materialize(edges.select("a", "b", "w").coalesce(1).mapInArrow(_moved_together(level, total, resolution, STILL, MOST_MOVES), "node bigint, community bigint, moving bigint"), "moves")
            if failed := ended.where("node is null").first():
                raise RuntimeError(f"communities of level {failed['community']} don't settle: {failed['moving']} nodes still move")
            discard(edges)
            if level == 0:
                discard(of_node)
                return ended.select("node", "community")
            there = ended.select(F.col("node").alias("community"), F.col("community").alias("c"))
            return of_node.join(there, "community").select("node", F.col("c").alias("community"))
        degree = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
        where = materialize(degree.select("node", F.col("node").alias("c"), "k", F.lit(0).alias("moved")), "moves")
        nodes = where.count()
        links = edges.where("a <> b")
        move, recent, moved_any = 0, [], False
        while len(recent) < 2 or sum(recent[-2:]) > STILL * nodes:
            if move >= MOST_MOVES:
                raise RuntimeError(f"communities of level {level} don't settle: {recent[-2:]} of {nodes} nodes still move")
            sums = where.groupBy("c").agg(F.sum("k").alias("tot"))
            near = links.join(where.select(F.col("node").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("inside"))
            own = where.select(F.col("node").alias("a"), F.col("c").alias("now"), "k")
            options = near.unionByName(own.select("a", F.col("now").alias("c"), F.lit(0.0).alias("inside"))).groupBy("a", "c").agg(F.sum("inside").alias("inside"))
            gain = F.col("inside") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)) / F.lit(max(total, 1e-9))
            scored = options.join(own, "a").join(sums, "c").select("a", "c", "now", "k", gain.alias("gain"))
            best = scored.groupBy("a").agg(F.max(F.struct("gain", (-F.col("c")).alias("neg"))).alias("best"), F.max(F.when(F.col("c") == F.col("now"), F.col("gain"))).alias("stay"), F.first("now").alias("now"), F.first("k").alias("k"))
            # each half of the nodes moves in its round, other halves in every second round, so that two don't just change places
            turn = F.pmod(F.xxhash64("a", F.lit(move // 2 + 1000 * level)), F.lit(2)) == move % 2
            moves_on = turn & (F.col("best.gain") > F.col("stay") + 1e-9)
            after = materialize(best.select(F.col("a").alias("node"), F.when(moves_on, -F.col("best.neg")).otherwise(F.col("now")).alias("c"), "k", moves_on.cast("int").alias("moved")), "moves")
            discard(where)
            where = after
            recent.append(where.agg(F.sum("moved").alias("s")).first()["s"] or 0)
            moved_any |= recent[-1] > 0
            move += 1
        if moved_any:
            there = where.select("node", "c")
            wider = materialize(of_node.join(there.withColumnRenamed("node", "community"), "community").select("node", F.col("c").alias("community")), "communities")
            a, b = (there.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
            fewer = materialize(edges.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "weights")
            discard(of_node, edges)
            of_node, edges = wider, fewer
        discard(where)
        level += 1
    return of_node


def _cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with their cosine; vectors (id, vec, scale)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (unpack(b.column(v).to_pylist(), b.column(s).to_numpy()) if len(b) else np.zeros((0, DIM), np.float32) for v, s in ((2, 3), (4, 5)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * y).sum(axis=1).astype(np.float32))], names=["a", "b", "cos"])

    a, b = (vectors.select(F.col("id").alias(x), F.col("vec").alias(f"v{x}"), F.col("scale").alias(f"s{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "va", "sa", "vb", "sb").mapInArrow(run, "a bigint, b bigint, cos float")


def cluster(df: DataFrame, id_col: str, class_col: str, vec_col: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(groups, graph): groups (first_id, id, degree) of all usable rows, single ones too."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(class_col).cast("string").alias("class"), F.col(vec_col).cast("array<float>").alias("v"))
    units = materialize(rows.mapInArrow(_units, _NODE), "units")
    node = units.groupBy("same").agg(F.min("id").alias("node"))
    members = materialize(units.select("same", "id").join(node, "same").select("node", "id"), "members")
    nodes = materialize(units.join(members.where("node = id").select("id"), "id", "left_semi").select("id", "class", "vec", "scale"), "nodes")

    graph = neighbour_graph(nodes)
    strong = graph.where(F.col("cos") >= threshold)
    both = strong.select("a", "b", "cos").unionByName(strong.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    edges = materialize(both.groupBy("a", "b").agg(F.max("cos").cast("double").alias("w")), "edges")
    found = communities(edges)
    label = materialize(nodes.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("community", "node").alias("g")), "labels")
    placed = _represented(label, edges, nodes, threshold)
    placed = _joined(placed, edges, nodes, threshold)
    degree = _degrees(placed.select("node", F.col("chief").alias("g")), edges)
    out = members.join(placed, "node").join(degree, "node", "left").select(F.col("chief").alias("g"), "id", F.coalesce("degree", F.lit(0.0)).alias("degree"))
    out = materialize(out, "grouped")
    first = out.groupBy("g").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    return out.join(first, "g").select("first_id", "id", "degree", "size"), graph


def _degrees(label: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree): weighted degree within the node's group; label (node, g)."""
    a, b = (label.select(F.col("node").alias(x), F.col("g").alias(f"g{x}")) for x in "ab")
    return edges.join(a, "a").join(b, "b").where("ga = gb").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))


def _represented(label: DataFrame, edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, chief), materialized: the member of highest degree of each group; who doesn't reach it stands alone."""
    ranked = label.join(_degrees(label, edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    chief = ranked.groupBy("g").agg((-F.max(F.struct("degree", (-F.col("node")).alias("neg")))["neg"]).alias("chief"))
    return _kept(label.join(chief, "g").select("node", "chief"), nodes, threshold, F.col("node"))


def _kept(placed: DataFrame, nodes: DataFrame, threshold: float, otherwise: Column) -> DataFrame:
    """``placed`` (node, chief, ...) with ``otherwise`` as chief where the cosine is below the threshold, materialized."""
    placed = materialize(placed, "placed")
    near = _cosines(placed.where("node <> chief").select(F.col("node").alias("a"), F.col("chief").alias("b")), nodes)
    near = near.where(F.col("cos") >= threshold).select(F.col("a").alias("node"), F.col("b").alias("near"))
    kept = placed.join(near, "node", "left").select("node", F.when((F.col("node") == F.col("chief")) | F.col("near").isNotNull(), F.col("chief")).otherwise(otherwise).alias("chief"))
    return materialize(kept, "placed")


def _joined(placed: DataFrame, edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Representatives of lower degree led to those they reach, until none reaches another; then their members, where they reach it too."""
    rank = _degrees(placed.select("node", F.col("chief").alias("g")), edges)
    chiefs = placed.select(F.col("chief").alias("id")).distinct().join(rank.withColumnRenamed("node", "id"), "id", "left")
    chiefs = materialize(nodes.join(chiefs.select("id", F.coalesce("degree", F.lit(0.0)).alias("degree")), "id"), "chiefs")
    led = materialize(chiefs.select(F.col("id").alias("chief"), F.col("id").alias("top")), "led")
    rounds = 0
    while True:
        near = neighbour_graph(chiefs, trees=TREES + 4, seed=17 + rounds).where(F.col("cos") >= threshold).select("a", "b")
        if rounds == 0:  # the graph's own edges know some more
            ca, cb = (placed.select(F.col("node").alias(x), F.col("chief").alias(f"c{x}")) for x in "ab")
            linked = edges.join(ca, "a").join(cb, "b").where("ca < cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
            near = near.unionByName(_cosines(linked, chiefs).where(F.col("cos") >= threshold).select("a", "b"))
        near = materialize(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near")
        if near.isEmpty():
            break
        mine, other = (chiefs.select(F.col("id").alias(x), F.struct("degree", (-F.col("id")).alias("neg")).alias(f"r{x}")) for x in "ab")
        up = near.join(mine, "a").join(other, "b").where("rb > ra")
        heads = chiefs.select(F.col("id").alias("b")).join(up.select(F.col("a").alias("b")), "b", "left_anti")  # reach none of higher degree
        step = up.join(heads, "b", "left_semi").groupBy("a").agg((-F.max("rb")["neg"]).alias("to"))
        step = materialize(step.select(F.col("a").alias("top"), "to"), "step")
        wider = materialize(led.join(step, "top", "left").select("chief", F.coalesce("to", "top").alias("top")), "led")
        fewer = materialize(chiefs.join(step.select(F.col("top").alias("id")), "id", "left_anti"), "chiefs")
        discard(led, near)
        led, chiefs, rounds = wider, fewer, rounds + 1
    moved = placed.join(led, "chief").select("node", F.col("top").alias("chief"), F.col("chief").alias("former"))
    kept = materialize(moved, "moved")
    near = _cosines(kept.where("node <> chief and chief <> former").select(F.col("node").alias("a"), F.col("chief").alias("b")), nodes).where(F.col("cos") >= threshold).select(F.col("a").alias("node"), F.lit(True).alias("near"))
    kept = materialize(kept.join(near, "node", "left").select("node", "chief", "former", (F.col("near").isNotNull() | (F.col("chief") == F.col("former")) | (F.col("node") == F.col("chief"))).alias("fits")), "fits")
    out = kept.where("fits").select("node", "chief")
    left = kept.where("not fits").select("node", F.col("former").alias("g"))
    if left.isEmpty():
        return out
    return materialize(out.unionByName(_represented(left, edges, nodes, threshold)), "placed")


def group_rows(df: DataFrame, id_col: str, class_col: str, vec_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(first_id, id): every row of a group but its smallest."""
    return cluster(df, id_col, class_col, vec_col, threshold)[0].where("id > first_id").select("first_id", "id")


def describe(df: DataFrame, id_col: str, class_col: str, vec_col: str, name_col: str, typical: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """(first_id, class, size, typical): the names of highest internal weighted degree, each once, joined by ' | '."""
    groups = cluster(df, id_col, class_col, vec_col, threshold)[0].where("size > 1")
    named = groups.join(df.select(F.col(id_col).alias("id"), F.col(class_col).alias("class"), F.coalesce(name_col, F.lit("")).alias("name")), "id")
    names = named.groupBy("first_id", "class", "size", "name").agg(F.max("degree").alias("degree"))
    top = names.withColumn("r", F.row_number().over(Window.partitionBy("first_id").orderBy(F.desc("degree"), "name"))).where(F.col("r") <= typical)
    listed = F.array_sort(F.collect_list(F.struct("r", "name")))  # ``typical`` at most
    return top.groupBy("first_id", "class", "size").agg(F.array_join(F.transform(listed, lambda x: x["name"]), " | ").alias("typical"))
