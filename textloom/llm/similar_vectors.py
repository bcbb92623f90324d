"""Most similar vectors of every vector: additive quantisation and exact reranking.

A unit vector is written as a sum of full-dimensional codewords, one of each residual codebook, found
by beam search (``AdditiveQuantizer.encode``).  The first two codewords route: a vector goes to the
cells of its ``COPIES`` best pairs of routing codes, so that near vectors meet in some cell even where a border
runs between them.  In a cell every vector is scored against every other by lookup tables of the query's
products with the codewords and by stored norms; the ``RERANK`` best of the scores are ranked by their
exact cosine, and the best ``k`` of all cells of a vector are kept.

Scale: codebooks are fitted on a bounded sample (``SAMPLE`` rows); the number of routing codes grows
with the root of the number of rows, so that cells keep about ``CELL`` rows.  Cells above ``CELL_CAP``
are cut along the order of their fine codes; rows of one code that fill more than two such parts are searched in
blocks, every block against every other, so no row is left out.  Exact copies are one vector with
many rows: they are collapsed before and led back after, each taking at most the ``k + 1`` smallest row
identifiers of a group of copies.

Only rows with exactly ``DIM`` finite numbers, not all zero, take part.

Defined results: other rows (null, empty, short, NaN, zero) are in no pair; of rows of equal cosine
the smaller identifier is nearer; a row sent twice is a row of its own; fewer than ``k`` other rows
give fewer neighbours; empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize

DIM, K = 64, 5
#: Rows that codebooks are fitted on at most.
SAMPLE = 40_000
CELL, CELL_CAP = 400, 4000
COPIES, BEAM = 5, 5
FINE_BOOKS, FINE_CODES = 4, 64
RERANK = 160


def unit_rows(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable rows."""
    lengths = np.diff(column.offsets.to_numpy())
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (lengths == dim)
    at = np.flatnonzero(valid)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    flat = column.values.to_numpy(zero_copy_only=False)  # null elements come as NaN
    x = flat[column.offsets.to_numpy()[at][:, None] + np.arange(dim)].astype(np.float64)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    at, x = at[ok], x[ok]
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very small and large numbers in range
    return at, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 8192] @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for a in range(0, len(x), 8192)])
        total = np.zeros_like(c)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        own = near[order][first]
        total[own] = np.add.reduceat(x[order], first, axis=0)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty code starts again from a random row
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c.astype(np.float32)


@dataclass
class AdditiveQuantizer:
    """Two routing codebooks, then fine ones, each for the residual of those before."""

    routing: tuple[np.ndarray, np.ndarray]
    fine: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, routing_codes: int, seed: int = 0) -> AdditiveQuantizer:
        rng = np.random.default_rng(seed)
        residual, books = x, []
        for size in (routing_codes, routing_codes, *[FINE_CODES] * FINE_BOOKS):
            c = _kmeans(residual, size, rng) if len(x) else np.zeros((1, DIM), np.float32)
            near = np.concatenate([(residual[a : a + 8192] @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for a in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])
            residual = residual - c[near]
            books.append(c)
        return AdditiveQuantizer((books[0], books[1]), books[2:])

    def route(self, x: np.ndarray, copies: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(row position, cell) x copies: the pairs of routing codes with the least residuals, by beam search."""
        a, b = self.routing
        n, beam, kb = len(x), min(beam, len(a)), len(b)
        gain = x @ a.T - 0.5 * (a * a).sum(1)
        first = np.argpartition(-gain, beam - 1, axis=1)[:, :beam]
        # |x - a - b|^2 = |x|^2 - 2 (x.a - |a|^2/2) - 2 (x.b - |b|^2/2) + 2 a.b
        both = np.take_along_axis(gain, first, 1)[:, :, None] + (x @ b.T - 0.5 * (b * b).sum(1))[:, None, :] - (a @ b.T)[first]
        both = both.reshape(n, beam * kb)
        copies = min(copies, beam * kb)
        best = np.argpartition(-both, copies - 1, axis=1)[:, :copies]
        return np.repeat(np.arange(n), copies), (np.take_along_axis(first, best // kb, 1).astype(np.int64) * kb + best % kb).ravel()

    def encode(self, residual: np.ndarray, beam: int) -> np.ndarray:
        """Fine codes of residuals by beam search over all fine codebooks."""
        n = len(residual)
        codes = np.zeros((n, 1, 0), np.uint8)
        left = residual[:, None, :]
        for c in self.fine:
            gain = left @ c.T - 0.5 * (c * c).sum(1)
            score = gain - 0.5 * (left * left).sum(2)[:, :, None]  # minus half the squared residual, up to a constant
            flat = score.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(-flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
            came, code = best // len(c), best % len(c)
            codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], 1), code[:, :, None].astype(np.uint8)], axis=2)
            left = np.take_along_axis(left, came[:, :, None], 1) - c[code]
        best = (left * left).sum(2).argmin(1)
        return codes[np.arange(n), best]

    def base(self, cell: np.ndarray) -> np.ndarray:
        a, b = self.routing
        return a[cell // len(b)] + b[cell % len(b)]

    def copies(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row position, cell, fine codes, norm of the sum of codewords) of every copy."""
        row, cell = self.route(x, COPIES, BEAM)
        base = self.base(cell)
        codes = np.concatenate([self.encode(x[row[s : s + 4096]] - base[s : s + 4096], 2) for s in range(0, len(row), 4096)] or [np.zeros((0, FINE_BOOKS), np.uint8)])
        total = base.copy()
        for m, c in enumerate(self.fine):
            total += c[codes[:, m]]
        return row, cell, codes, np.maximum(np.linalg.norm(total, axis=1), 1e-6).astype(np.float32)


def search_cell(q: np.ndarray, x: np.ndarray, base_q: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: list[np.ndarray], k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, cosines) of the k best of x for every q: lookup tables, stored norms, exact reranking.

    base_q: product of each query with each item's routing codewords (or one column if shared). own: position of a query among
    the items, which is left out.
    """
    score = np.broadcast_to(base_q, (len(q), len(x))).copy()
    for m, c in enumerate(books):
        score += np.take(q @ c.T, codes[:, m], axis=1)  # the table's entries of the items' codes
    score /= norms
    if own is not None:
        score[np.arange(len(q)), own] = -np.inf
    width = min(RERANK, len(x))
    if width < len(x):
        near = np.argpartition(score, len(x) - width, axis=1)[:, len(x) - width :]
    else:
        near = np.tile(np.arange(len(x)), (len(q), 1))
    exact = np.matmul(x[near], q[:, :, None])[:, :, 0]
    if own is not None:
        exact[near == own[:, None]] = -np.inf
    k = min(k, width)
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, best, 1), np.take_along_axis(exact, best, 1)


# Vectors travel as 16-bit integers with a scale of their own: the error of a cosine stays below 1e-5.


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1) / 32767
    return np.rint(x / scale[:, None]).astype(np.int16), scale.astype(np.float32)


def unpack(packed: list[bytes], scale: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int16).reshape(len(packed), -1).astype(np.float32) * scale[:, None]


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of an array as a column of binaries."""
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


_UNIT = "id bigint, same binary, vec binary, scale float, copies array<struct<cell: bigint, fine: bigint, norm: float>>"


def _encoder(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: AdditiveQuantizer = model_b.value
        for b in batches:
            at, x = unit_rows(b.column(1), DIM)
            ids = b.column(0).take(pa.array(at))
            row, cell, codes, norm = model.copies(x)
            fine = np.zeros(len(row), np.int64)
            for m in range(codes.shape[1]):
                fine = fine * FINE_CODES + codes[:, m]
            packed, scale = pack(x)
            offsets = np.searchsorted(row, np.arange(len(at) + 1)).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(cell), pa.array(fine), pa.array(norm)], names=["cell", "fine", "norm"])
            same = pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, same, _fixed(packed), pa.array(scale), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=["id", "same", "vec", "scale", "copies"])

    return run


def _search_task(model_b, k: int):
    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        model: AdditiveQuantizer = model_b.value
        part, block, ids, cell, fine, norm = (t.column(c).to_numpy() for c in ("part", "block", "id", "cell", "fine", "norm"))
        home = t.column("home").to_numpy(zero_copy_only=False)
        x = unpack(t.column("vec").to_pylist(), t.column("scale").to_numpy())
        codes = np.stack([(fine // FINE_CODES ** (FINE_BOOKS - 1 - m) % FINE_CODES).astype(np.int64) for m in range(FINE_BOOKS)], axis=1)
        edge = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (block[1:] != block[:-1])])
        for a, z in zip(edge, np.r_[edge[1:], len(part)], strict=True):
            if z - a < 2:
                continue
            inside = np.arange(a, z)
            jobs = [(inside, inside)] if block[a] >= 0 else [(inside[home[a:z]], inside[~home[a:z]]), (inside[~home[a:z]], inside[home[a:z]])]
            for asks, items in jobs:
                if not len(items):
                    continue
                base = model.base(cell[items[:1]]) if (cell[items] == cell[items[0]]).all() else model.base(cell[items])
                for s in range(0, len(asks), 1000):
                    q = asks[s : s + 1000]
                    near, cos = search_cell(x[q], x[items], x[q] @ base.T, codes[items], norm[items], model.fine, k, q - a if asks is items else None)
                    found = np.empty(near.shape, np.dtype([("id", "<i8"), ("cos", "<f4")]))
                    found["id"], found["cos"] = ids[items][near], cos
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), _fixed(found)], names=["id", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= 20_000:
                t = pa.Table.from_batches(held).combine_chunks()
                part, block = t.column("part").to_numpy(), t.column("block").to_numpy()
                differs = np.flatnonzero((part != part[-1]) | (block != block[-1]))
                cut = int(differs[-1]) + 1 if len(differs) else 0
                if cut:
                    yield from emit(t.slice(0, cut).combine_chunks())
                    held, n = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
        if held:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    return run


def _merger(k: int):
    def best(ids: list[np.ndarray], found: list[bytes], sizes: list[np.ndarray]) -> pa.RecordBatch:
        near = np.frombuffer(b"".join(found), np.dtype([("id", "<i8"), ("cos", "<f4")]))
        who, to, cos = np.repeat(np.concatenate(ids), np.concatenate(sizes)), near["id"], near["cos"]
        order = np.lexsort((-cos, to, who))
        order = order[np.r_[True, (who[order][1:] != who[order][:-1]) | (to[order][1:] != to[order][:-1])]]
        order = order[np.isfinite(cos[order])]
        order = order[np.lexsort((to[order], -cos[order], who[order]))]
        who = who[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)])
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
        order, who = order[rank < k], who[rank < k]
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(to[order]), pa.array(cos[order])], names=["id", "near", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        found: list[bytes] = []
        sizes: list[np.ndarray] = []
        for b in batches:  # sorted by id; the last id may go on in the next batch
            own, payload = b.column(0).to_numpy(), b.column(1).to_pylist()
            ids.append(own)
            found += payload
            sizes.append(np.array([len(p) // 12 for p in payload], np.int64))
            if sum(map(len, ids)) > 50_000:
                every, size = np.concatenate(ids), np.concatenate(sizes)
                cut = int(np.searchsorted(every, every[-1]))
                if cut:
                    yield best([every[:cut]], found[:cut], [size[:cut]])
                    ids, found, sizes = [every[cut:]], found[cut:], [size[cut:]]
        if found:
            yield best(ids, found, sizes)

    return run


def _parts(units: DataFrame, rows: DataFrame, cap: int) -> DataFrame:
    """``rows`` with part, block and home.

    A cell above ``cap`` is cut into parts of about ``cap`` rows along the order of its rows' fine codes, so that like codes stay
    together; the cuts are read off cumulated counts of codes, no cell is sorted.  Where one code alone holds more than two
    parts' rows, the part is cut into blocks and every pair of blocks is searched.
    """
    code = F.shiftright("fine", int(math.log2(FINE_CODES)))  # all fine codes but the last
    slim = units.select(F.explode("copies").alias("c")).select("c.cell", "c.fine")
    over = materialize(slim.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap), "large-cells")
    if over.isEmpty():
        return rows.select(F.col("cell").alias("part"), F.lit(0).alias("block"), F.lit(True).alias("home"), "id", "cell", "fine", "norm", "vec", "scale")
    over = broadcast_if_small(over)
    counts = slim.join(over.select("cell"), "cell", "left_semi").groupBy("cell", code.alias("code")).agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("cell").orderBy("code")) - F.col("c")
    number = F.least(F.floor(before / cap), F.greatest(F.floor(F.col("n") / cap), F.lit(1)) - 1)
    cuts = materialize(counts.join(over, "cell").select("cell", "code", "c", number.cast("bigint").alias("number")), "cuts")
    large = cuts.groupBy("cell", "number").agg(F.sum("c").alias("n")).where(F.col("n") > 2 * cap).select("cell", "number", F.ceil(F.col("n") / cap).cast("int").alias("blocks"))
    rows = rows.withColumn("code", code).join(broadcast_if_small(cuts.drop("c")), ["cell", "code"], "left").withColumn("number", F.coalesce("number", F.lit(0)))
    rows = rows.join(broadcast_if_small(materialize(large, "large-parts")), ["cell", "number"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    block = F.when(F.col("own") == F.col("other"), F.col("own")).otherwise(-1 - (i * F.col("blocks") + j))
    return rows.select(F.xxhash64("cell", "number").alias("part"), block.cast("int").alias("block"), (F.col("own") == i).alias("home"), "id", "cell", "fine", "norm", "vec", "scale")


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int = K, cap: int = CELL_CAP) -> DataFrame:
    """(id, near, cos, rank): the ``k`` rows of highest cosine to each row, rank from 1."""
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    n = max(rows.count(), 1)
    usable = rows.where(F.size("v") == DIM).select("v")
    # the sample is drawn by chance over the whole table and cut at its bound
    drawn = usable if n <= SAMPLE else usable.sample(SAMPLE / n, seed=11)
    sample = unit_rows(drawn.limit(2 * SAMPLE).toArrow().column("v").combine_chunks(), DIM)[1][: 2 * SAMPLE]
    routing = max(1, math.ceil(math.sqrt(n * COPIES / CELL)))
    model = spark.sparkContext.broadcast(AdditiveQuantizer.fit(sample, min(routing, max(1, len(sample)))))
    units = materialize(rows.mapInArrow(_encoder(model), _UNIT), "units")

    twice = units.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1").select("same", "rep")
    twice = broadcast_if_small(materialize(twice, "copied"))
    members = materialize(units.select("same", "id").join(twice, "same").select("rep", "id"), "members")
    few = members.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("rn") <= k + 1)
    few = broadcast_if_small(materialize(few, "first-members"))

    searched = units.join(broadcast_if_small(members.where("id <> rep").select("id")), "id", "left_anti")
    exploded = searched.select("id", "vec", "scale", F.explode("copies").alias("c")).select("id", "c.cell", "c.fine", "c.norm", "vec", "scale")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * COPIES // 200_000)
    cells = _parts(searched, exploded, cap).repartition(parts, "part", "block").sortWithinPartitions("part", "block")
    found = cells.mapInArrow(_search_task(model, k), "id bigint, found binary")
    lists = found.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(_merger(k), "id bigint, near bigint, cos float")

    # copies of the neighbours, and of the row itself, take part as rows
    array = few.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 at most
    spread = lists.join(array, F.col("near") == F.col("rep"), "left").select("id", F.explode(F.coalesce("ids", F.array("near"))).alias("near"), "cos")
    own = few.select(F.col("rep").alias("id"), F.col("id").alias("near"), F.lit(2.0).cast("float").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "near"))
    top = spread.unionByName(own).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    top = top.join(few.where("rn = 1").select(F.col("rep").alias("id"), F.lit(True).alias("copied")), "id", "left")
    single = top.where(F.col("copied").isNull() & (F.col("rank") <= k)).select("id", "near", "cos", "rank")
    at = members.join(few.select("rep", "id", "rn"), ["rep", "id"], "left")
    of_copies = at.join(top.where("copied").select(F.col("id").alias("rep"), "near", "cos", "rank"), "rep").where("near <> id")
    of_copies = of_copies.withColumn("rank", F.col("rank") - F.coalesce((F.col("rn") < F.col("rank")).cast("int"), F.lit(0))).where(F.col("rank") <= k)
    return single.unionByName(of_copies.select("id", "near", "cos", "rank")).withColumn("cos", F.least("cos", F.lit(1.0).cast("float")))


def near_pairs(df: DataFrame, id_col: str, vec_col: str, k: int = K) -> DataFrame:
    """(id_a, id_b), id_a < id_b, where one is among the ``k`` nearest of the other."""
    return nearest(df, id_col, vec_col, k).select(F.least("id", "near").alias("id_a"), F.greatest("id", "near").alias("id_b")).distinct()
