"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= t lie within ``eps = sqrt(2 - 2 t)``.  Vectors are
projected on their leading principal axes, cut into grid cells of side eps and
sorted by cell (the epsilon grid order).  The sorted sequence is cut into
blocks with a bounding box each; block pairs whose boxes are more than eps
apart are dropped (projections never lengthen a distance, so nothing within
eps is dropped).  In a block pair that stays, the join descends from the pair
of whole blocks through ``FANOUT`` sub-intervals a level to leaves, dropping
interval pairs in the same way.  Rows of a leaf pair that are within eps on
``SIEVE`` axes are compared in double precision.

Vectors are shuffled once, by range of cell, and their blocks checkpointed.
The join reads both blocks of a pair from the checkpoint, so its disk is
linear in the rows, however many block pairs stay; what grows with the pairs
is reading and CPU.

Equal vectors are one row with a weight before the join, so a group of copies
costs one vector.  A join task returns for its vectors a link count and edges
towards their component when it sinks, never the links themselves: its output
is linear in its rows even when everything is near everything.

Null or zero vectors and vectors with null or non-finite components link with
nothing.  Vectors of another length are read as if zeros followed.  The axes
are fitted on the ``SAMPLE`` vectors with the smallest id hashes (they change
the speed, never the result).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.jobs import components, prepare
from runlens.session import cut_lineage

SAMPLE = 20_000
AXES = 12
SIEVE = 20  # axes of the first comparison of two rows
BLOCK, BLOCK_BYTES = 16_384, 4 << 20  # of a block at most; a row of the join holds two
PART_BLOCKS = 4  # that a join task holds, one after another of the other side's is streamed past them
STREAMS = 16  # that the other side is cut into at least, if it has as many partitions
TASK_ROWS = 1024  # of a partition at least
LEAF = 256
FANOUT = 8
MERGE = 4096  # edges gathered before components are merged


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of floats (a list or a binary column), zeros behind short ones."""
    if not hasattr(column, "value_lengths"):
        column = pa.ListArray.from_arrays(*_floats(column.cast(pa.binary())))
    sizes, values = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    if (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.float32)
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def _floats(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Offsets and values of a binary column that holds floats."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view("<f4")
    return pa.array((at - at[0]) // 4, pa.int32()), pa.array(values)


def _blobs(column: pa.Array) -> pa.Array:
    """The bytes of each list of floats."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy()) * 4]).astype(np.int32)
    values = np.ascontiguousarray(column.flatten().to_numpy(), "<f4")
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; what is zero or not finite as floats has a zero vector and a NaN, which no comparison meets."""
    norms = np.linalg.norm(x := x.astype(np.float64), axis=1)
    norms[~((norms > 0) & np.isfinite(norms))] = np.nan
    return np.nan_to_num(x / norms[:, None], posinf=0, neginf=0), norms


def _valid() -> Column:
    """An id and a finite, non-zero vector; never null."""
    bad = F.expr("embedding is null or exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) "
                 "or forall(embedding, x -> x = 0)")
    return ~bad & F.col("vec_id").isNotNull()


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Rows of finite, non-zero vectors (vec_id, embedding as floats)."""
    return vectors.where(_valid()).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))


def _axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The leading axes first. Hashes alone are put in order, vectors are read for those that are chosen."""
    place = F.xxhash64("vec_id")
    last = vectors.select(place.alias("place")).orderBy("place").limit(SAMPLE).agg(F.max("place")).first()[0]
    rows = vectors.where(place <= last).select("embedding").limit(SAMPLE).toPandas()["embedding"]
    x = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    x, _ = _units(x)
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim) if len(x) > 1 else np.eye(dim))
    return np.ascontiguousarray(axes[:, ::-1][:, : max(AXES, SIEVE)])


def _cells(units: np.ndarray, axes: np.ndarray, eps: float) -> np.ndarray:
    """Grid cells by whole numbers: equal vectors have equal cells, whatever stands beside them."""
    fixed = [np.rint(m * (1 << 20)).astype(np.int64) for m in (units, axes[:, :AXES])]
    return np.clip((fixed[0] @ fixed[1]) // max(1, int(eps * (1 << 40))), -(1 << 31), (1 << 31) - 1).astype(np.int32)


def _merged(keys: list[np.ndarray], ids: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their keys: the first of each vector, its smallest id, its copies."""
    first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return first, np.minimum.reduceat(ids, first), np.add.reduceat(copies, first)


class _Block:
    """Rows of one block in grid order: ids, copies, vectors, projections, and boxes of leaves, of ``FANOUT`` leaves, and so on."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, axes: np.ndarray):
        self.ids, self.copies, self.x = ids, copies, x
        units, self.norms = _units(x)
        p = units @ axes
        # one product gives (eps^2 - distance^2) / 2 on the axes, but for a constant
        half, ones = (p * p).sum(1, keepdims=True) / -2, np.ones((len(p), 1))
        self.left, self.right = (np.concatenate(v, axis=1).astype(np.float32) for v in ((p, half, ones), (p, ones, half)))
        p, at = p[:, :AXES], np.arange(0, len(p), LEAF)
        self.boxes = [(np.minimum.reduceat(p, at), np.maximum.reduceat(p, at))]
        while len(self.boxes[-1][0]) > 1:
            at = np.arange(0, len(self.boxes[-1][0]), FANOUT)
            self.boxes.append((np.minimum.reduceat(self.boxes[-1][0], at), np.maximum.reduceat(self.boxes[-1][1], at)))


def _leaf_pairs(one: _Block, two: _Block, eps2: float, same: bool) -> Iterator[tuple[int, int]]:
    """Leaf pairs within eps, from the pair of whole blocks down; of a block with itself each pair once."""
    height = max(len(one.boxes), len(two.boxes))
    i = j = np.zeros(1, np.int64)
    for level in range(height - 1, -1, -1):
        (lo1, hi1), (lo2, hi2) = (b.boxes[min(level, len(b.boxes) - 1)] for b in (one, two))
        if level < height - 1:
            kids = np.arange(FANOUT)
            i, j = (v.ravel() for v in np.broadcast_arrays((i[:, None] * FANOUT + kids)[:, :, None], (j[:, None] * FANOUT + kids)[:, None, :]))
            there = (i < len(lo1)) & (j < len(lo2)) & ((i <= j) | (not same))
            i, j = i[there], j[there]
        d = np.maximum(0, np.maximum(lo1[i] - hi2[j], lo2[j] - hi1[i]))
        near = (d * d).sum(1) <= eps2
        i, j = i[near], j[near]
    return zip(i.tolist(), j.tolist())


def _hits(one: _Block, two: _Block, r: slice, s: slice, cosine: float, eps2: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked (i, j) of two leaves."""
    near = one.left[r] @ two.right[s].T >= np.float32(-eps2 / 2 - 1e-5)  # floats are off by less than that
    if same and r == s:
        near = np.triu(near, 1)
    rows = np.flatnonzero(near.any(1))  # few have any, and nonzero() takes longer than the product
    if not len(rows):
        return rows, rows
    i, j = np.nonzero(near[rows])
    i = rows[i]
    x, y, nx, ny = one.x[r].astype(np.float64), two.x[s].astype(np.float64), one.norms[r], two.norms[s]
    if len(i) > near.size // 64:
        return np.nonzero(near & (x @ y.T >= cosine * np.outer(nx, ny)))
    hit = np.einsum("ij,ij->i", x[i], y[j]) >= cosine * (nx[i] * ny[j])
    return i[hit], j[hit]


def _merge(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root`` (of each row, a smallest row of its component) after the edges (u, v)."""
    while True:
        u, v = root[u], root[v]
        u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]
        if not len(u):
            return root
        low = np.arange(len(root))
        np.minimum.at(low, v, u)
        while not np.array_equal(low, down := low[low]):
            low = down
        root = low[root]


def _linked(one: _Block, two: _Block, same: bool, cosine: float, eps2: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and component roots of the rows of two blocks (of one if ``same``), one behind the other."""
    behind = 0 if same else len(one.ids)
    n = behind + len(two.ids)
    links, root, edges, held = np.zeros(n, np.int64), np.arange(n), [], 0
    for a, b in _leaf_pairs(one, two, eps2, same):
        r, s = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
        i, j = _hits(one, two, r, s, cosine, eps2, same)
        if not len(i):
            continue
        i, j = i + r.start, j + s.start
        for at, other, copies in ((i, j, two.copies), (j + behind, i, one.copies)):
            start = at.min()
            found = np.bincount(at - start, copies[other]).astype(np.int64)
            links[start : start + len(found)] += found
        u, v = root[i], root[j + behind]
        if len(new := np.unique((u * n + v)[u != v])):
            edges.append(new)
            held += len(new)
        if held > MERGE:
            root, edges, held = _merge(root, *np.divmod(np.concatenate(edges), n)), [], 0
    return links, _merge(root, *np.divmod(np.concatenate(edges), n)) if edges else root


def _packed(keyed: DataFrame, rows: int, dim: int, axes: np.ndarray, eps: float) -> tuple[DataFrame, int]:
    """Blocks in grid order (block, ids, copies, k1, k2, x, lo, hi), and in how many partitions one side of their join is streamed."""
    spark = keyed.sparkSession
    width = max(1, min(BLOCK, BLOCK_BYTES // (4 * dim)))
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(rows // (PART_BLOCKS * width) + 1, min(rows // TASK_ROWS + 1, math.ceil(math.sqrt(4 * slots))))
    streams = min(parts, max(STREAMS, math.ceil(8 * slots / parts)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, k1, k2 = (b.column(c).to_numpy() for c in ("vec_id", "k1", "k2"))
            order = np.lexsort([k2, k1])
            first, ids, copies = _merged([k1[order], k2[order]], ids[order], np.ones(len(ids), np.int64))
            x = b.column("embedding").take(pa.array(order[first]))
            cells = _cells(_units(_matrix(x, dim))[0], axes, eps) ^ np.int32(-(1 << 31))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (ids, copies, k1[order[first]], k2[order[first]])]
                + [_blobs(x), pa.array([c.tobytes() for c in cells.astype(">i4")], pa.binary())], ["rep", "copies", "k1", "k2", "raw", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held = TaskContext.get().partitionId(), 0, None

        def block(rows: list[np.ndarray]) -> pa.RecordBatch:
            ids, copies, k1, k2, x = rows
            p = _units(x)[0] @ axes[:, :AXES]
            return pa.RecordBatch.from_arrays(
                [pa.array([part * ((1 << 20) + 1) + at]), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, copies, k1, k2, x.astype("<f4"))),
                 pa.array([list(p.min(0))]), pa.array([list(p.max(0))])], ["block", "ids", "copies", "k1", "k2", "x", "lo", "hi"])

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(c).to_numpy() for c in ("rep", "copies", "k1", "k2")] + [_matrix(b.column("raw"), dim)]
            # a vector's rows can go on from the batch before
            ends = [held[-1]] if held else []
            tail = [np.concatenate([e[-1:], v]) for e, v in zip(ends[0], new)] if ends else new
            first, ids, copies = _merged(tail[2:4], tail[0], tail[1])
            tail = [ids, copies, *(v[first] for v in tail[2:])]
            held = [*(held or [])[:-1], *([[v[:-1] for v in ends[0]]] if ends else []), tail]
            if sum(len(h[0]) for h in held) > width:  # the last row stays
                rows = [np.concatenate(v) for v in zip(*held)]
                while len(rows[0]) > width:
                    yield block([v[:width] for v in rows])
                    rows, at = [v[width:] for v in rows], at + 1
                held = [rows]
        if held:
            yield block([np.concatenate(v) for v in zip(*held)])

    in_order = (keyed.mapInArrow(project, "rep long, copies long, k1 long, k2 long, raw binary, cell binary")
                .repartitionByRange(parts, "cell", "k1", "k2").coalesce(parts).sortWithinPartitions("cell", "k1", "k2"))
    return cut_lineage(in_order.mapInArrow(
        pack, "block long, ids binary, copies binary, k1 binary, k2 binary, x binary, lo array<double>, hi array<double>")), streams


def _found(packed: DataFrame, streams: int, dim: int, axes: np.ndarray, cosine: float, eps2: float) -> DataFrame:
    """(rep, links, label): link counts, which add up, and edges towards components.

    Partitions of blocks meet pair by pair, each task reads both from the
    checkpoint: nothing is shuffled.  Of two blocks one order is taken, so that
    every partition of either side has as much to do.
    """
    gap = ("aggregate(zip_with(arrays_zip(alo, ahi), arrays_zip(blo, bhi), (p, q) -> greatest(0D, p.alo - q.bhi, q.blo - p.ahi)), "
           "0D, (s, d) -> s + d * d)")
    one, two = (packed.select(F.col("block").alias(k), *(F.col(c).alias(c + s) for c in ("ids", "copies", "x")), F.col("lo").alias(k + "lo"), F.col("hi").alias(k + "hi"))
                for k, s in (("a", "1"), ("b", "2")))
    pairs = one.coalesce(streams).join(two.hint("shuffle_replicate_nl"), F.expr(f"(a = b or (a < b) = ((a + b) % 2 = 0)) and {gap} <= {eps2}"))

    def read(b: pa.RecordBatch, row: int, side: str) -> _Block:
        ids, copies, x = (np.frombuffer(b.column(c + side)[row].as_buffer(), t) for c, t in (("ids", np.int64), ("copies", np.int64), ("x", "<f4")))
        return _Block(ids, copies, x.reshape(-1, dim), axes)

    def counted(ids: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        on = links > 0
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[on], links[on], ids[on])], ["rep", "links", "label"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streamed, a = None, None  # the block that is streamed past: [block, links, labels]
        kept: dict = {}  # of the others
        for b in batches:
            for row in range(b.num_rows):
                if (now := b.column("a")[row].as_py()) != a:
                    if streamed:
                        yield counted(streamed[0].ids, streamed[1])
                    a, one = now, read(b, row, "1")
                    streamed = [one, np.zeros(len(one.ids), np.int64), one.ids]
                same = (key := b.column("b")[row].as_py()) == a
                one, n = streamed[0], len(streamed[0].ids)
                two = one if same else read(b, row, "2")
                links, root = _linked(one, two, same, cosine, eps2)
                if not links.any():
                    continue
                streamed[1] += links[:n]
                ids, old = one.ids, streamed[2]
                if not same:
                    other = kept.setdefault(key, [two.ids.copy(), np.zeros(len(two.ids), np.int64), two.ids.copy()])
                    other[1] += links[n:]
                    ids, old = np.concatenate([ids, other[0]]), np.concatenate([old, other[2]])
                least = np.full(len(root), np.iinfo(np.int64).max)
                np.minimum.at(least, root, old)
                label = least[root]
                streamed[2] = label[:n]
                if not same:
                    other[2] = label[n:]
                if (sank := label != old).any():  # each label that a row ever has is an edge: rows of one label stay linked when it sinks again
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[sank], np.zeros(sank.sum(), np.int64), label[sank])], ["rep", "links", "label"])
        for ids, links in [(s[0].ids, s[1]) for s in [streamed] if s] + [k[:2] for k in kept.values()]:
            yield counted(ids, links)

    return pairs.select("a", "b", *(c + s for s in ("1", "2") for c in ("ids", "copies", "x"))).mapInArrow(join, "rep long, links long, label long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, ...).

    Extra columns are ignored; an empty table gives no row; a null vec_id links
    with nothing.  Rows that repeat a vec_id count as vectors of their own.
    """
    spark = vectors.sparkSession
    prepare(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    keyed = valid_vectors(vectors).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})
    size = keyed.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if not size.n:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim, eps2 = size.dim, 2 - 2 * cosine + 1e-9
    axes = _axes(keyed.select("vec_id", "embedding"), dim)
    packed, streams = _packed(keyed, size.n, dim, axes, math.sqrt(eps2))
    found = cut_lineage(_found(packed, streams, dim, axes, cosine, eps2))
    comp = components(found.select(F.col("rep").alias("u"), F.col("label").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b.column(c)[row].as_buffer(), np.int64)) for c in ("k1", "k2", "ids", "copies")], ["k1", "k2", "rep", "copies"])

    reps = packed.select("k1", "k2", "ids", "copies").mapInArrow(unpack, "k1 long, k2 long, rep long, copies long")
    named = (reps.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
             .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    good = keyed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~_valid()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_epsilon_grid(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
with recursive e as (select vec_id, embedding::double[] as v from embeddings),
g as (select vec_id, v, sqrt(list_dot_product(v, v)) as norm from e where v is not null and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0
      and list_dot_product(v, v) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
r(vec_id, k) as (select vec_id, vec_id from e union select r.vec_id, l.b from r join l on l.a = r.k),
c as (select vec_id, min(k) as component_id from r group by 1),
n as (select a as vec_id, count(*) as n from l group by 1)
select c.vec_id, coalesce(n.n, 0) as n_links, c.component_id, c.vec_id = c.component_id as kept from c left join n using (vec_id)
"""
