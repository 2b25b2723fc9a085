"""Exact Hamming top-k by incremental multi-index hashing.

A vector's binary code has one bit for each component (set where it is above
zero).  A code of ``b`` bits is cut into segments; each segment has a table
from its value to the codes with that value.  If a code differs from the query
in at most ``m * (r + 1) - 1`` bits, one of its ``m`` segments differs in at
most ``r``: so once all buckets within radius ``r`` of every segment were
looked up, every code up to that distance has been verified.  The radius grows
0, 1, 2, ... until the k-th verified distance is covered.

Rows are dealt by id hash to index shards (equal codes of a shard are one
entry with its k smallest ids), queries to blocks; a task searches one shard
for one block of queries and returns k rows a query; the shards' answers are
merged by a rank with a map-side limit.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.jobs import prepare
from runlens.session import cut_lineage

SHARD_ROWS = 1 << 16
QUERY_ROWS = 1 << 11
SEGMENT = 16


class MultiIndex:
    """Segment tables over distinct codes (rows of uint16 segments)."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order, self.starts = [], []
        for j in range(codes.shape[1]):
            self.order.append(np.argsort(codes[:, j], kind="stable"))
            self.starts.append(np.searchsorted(codes[self.order[j], j], np.arange((1 << SEGMENT) + 1)))

    def within(self, queries: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) of the codes with a segment at distance exactly ``r``, each once."""
        mask = np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), r)], np.int64)
        qs, cs = [], []
        for j in range(queries.shape[1]):
            value = queries[:, j].astype(np.int64)[:, None] ^ mask[None, :]
            lo, hi = self.starts[j][value], self.starts[j][value + 1]
            many = (hi - lo).ravel()
            total = int(many.sum())
            at = np.repeat(lo.ravel() - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(total)
            cs.append(self.order[j][at])
            qs.append(np.repeat(np.repeat(np.arange(len(queries)), len(mask)), many))
        pair = np.unique(np.concatenate(qs) * len(self.codes) + np.concatenate(cs))
        q, c = pair // len(self.codes), pair % len(self.codes)
        return q, c, np.bitwise_count(queries[q] ^ self.codes[c]).sum(1).astype(np.int64)

    def search(self, queries: np.ndarray, weight: np.ndarray, k: int, step: int = 32):
        """(query, code, distance) that hold each query's k nearest rows; ``weight`` rows share a code."""
        m = self.codes.shape[1]
        for at in range(0, len(queries), step):
            block = queries[at : at + step]
            open_, got = np.arange(len(block)), (np.zeros(0, np.int64),) * 3
            for r in range(SEGMENT + 1):
                q, c, d = self.within(block[open_], r)
                got = tuple(np.concatenate(x) for x in zip(got, (open_[q], c, d)))
                got = _first(got, len(self.codes))
                covered = m * (r + 1) - 1
                sure = np.bincount(got[0], np.where(got[2] <= covered, weight[got[1]], 0), len(block))
                open_ = open_[sure[open_] < k]
                if not len(open_):
                    break
            yield got[0] + at, got[1], got[2]


def _first(got, n):
    _, first = np.unique(got[0] * n + got[1], return_index=True)
    return tuple(x[first] for x in got)


def _code(column: pa.Array, bits: int) -> np.ndarray:
    out = np.zeros((len(column), -(-bits // SEGMENT) * SEGMENT), bool)
    for i, v in enumerate(column.to_pylist()):
        v = np.asarray(v, np.float64) > 0
        out[i, : len(v)] = v
    return np.packbits(out, axis=1).view(np.uint16)


def hamming_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k rows of ``vectors`` nearest to each row of ``queries``.

    Both have vec_id and embedding; null vectors, null components and null ids
    take no part; a row that is also a query finds itself at distance 0.
    Fewer than k rows give fewer results; an empty side gives none.
    """
    spark = vectors.sparkSession
    prepare(spark)
    vectors, queries = (valid_or_zero(x) for x in (vectors, queries))
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("bits")).first()
    n_queries = queries.count()
    schema = "query_id long, rank int, vec_id long, distance int"
    if not size.n or not n_queries:
        return spark.createDataFrame([], schema)
    shards, blocks_ = -(-size.n // SHARD_ROWS), -(-n_queries // QUERY_ROWS)
    bits = size.bits

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _code(b.column("embedding"), bits)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("deal"), pa.array([c.tobytes() for c in code], pa.binary())], ["vec_id", "deal", "code"])

    def coded(x: DataFrame, n: int) -> DataFrame:
        return x.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("deal")).mapInArrow(
            encode, "vec_id long, deal int, code binary")

    index = coded(vectors, shards)
    ask = coded(queries, blocks_)
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks_ - 1)))).withColumnRenamed("deal", "shard")
    ask = ask.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumnRenamed("deal", "block")

    def search(key, rows, asked):
        ids, codes = _columns(rows)
        qid, qcodes = _columns(asked)
        if not len(ids) or not len(qid):
            return
        order = np.lexsort((ids, *codes.T))
        ids, codes = ids[order], codes[order]
        new = np.r_[True, (codes[1:] != codes[:-1]).any(1)]
        start = np.flatnonzero(new)
        count = np.minimum(np.diff(np.r_[start, len(ids)]), k)
        for q, c, d in MultiIndex(codes[start]).search(qcodes, count, k):
            many = count[c]
            at = np.repeat(start[c] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            q, d, v = np.repeat(q, many), np.repeat(d, many), ids[at]
            best = np.lexsort((v, d, q))
            q, d, v = q[best], d[best], v[best]
            first = np.searchsorted(q, q)
            keep = np.arange(len(q)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(qid[q[keep]]), pa.array(v[keep]), pa.array(d[keep].astype(np.int32))], ["query_id", "vec_id", "distance"])

    def one(key, left, right):
        got = list(search(key, left.to_batches(), right.to_batches()))
        return pa.Table.from_batches(got, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.int32())]))

    found = cut_lineage(index.groupBy("shard", "block").cogroup(ask.groupBy("shard", "block")).applyInArrow(one, "query_id long, vec_id long, distance int"))
    near = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def _columns(batches) -> tuple[np.ndarray, np.ndarray]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return np.zeros(0, np.int64), np.zeros((0, 1), np.uint16)
    ids = np.concatenate([b.column("vec_id").to_numpy() for b in batches])
    raw = [c for b in batches for c in b.column("code").to_pylist()]
    return ids, np.frombuffer(b"".join(raw), np.uint16).reshape(len(ids), -1)


def valid_or_zero(x: DataFrame) -> DataFrame:
    """Rows with an id and no null component (a zero vector is a code of zeros)."""
    bad = F.expr("embedding is null or exists(embedding, x -> x is null)")
    return x.where(~bad & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def op4_hamming_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hamming_topk(vectors, vectors.where("vec_id % 50 = 0"), k=10)


OP4_SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: x > 0) as c from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null)) = 0),
d as (select q.vec_id as query_id, e.vec_id, cast(list_sum(list_transform(range(1, len(e.c) + 1), lambda i: cast(e.c[i] <> q.c[i] as int))) as int) as distance
      from e q, e where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by distance, vec_id) as int) as rank from d)
select query_id, rank, vec_id, distance from r where rank <= 10
"""
