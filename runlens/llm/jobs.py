"""Spark helpers shared by the operators: lineage cuts, fixed-size folds, components."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm.units import drop_memos
from runlens.session import cut_lineage, ensure_checkpoint_dir, ship_package


BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
EDGES = 500_000  # of a graph in one partition


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder from the session, package on every executor, Arrow batches of bounded size.

    A batch holds whole texts, so batches of the default 10,000 rows can be
    large; so can those of the Parquet reader (4,096 rows, on the heap).  A
    session's own smaller settings stay.
    """
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
                      ("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)):
        now = spark.conf.get(key)
        size = int(now.rstrip("bB"))
        if size <= 0 or size > most:
            spark.conf.set(key, most)


def tidy_worker() -> None:
    """Start of a task, or after large work on the driver: give back what earlier tasks left, other operators' memos and freed memory.

    Spark goes on with the same Python workers from stage to stage, and a freed
    page stays with the worker unless its allocator is told.
    """
    drop_memos()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts_for(spark: SparkSession, rows: float, rows_per_part: int) -> int:
    """Partitions so that each holds about ``rows_per_part`` rows, never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows // rows_per_part) + 1)


def fold_counts(blobs: DataFrame, width: int, block: int) -> np.ndarray:
    """Add up fixed-size count vectors cut into blocks (columns ``block`` int, ``counts`` zlib'd bytes, capped at 255 a task).

    Each block is folded on the executors; the driver receives one byte per
    cell (8 * log2(1 + count), capped at 255), ``width`` bytes whatever the input.
    """

    def fold(key, groups):
        total = np.zeros(block, np.uint64)
        for pdf in groups:
            for b in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(b), np.uint8)
        level = np.minimum(255, np.rint(8 * np.log2(1 + total.astype(np.float64)))).astype(np.uint8)
        yield pd.DataFrame({"block": [key[0]], "level": [level.tobytes()]})

    out = np.zeros(width, np.uint8)
    folded = blobs.select("block", "counts").groupBy("block").applyInPandas(_streamed(fold), "block int, level binary")
    for r in folded.collect():  # width bytes in all
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(r.level, np.uint8)
    return out


def _streamed(fold):
    def run(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fold(key, groups)

    return run


def count_blobs(counts: np.ndarray, block: int):
    """Blocks of a count vector that hold anything, zlib'd."""
    for i in range(0, len(counts), block):
        part = counts[i : i + block]
        if part.any():
            yield i // block, zlib.compress(np.minimum(part, 255).astype(np.uint8).tobytes(), 1)


def bit_filter(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter with one hash over an integer column: ``bits`` / 8 bytes, whatever the number of keys.

    A cell may be set by another key (callers join afterwards), a key is never missed.
    """
    block = 1 << 16
    cell = F.pmod(F.xxhash64(column), F.lit(bits))
    cells = keys.select(cell.alias("cell")).distinct()

    def fold(key, groups):
        on = np.zeros(block, bool)
        for pdf in groups:
            on[pdf["cell"].to_numpy() % block] = True
        yield pd.DataFrame({"block": [key[0]], "on": [np.packbits(on).tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    folded = cells.withColumn("block", (F.col("cell") / F.lit(block)).cast("int")).groupBy("block").applyInPandas(
        _streamed(fold), "block int, on binary")
    for r in folded.collect():
        out[r.block * block // 8 : (r.block + 1) * block // 8] = np.frombuffer(r.on, np.uint8)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge are absent.

    ``edges`` has long columns ``u`` and ``v``.  Alternating large-star and
    small-star rounds, each a grouping by node with a map-side combine and a
    join, cut by a reliable checkpoint; the number of rounds grows with the
    logarithm of the graph's size and the loop ends at the fixed point.
    Up to ``EDGES`` edges make one partition; a window over it needs no exchange,
    so a round is a few tasks and not some for each shuffle partition, all of
    which the driver would plan, track and remember.
    """
    e = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    parts = e.count() // EDGES + 1  # a round never has more edges than this one
    e = e.coalesce(parts)
    before = None

    def with_least(x: DataFrame) -> DataFrame:
        """``x`` with the least ``v`` of each ``u`` as ``m``."""
        if parts == 1:
            return x.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        return x.join(x.groupBy("u").agg(F.min("v").alias("m")), "u")

    def pairs(*ways: Column) -> Column:
        """A row for each (u, v); unlike a union it keeps the one partition."""
        return F.explode(F.array(*ways)).alias("e")

    for _ in range(max_rounds):
        both = e.select(pairs(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).select("e.u", "e.v")
        e = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        e = (with_least(e).select(pairs(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
             .select("e.u", "e.v").where("u <> v").distinct())
        e = cut_lineage(e.coalesce(parts)).coalesce(parts)
        now = e.agg(F.count("*"), F.sum("u"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    kids = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return kids.unionByName(roots)
