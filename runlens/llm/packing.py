"""Best-two-fit packing of token pieces into sequences.

Tokenise in place; cut only texts over the capacity.  How pieces fill
sequences depends on their lengths alone, so the plan is made on the length
histogram (at most ``capacity`` numbers, whatever the input): fill a sequence
greedily with the longest piece that fits, until none does; then take out its
smallest piece if two unpacked pieces fill the widened gap more tightly.  A
filling pattern is applied as often as the counts allow, so the plan has few
patterns and does not grow with the number of pieces.

Pieces find their place by their rank among pieces of equal length.  Ranks are
counted in slices of a length (hash of the piece) plus the slice's offset, so
a length that most pieces share is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.jobs import parts_for, prepare
from runlens.llm.textblocks import blocks
from runlens.llm.units import UnitMemo, byte_encoder, shared_memo, space_units
from runlens.session import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids plus ``end_id``; longer documents in pieces of ``capacity``, the first may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = shared_memo(("spaces", vocabulary, ranks), lambda: UnitMemo(byte_encoder(vocabulary, ranks, pattern)))
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            rows = []
            for b in blocks(batch.column("text")):
                start, stop, first = space_units(b)
                at = memo.lookup(b, start, stop)
                units = memo.ids[at].tolist()
                first = first.tolist()
                for i in range(len(b)):
                    ids = b"".join(units[first[i] : first[i + 1]]) + end
                    n = len(ids) // 4
                    head = n % capacity if n > capacity else n
                    edges = [0, *range(head or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for p, (s, e) in enumerate(zip(edges, edges[1:])):
                        rows.append((doc_ids[b.row0 + i], p, s, e - s, zlib.crc32(ids[4 * s : 4 * e])))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(repeats, lengths of one sequence) patterns that use up ``counts[length]`` pieces of each length."""
    left = counts.astype(np.int64).copy()
    plan = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return plan
        below = np.zeros(capacity + 1, np.int64)  # longest length at hand up to each size; 0: none
        below[have] = have
        below = np.maximum.accumulate(below)
        used: dict[int, int] = {}
        fill, gap = [], capacity
        size = int(below[gap])
        while size:
            free = int(left[size]) - used.get(size, 0)
            if not free:
                size = int(below[size - 1])
                continue
            take = min(free, gap // size)
            fill += [size] * take
            used[size] = used.get(size, 0) + take
            gap -= take * size
            size = int(below[min(gap, size)])
        if gap:
            small = fill[-1]  # greedy filling adds in falling order
            free = left.copy()
            for s, n in used.items():
                free[s] -= n
            a = np.flatnonzero(free)
            a = a[a <= gap + small]
            if len(a):
                ok = np.zeros(capacity + 1, np.int64)
                ok[np.flatnonzero(free)] = np.flatnonzero(free)
                ok = np.maximum.accumulate(ok)
                b = ok[np.minimum(gap + small - a, a)]
                again = (b == a) & (free[a] < 2)
                b[again] = ok[a[again] - 1]
                total = np.where(b > 0, a + b, 0)
                best = len(total) - 1 - int(np.argmax(total[::-1]))
                if total[best] > small:
                    fill[-1:] = [int(a[best]), int(b[best])]
                    used[small] -= 1
                    for s in (int(a[best]), int(b[best])):
                        used[s] = used.get(s, 0) + 1
        times = min(int(left[s]) // n for s, n in used.items() if n)
        for s, n in used.items():
            left[s] -= times * n
        plan.append((times, fill))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Null and empty texts are one piece that holds the end id alone.  Extra
    columns are ignored; repeated rows are packed like any other; an empty table gives no row.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = cut_lineage(token_pieces(docs, vocabulary, end_id, capacity, ranks, pattern))
    slices = parts_for(spark, pieces.count(), 100_000)
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    sizes = cut_lineage(sliced.groupBy("length", "slice").agg(F.count("*").alias("n")))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).drop("n")
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        counts[r.length] = r.n
    runs: dict[int, list[tuple[int, int, int]]] = {}  # of each length: (first rank, first sequence, offset)
    seen, sequence = np.zeros(capacity + 1, np.int64), 0
    for times, fill in best_two_fit(counts, capacity):
        at = 0
        for size in fill:
            runs.setdefault(size, []).append((int(seen[size]), sequence, at))
            seen[size] += times
            at += size
        sequence += times
    plan_b = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in runs.items()})  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_b.value
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                on = size == s
                run = plan[int(s)]
                r = np.searchsorted(run[:, 0], rank[on], "right") - 1
                seq[on], off[on] = run[r, 1] + rank[on] - run[r, 0], run[r, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("at", F.row_number().over(order)).join(before, ["length", "slice"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at") - 1).alias("rank")).mapInArrow(
        place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    import public_tokenizers as public

    return pack(docs, public.path("byte_bpe_50k.json"), 2, capacity, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op9_best_two_fit(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
