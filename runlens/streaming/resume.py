"""Resuming a run: samples that are done are skipped by keyed state.

``resume_stream`` passes each sample of an (experiment, approach) on once, however
often its result arrives again - in one micro-batch, in later ones, or after a
restart with files that overlap.  The state is kept by the state store (RocksDB,
on disk and in the checkpoint), not in the sink: one bit a sample, in blocks of ``DONE_BLOCK``
samples of one (experiment, approach).  ``KEY_BLOCKS`` blocks make up a key, whose blocks
are read and written at once (a key costs a few calls from Python to the store, however few rows it
gets), so an experiment that holds most results is still many keys.  A key that gets no
result for ``ttl`` is forgotten, which bounds the state.

``pending_by_state`` is the work left: the grid without the samples whose bits the
checkpoint holds; no result is read for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.maintain import results_to_runs
from ..sources.io import write_delta
from .streams import _reader

DONE_BLOCK = 1024
KEY_BLOCKS = 64
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["experiment_id", "approach_name"]


def sample_filter(ttl_ms: int | None, sample: int) -> StatefulProcessor:
    """Processor for the rows of one key's blocks of samples: passes the first row of each sample that has not been done.

    Rows without a sample index (column number ``sample``) can't be recognised again and all pass.
    The class is made here, so it travels by value: the stream's driver-side worker need not find this package.
    """

    class FirstOfEachSample(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.done = handle.getListState("done", "block long, bits binary", ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            held = {block: bytearray(bits) for block, bits in self.done.get()}
            out, changed = [], False
            for row in rows:
                n = row[sample]
                if n is not None:
                    block, at = divmod(n, DONE_BLOCK)
                    byte, bit = divmod(at, 8)
                    bits = held.get(block)
                    if bits is None:
                        bits = held[block] = bytearray(DONE_BLOCK // 8)
                    if bits[byte] >> bit & 1:
                        continue
                    bits[byte] |= 1 << bit
                    changed = True
                out.append(row)
            if changed:
                self.done.put([(block, bytes(bits)) for block, bits in held.items()])
            yield from out

        def close(self) -> None:
            pass

    return FirstOfEachSample()


def first_of_each_sample(runs: DataFrame, ttl: timedelta | None) -> DataFrame:
    """Streaming: the rows of ``runs`` whose (experiment, approach, sample) has not been seen."""
    rows = runs.withColumn("_block", F.floor(F.col("sample_index") / (KEY_BLOCKS * DONE_BLOCK)).cast("long"))
    proc = sample_filter(None if ttl is None else int(ttl.total_seconds() * 1000), runs.columns.index("sample_index"))
    return rows.groupBy(*KEYS, "_block").transformWithState(
        proc, outputStructType=rows.schema, outputMode="append", timeMode="none" if ttl is None else "processingTime").drop("_block")


def resume_stream(spark: SparkSession, source: str, schema, table_base: str, checkpoint: str, ttl: timedelta | None = timedelta(days=30),
                  max_files_per_trigger: int | None = None):
    """Streaming writer of arriving results into the runs table, each sample once.

    It runs in a session of its own, which keeps state in RocksDB (keyed state needs it) and runs
    no batches without data: with a time-to-live they would never end; what has
    expired does not count from then on and is removed with the next batch.
    """
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(STORE, ROCKSDB)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    runs = first_of_each_sample(results_to_runs(_reader(own, schema, max_files_per_trigger).parquet(source)), ttl)

    def append(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch, table_base, batch_id)

    return runs.writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint)


def done_samples(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(experiment_id, approach_name, sample_index) of all samples that the stream's state holds as done."""
    state = spark.read.format("statestore").option("stateVarName", "done").load(checkpoint)
    block = "list_element.value" if "value" in state.schema["list_element"].dataType.fieldNames() else "list_element"
    bits = state.select(*[F.col(f"key.{k}").alias(k) for k in KEYS], F.col(f"{block}.block").alias("_block"), F.hex(f"{block}.bits").alias("_hex"))
    byte = F.explode(F.sequence(F.lit(0), F.lit(DONE_BLOCK // 8 - 1))).alias("_i")
    rows = bits.select("*", byte).withColumn("_b", F.conv(F.substring("_hex", F.col("_i") * 2 + 1, F.lit(2)), 16, 10).cast("int")).where("_b > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_j")).where(F.expr("shiftright(_b, _j) & 1 = 1"))
    return rows.select(*KEYS, (F.col("_block") * DONE_BLOCK + F.col("_i") * 8 + F.col("_j")).alias("sample_index"))


def pending_by_state(spark: SparkSession, grid: DataFrame, checkpoint: str) -> DataFrame:
    """Rows of ``grid`` (experiment_id, approach_name, sample_index, ...) that are not done."""
    return grid.join(done_samples(spark, checkpoint), [*KEYS, "sample_index"], "left_anti").select(grid.columns)
