"""Structured Streaming jobs (2.14), each with a batch twin.

Sinks are merge-on-read tables (``runlens.sources.io.write_delta`` /
``read_merged``): every micro-batch writes only its own rows to
``delta/batch=<id>`` with overwrite, so a replayed batch is idempotent and no
batch rewrites the whole table; readers take the latest batch per key.

* ``ingest_runs_stream`` - scored results arrive as files and are upserted
  into the runs table (last write wins per run id).
* ``progress_stream`` - running count, errors and percent per experiment
  (streaming aggregate in update mode).
* ``run_available`` - run a query to completion with ``availableNow`` and
  report how many input rows it took (a resumed job with no new file takes 0).
* ``rate_audit_stream`` - calls per provider per one-second window against
  the provider ceiling, with a watermark: rows later than the watermark are
  dropped instead of reopening closed windows.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.maintain import results_to_runs
from ..sources.io import read_merged, write_delta

# --- fixed values: provider request ceilings per second; others 1 -----------
PROVIDER_CEILINGS = {"anthropic": 5.0, "cohere": 10.0, "openrouter": 2.0}
DEFAULT_CEILING = 1.0


def run_available(writer) -> int:
    """Start a query with ``trigger(availableNow=True)``, wait for it, and
    return the number of input rows it processed, over all its micro-batches."""
    spark = writer._spark  # the session that the query runs in
    counter = _InputRows()
    spark.streams.addListener(counter)
    try:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
        return counter.total(str(q.runId))
    finally:
        spark.streams.removeListener(counter)


class _InputRows(StreamingQueryListener):
    """Input rows of each run; a query's own progress list keeps its last batches only."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        with self.news:
            run = str(event.progress.runId)
            self.rows[run] = self.rows.get(run, 0) + max(0, int(event.progress.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def total(self, run: str, wait: float = 120.0) -> int:
        """Rows of a run that has ended; its last events may still be on their way."""
        with self.news:
            if not self.news.wait_for(lambda: run in self.ended, wait):
                raise RuntimeError("no end event of the streaming query")
            return self.rows.get(run, 0)


def _reader(spark: SparkSession, schema, max_files_per_trigger: int | None):
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r


def ingest_runs_stream(spark: SparkSession, source: str, schema, table_base: str, checkpoint: str,
                       max_files_per_trigger: int | None = None):
    """Streaming writer upserting arriving results into the runs table."""
    stream = _reader(spark, schema, max_files_per_trigger).parquet(source)

    def merge(batch: DataFrame, batch_id: int) -> None:
        write_delta(results_to_runs(batch), table_base, batch_id)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def ingest_runs_keyed(spark: SparkSession, source: str, schema, table, checkpoint: str, max_files_per_trigger: int | None = None):
    """Streaming writer upserting arriving results into a ``KeyedTable``: a micro-batch
    reads and replaces only the files that hold its keys; a replayed one is not done again."""
    stream = _reader(spark, schema, max_files_per_trigger).parquet(source)

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.upsert(results_to_runs(batch), ["created_at"], tag=f"{checkpoint}#{batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current_runs(spark: SparkSession, table_base: str, initial: DataFrame | None = None) -> DataFrame | None:
    return read_merged(spark, table_base, ["id"], ["created_at"], initial)


def progress_stream(spark: SparkSession, source: str, schema, totals: DataFrame, out_base: str, checkpoint: str,
                    max_files_per_trigger: int | None = None):
    """Running results, errors and percent done per experiment; ``totals``
    holds (experiment_id, total_samples), one row per experiment."""
    runs = _reader(spark, schema, max_files_per_trigger).parquet(source)
    agg = runs.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("results_count"),
        F.sum(F.col("is_correct").isNull().cast("long")).alias("errors_count"),
    )

    def merge(batch: DataFrame, batch_id: int) -> None:
        upd = batch.join(totals, "experiment_id", "left").select(
            "experiment_id",
            "results_count",
            "errors_count",
            "total_samples",
            F.when(F.col("total_samples") > 0, F.col("results_count") / F.col("total_samples") * 100.0)
            .otherwise(F.lit(0.0))
            .alias("progress_percentage"),
        )
        write_delta(upd, out_base, batch_id)

    return agg.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)


def current_progress(spark: SparkSession, out_base: str) -> DataFrame | None:
    return read_merged(spark, out_base, ["experiment_id"])


def ceiling(provider) -> F.Column:
    rates = F.create_map(*[x for k, v in PROVIDER_CEILINGS.items() for x in (F.lit(k), F.lit(v))])
    p = F.col(provider) if isinstance(provider, str) else provider
    return F.coalesce(rates[F.lower(p)], F.lit(DEFAULT_CEILING))


def _flag(w: DataFrame, seconds: int) -> DataFrame:
    return w.select(
        "provider",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "calls",
        ceiling("provider").alias("ceiling"),
        (F.col("calls") / F.lit(float(seconds)) > ceiling("provider")).alias("over_limit"),
    )


SLICE_SECONDS = 60


def sliding_rate_audit(calls: DataFrame, seconds: int = 1) -> DataFrame:
    """Calls of each provider in the ``seconds`` up to and with each time of a call, against
    the provider's ceiling: the ceiling holds for any second, so a burst over the edge of
    two windows counts as one (an interval with most calls ends at a call).

    Calls of one time are counted first.  Time is cut into slices; a slice also gets the
    counts of the last ``seconds`` before it, so a window stays inside its slice and a provider
    with most of the calls is as many groups as it has slices.  Calls without a time are left out.
    """
    span, step = seconds * 1_000_000, max(SLICE_SECONDS, seconds) * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    counted = calls.where(F.col("ts").isNotNull()).groupBy("provider", at.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    own = F.floor(F.col("_at") / step)
    # the slice after is a call's, too, if a window that ends there can reach back to it
    slices = F.array_distinct(F.array(own, F.floor((F.col("_at") + span - 1) / step)))
    dealt = counted.select("provider", "_at", "_n", own.alias("_own"), F.explode(slices).alias("_slice"))
    w = Window.partitionBy("provider", "_slice").orderBy("_at").rangeBetween(-(span - 1), 0)
    out = dealt.withColumn("calls", F.sum("_n").over(w)).where("_slice = _own")
    end = F.timestamp_micros("_at")
    return out.select("provider", (end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))).alias("window_start"), end.alias("window_end"), "calls",
                      ceiling("provider").alias("ceiling"), (F.col("calls") / F.lit(float(seconds)) > ceiling("provider")).alias("over_limit"))


def rate_audit_stream(spark: SparkSession, source: str, schema, out_base: str, checkpoint: str,
                      watermark: str = "10 seconds", seconds: int = 1, max_files_per_trigger: int | None = None):
    """Streaming audit of request rates per provider (update mode)."""
    calls = _reader(spark, schema, max_files_per_trigger).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    w = (
        calls.withWatermark("ts", watermark)
        .groupBy("provider", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("calls"))
    )

    def merge(batch: DataFrame, batch_id: int) -> None:
        write_delta(_flag(batch, seconds), out_base, batch_id)

    return w.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)


def current_rates(spark: SparkSession, out_base: str) -> DataFrame | None:
    return read_merged(spark, out_base, ["provider", "window_start"])
