"""Ordered per-group computations (2.5): numbering, first-k, latest, last write
wins, running cost guard, checkpoint batches.

Per-group numbering and running sums use ``running_sums`` (range-partitioned
two-level prefix sums), so one experiment holding a large share of all runs is
spread over many tasks instead of being sorted in one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sums

# --- fixed values: cost guard thresholds (USD) and the default call limit ----
COST_WARN = 1.0
COST_HIGH = 5.0
MAX_REASONING_CALLS = 5


def number_samples(
    df: DataFrame,
    part: Iterable[str] = ("experiment_id",),
    order: Iterable[str] = ("sample_index", "id"),
    name: str = "sample_no",
) -> DataFrame:
    """0-based index per group in input order (a running count)."""
    order = list(order)
    return running_sums(df, list(part), [F.col(c) for c in order], {name: F.lit(1).cast("long")})


def first_k(df: DataFrame, keys: Iterable[str], order: list, k: int = 3, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group in ``order``."""
    w = Window.partitionBy(*list(keys)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).filter(F.col(name) <= k)


def latest_preprocessing(prep: DataFrame, keys: Iterable[str] = ("dataset_name",)) -> DataFrame:
    """Newest processed pass per dataset (and config when given): max_by on
    processed_at (ties to the larger id); a partial aggregate, no sort."""
    keys = list(keys)
    p = prep.filter(F.col("status") == "processed")
    cols = [c for c in prep.columns]
    best = F.max_by(F.struct(*cols), F.struct(F.col("processed_at"), F.col("id")))
    return p.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best.alias("_r")).select("_r.*")


def dedupe_last(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """INSERT OR REPLACE: per key the last row in ``order`` wins (max_by on the
    order struct: partial aggregation, so a hot key never sorts in one task)."""
    keys = list(keys)
    order = list(order)
    cols = df.columns
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best.alias("_r")).select("_r.*")


def cost_guard(
    runs: DataFrame,
    calls: Column | None = None,
    max_calls: int = MAX_REASONING_CALLS,
) -> DataFrame:
    """Running cost and call count before each run of an experiment (ordered
    by created_at, id) and the guard flags: cost > $1, cost > $5, calls at or
    over the limit.  Multi-call runs count all their calls (``calls``)."""
    calls = calls if calls is not None else F.lit(1)
    out = running_sums(
        runs,
        ["experiment_id"],
        [F.col("created_at"), F.col("id")],
        {"cost_before": F.coalesce(F.col("cost_estimate"), F.lit(0.0)), "calls_before": calls.cast("long")},
    )
    return out.select(
        "*",
        (F.col("cost_before") > COST_WARN).alias("cost_warning"),
        (F.col("cost_before") > COST_HIGH).alias("cost_high"),
        (F.col("calls_before") >= max_calls).alias("calls_limit_reached"),
    )


def checkpoint_batches(numbered: DataFrame, interval: int = 10, index_col: str = "sample_no",
                       totals: DataFrame | None = None) -> DataFrame:
    """Checkpoint batches of ``interval`` samples per experiment: batch number
    floor(index / interval), rows and last index per batch, whether the batch
    closed a checkpoint, and the experiment's progress percentage (against
    ``totals`` (experiment_id, total_samples) when given, else the rows seen).
    Experiment totals are aggregated from the per-batch rows, not the runs."""
    b = numbered.withColumn("batch_no", F.floor(F.col(index_col) / interval).cast("long"))
    per = b.groupBy("experiment_id", "batch_no").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max(index_col).alias("last_index")
    )
    tot = per.groupBy("experiment_id").agg(
        F.sum("n_samples").alias("_seen"), (F.max("last_index") + 1).alias("current_sample")
    )
    if totals is not None:
        tot = tot.join(totals, "experiment_id", "left")
    else:
        tot = tot.withColumn("total_samples", F.col("_seen"))
    j = per.join(tot, "experiment_id")
    return j.select(
        "experiment_id",
        "batch_no",
        "n_samples",
        "last_index",
        (((F.col("last_index") + 1) % interval) == 0).alias("checkpoint_saved"),
        F.when(F.col("total_samples") > 0, F.col("current_sample") / F.col("total_samples") * 100.0)
        .otherwise(F.lit(0.0))
        .alias("progress_percentage"),
    )
