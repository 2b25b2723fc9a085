"""Summaries kept up to date from upserts (2.4): stored partial aggregates with retraction.

``summary_partials`` holds one row per (experiment, approach, model): counts and
exact sums, from which both the experiment summary and the approach comparison
follow.  An upsert subtracts what the replaced rows added and adds the new
rows, so its cost is that of the touched rows, not of the table:

* counts and integer sums are longs, sums of doubles are decimals, so taking a
  row away gives exactly the state without it;
* the newest time of a group can't be subtracted: groups that lose a row as
  new as their newest one take it again from the table, all others don't read it;
* a group without rows is dropped, so the lists of approaches and models shrink too.

Rows are weighted as in ``compare_approaches``: a run counts once in the summary
and as often as its metrics fan out in the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import iflag
from .maintain import results_to_runs, upsert
from .runs import _weighted, approach_comparison, experiment_overview
from .windows import dedupe_last

GROUP = ["experiment_id", "approach_name", "model"]
_EXACT = "decimal(38,18)"


def _exact(c: str, weight: Column | None = None) -> Column:
    """A double to 18 decimal places (below 10^10), times a weight; exact under sums and differences."""
    v = F.col(c).try_cast("decimal(28,18)")
    return v.cast(_EXACT) if weight is None else (v * weight.cast("decimal(9,0)")).cast(_EXACT)


def _measures() -> dict[str, Column]:
    """What one weighted run adds to its group."""
    w = F.col("w")
    has = lambda c: F.col(c).isNotNull()
    return {
        "n": F.lit(1).cast("long"),
        "completed": iflag(has("is_correct")),
        "correct": iflag(F.col("is_correct")),
        "time_n": iflag(has("execution_time_ms")),
        "time_sum": F.coalesce(F.col("execution_time_ms").cast("long"), F.lit(0).cast("long")),
        "cost_n": iflag(has("cost_estimate")),
        "cost_sum": F.coalesce(_exact("cost_estimate"), F.lit(0).cast(_EXACT)),
        "w": w,
        "ok": F.col("ok"),
        "w_correct": w * iflag(F.col("is_correct")),
        "w_failed": w * iflag(~has("is_correct")),
        "w_time_n": w * iflag(has("execution_time_ms")),
        "w_time_sum": w * F.coalesce(F.col("execution_time_ms").cast("long"), F.lit(0).cast("long")),
        "w_cost_sum": F.coalesce(_exact("cost_estimate", w), F.lit(0).cast(_EXACT)),
        "w_conf_n": w * iflag(has("parsing_confidence")),
        "w_conf_sum": F.coalesce(_exact("parsing_confidence", w), F.lit(0).cast(_EXACT)),
    }


MEASURES = ["n", "completed", "correct", "time_n", "time_sum", "cost_n", "cost_sum", "w", "ok", "w_correct", "w_failed", "w_time_n", "w_time_sum",
            "w_cost_sum", "w_conf_n", "w_conf_sum"]


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    """Partials of weighted rows, negated for rows that go; ``newest`` / ``gone``: their newest time."""
    m = _measures()
    agg = [F.sum(v * sign if sign < 0 else v).alias(k) for k, v in m.items()]
    none = F.lit(None).cast(dict(rows.dtypes)["created_at"])
    last = F.max("created_at")
    out = rows.groupBy(*GROUP).agg(*agg, last.alias("_last"))
    return out.withColumn("newest", F.col("_last") if sign > 0 else none).withColumn("gone", F.col("_last") if sign < 0 else none).drop("_last")


def _summed(parts: DataFrame, *extra: Column) -> DataFrame:
    kinds = {k: "long" if not k.endswith("_sum") or k.endswith("time_sum") else _EXACT for k in MEASURES}
    return parts.groupBy(*GROUP).agg(*[F.sum(k).cast(kinds[k]).alias(k) for k in MEASURES], F.max("newest").alias("newest"), *extra)


def summary_partials(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Partials of a whole table: the state that upserts go on from."""
    return _summed(_signed(_weighted(runs, metrics), 1))


def refresh_partials(partials: DataFrame, before: DataFrame, after: DataFrame, current: DataFrame) -> DataFrame:
    """Partials after the weighted rows ``before`` were replaced by ``after``; ``current`` is the table that results."""
    parts = partials.withColumn("gone", F.lit(None).cast(dict(partials.dtypes)["newest"]))
    parts = parts.unionByName(_signed(before, -1)).unionByName(_signed(after, 1))
    # the newest time that stays known: that of the stored state or of the added rows
    out = _summed(parts, F.max("gone").alias("gone")).where("n > 0")
    stale = F.coalesce(F.col("gone") >= F.col("newest"), F.lit(False))
    keys = out.where(stale).select(*[F.col(c).alias(f"_{c}") for c in GROUP])
    same = [current[c].eqNullSafe(F.col(f"_{c}")) for c in GROUP]
    again = current.join(keys, same[0] & same[1] & same[2], "left_semi").groupBy(*GROUP).agg(F.max("created_at").alias("_again"))
    again = again.select(*[F.col(c).alias(f"_{c}") for c in GROUP], "_again")
    j = out.join(again, [out[c].eqNullSafe(again[f"_{c}"]) for c in GROUP], "left")
    return j.select(*GROUP, *MEASURES, F.when(stale, F.col("_again")).otherwise(F.col("newest")).alias("newest"))


def upsert_with_partials(existing: DataFrame, metrics: DataFrame, partials: DataFrame, results: DataFrame | None = None,
                         new_metrics: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, metrics, partials) after an upsert of scored results and / or more metric rows.

    The rows that count differently are the runs that come in and the runs that
    get metrics; only those are read with their metrics, before and after.  The last
    row of each incoming run is found once and kept.
    """
    runs, all_metrics, ids, incoming = existing, metrics, None, None
    if results is not None:
        incoming = results_to_runs(results)
        cols = [c for c in existing.columns if c in incoming.columns]
        incoming = cut_lineage(dedupe_last(incoming.select(*cols), ["id"], ["created_at"]))
        existing = existing.select(*cols)
        runs, ids = upsert(existing, incoming, ["id"]), incoming.select("id")
    if new_metrics is not None:
        all_metrics = metrics.unionByName(new_metrics, allowMissingColumns=True)
        more = new_metrics.select(F.col("run_id").alias("id"))
        ids = more if ids is None else ids.unionByName(more)
    if ids is None:
        return runs, all_metrics, partials
    ids = ids.distinct()
    before = existing.join(ids, "id", "left_semi")
    # after: what comes in, and of the rows before those that only get metrics; the table's other rows are not asked again
    after = before
    if incoming is not None:
        after = incoming.where("id is not null")
        if new_metrics is not None:
            after = upsert(before, after, ["id"])
    touched = lambda r, m: _weighted(r, m.join(ids.withColumnRenamed("id", "run_id"), "run_id", "left_semi"))
    return runs, all_metrics, refresh_partials(partials, touched(before, metrics), touched(after, all_metrics), runs)


def _mean(total: str, count: str) -> Column:
    return F.try_divide(F.sum(total).cast("double"), F.sum(count).cast("double"))


def live_experiment_summary(partials: DataFrame, experiments: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """``experiment_summary`` from stored partials; the runs are not read."""
    p = partials if experiment_id is None else partials.filter(F.col("experiment_id") == experiment_id)
    agg = p.groupBy("experiment_id").agg(
        F.sum("n").alias("total_runs"),
        F.sum("completed").alias("completed_runs"),
        (F.sum("n") - F.sum("completed")).alias("failed_runs"),
        _mean("correct", "n").alias("accuracy"),
        _mean("time_sum", "time_n").alias("avg_execution_time_ms"),
        F.when(F.sum("cost_n") > 0, F.sum("cost_sum").cast("double")).alias("total_cost"),
        F.sort_array(F.collect_set("approach_name")).alias("approaches_tested"),
        F.sort_array(F.collect_set("model")).alias("models_used"),
        _mean("ok", "w").alias("parsing_success_rate"),
        F.max("newest").alias("last_run_at"),
    )
    return experiment_overview(experiments, agg, experiment_id)


def live_comparison(partials: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """``compare_approaches`` from stored partials; the runs are not read."""
    p = partials if experiment_id is None else partials.filter(F.col("experiment_id") == experiment_id)
    return approach_comparison(p.groupBy("experiment_id", "approach_name").agg(
        F.sum("w").alias("sample_count"),
        _mean("w_correct", "w").alias("accuracy"),
        _mean("w_time_sum", "w_time_n").alias("avg_execution_time_ms"),
        F.sum("w_cost_sum").cast("double").alias("total_cost"),
        _mean("w_conf_sum", "w_conf_n").alias("confidence_avg"),
        _mean("w_failed", "w").alias("failure_rate"),
        _mean("ok", "w").alias("parsing_success_rate"),
    ))
