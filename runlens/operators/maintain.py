"""Table maintenance on immutable Parquet tables by rewrite (2.13): upserts
(insert-or-replace), status updates, links, expiry with cascade, and CHECK
constraint reports.  Each returns the new table version as a DataFrame;
``runlens.sources.io.write_version`` commits it as a new version directory.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import is_correct_strict
from ..schemas import EXPERIMENT_STATUSES, PARSING_METHODS, PREPROCESSING_STATUSES
from .common import maybe_broadcast
from .windows import dedupe_last


def upsert(existing: DataFrame, incoming: DataFrame, keys: Iterable[str], order: Iterable[str] | None = None) -> DataFrame:
    """INSERT OR REPLACE by ``keys``: incoming rows replace existing rows with
    the same key; among incoming duplicates the last by ``order`` wins.
    Existing rows are kept by an anti-join (no aggregation over the old table)."""
    keys = list(keys)
    inc = dedupe_last(incoming, keys, list(order)) if order else incoming
    own = incoming.select(*keys).distinct() if order else inc.select(*keys)  # not of the last rows, which are a sort of whole rows
    kept = existing.join(own, keys, "left_anti")
    return kept.unionByName(inc.select(*existing.columns))


def results_to_runs(results: DataFrame) -> DataFrame:
    """Run rows from scored responses: verdict by the strict comparison (never
    NULL), ``execution_time_ms = int(latency * 1000)``, defaults as stored."""
    ans = F.coalesce(F.col("extracted_answer"), F.lit(""))
    exp = F.coalesce(F.col("expected_answer"), F.lit(""))
    return results.select(
        F.col("run_id").alias("id"),
        F.coalesce("experiment_id", F.lit("unknown")).alias("experiment_id"),
        F.coalesce("approach", F.lit("unknown")).alias("approach_name"),
        F.coalesce("provider", F.lit("unknown")).alias("provider"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.coalesce(F.col("sample_index").cast("long"), F.lit(0).cast("long")).alias("sample_index"),
        F.coalesce("input_text", F.lit("")).alias("input_text"),
        exp.alias("expected_answer"),
        F.col("text").alias("raw_output"),
        ans.alias("parsed_answer"),
        F.coalesce("parsing_method", F.lit("none")).alias("parsing_method"),
        F.coalesce(F.col("parsing_confidence").cast("double"), F.lit(0.0)).alias("parsing_confidence"),
        is_correct_strict(ans, exp).alias("is_correct"),
        (F.coalesce(F.col("latency").cast("double"), F.lit(0.0)) * 1000).cast("long").alias("execution_time_ms"),
        F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost_estimate"),
        F.col("created_at"),
    )


def upsert_runs(existing: DataFrame, results: DataFrame) -> DataFrame:
    """Scored responses into the runs table, last write wins per run id."""
    incoming = results_to_runs(results)
    cols = [c for c in existing.columns if c in incoming.columns]
    return upsert(existing.select(*cols), incoming.select(*cols), ["id"], ["created_at"])


def preprocessing_status(validation_passed: Column) -> Column:
    return F.when(F.coalesce(validation_passed, F.lit(False)), F.lit("processed")).otherwise(F.lit("failed"))


def upsert_preprocessing(existing: DataFrame, records: DataFrame) -> DataFrame:
    """Preprocessing records, status from the validation outcome.

    Unique are ``id`` and (``dataset_name``, ``dataset_config``); a NULL in the
    pair is unlike every other.  A record replaces all rows, of the table or
    earlier records, that clash with it in either; records come in the order of
    (``processed_at``, ``id``).
    """
    inc = records.withColumn("status", preprocessing_status(F.col("validation_passed"))).drop("validation_passed")
    cols = [c for c in existing.columns if c in inc.columns]
    existing, inc = existing.select(*cols), inc.select(*cols)
    pair = ["dataset_name", "dataset_config"]
    place = F.struct("processed_at", "id")
    # the last record of each pair among all records, also those that another one of their id replaces
    last = inc.dropna(subset=pair).groupBy(*pair).agg(F.max(place).alias("_last"))
    inc = dedupe_last(inc, ["id"], ["processed_at"]).join(last, pair, "left")
    inc = inc.filter(F.col("_last").isNull() | (place == F.col("_last"))).select(*cols)
    kept = existing.join(records.select("id"), "id", "left_anti").join(last, pair, "left_anti")
    return kept.select(*cols).unionByName(inc)


def set_experiment_status(experiments: DataFrame, experiment_id: str | Column, status: str) -> DataFrame:
    """Conditional update of the status column."""
    cond = F.col("id") == experiment_id if isinstance(experiment_id, str) else experiment_id
    return experiments.withColumn("status", F.when(cond, F.lit(status)).otherwise(F.col("status")))


def link_preprocessing(links: DataFrame, experiments: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append links and stamp each linked experiment with the preprocessing id,
    rules path, dataset name and output path of its latest new link."""
    all_links = links.unionByName(new_links, allowMissingColumns=True)
    latest = new_links.groupBy("experiment_id").agg(
        F.max_by(F.struct("preprocessing_id", "rules_path", "dataset_name", "eval_output_path"), F.col("id")).alias("l")
    ).select(F.col("experiment_id").alias("_eid"), "l.*")
    e = experiments.join(latest, experiments["id"] == latest["_eid"], "left")
    stamp = {
        "preprocessing_id": latest["preprocessing_id"],
        "preprocessing_rules_path": latest["rules_path"],
        "dataset_name": latest["dataset_name"],
        "eval_output_path": latest["eval_output_path"],
    }
    stamped = e.select(
        *[F.coalesce(stamp[c], experiments[c]).alias(c) if c in stamp else experiments[c] for c in experiments.columns]
    )
    return all_links, stamped


def expire_experiments(
    experiments: DataFrame,
    runs: DataFrame,
    metrics: DataFrame,
    links: DataFrame,
    days: float,
    as_of: Column,
) -> dict[str, DataFrame]:
    """Drop experiments older than ``days`` at ``as_of`` (fractional days, as
    julianday differences) and, by cascade, their runs, those runs' metrics,
    and their links.  Returns the kept tables and the expired experiment ids."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000.0
    expired = experiments.filter(age > days).select(F.col("id").alias("experiment_id"))
    expired = maybe_broadcast(expired)  # experiment ids: broadcast when the experiments table is small
    kept_exp = experiments.join(expired, experiments["id"] == expired["experiment_id"], "left_anti")
    kept_runs = runs.join(expired, "experiment_id", "left_anti")
    gone_runs = runs.join(expired, "experiment_id", "left_semi").select(F.col("id").alias("run_id"))
    kept_metrics = metrics.join(gone_runs, "run_id", "left_anti")
    kept_links = links.join(expired, "experiment_id", "left_anti")
    return {
        "experiments": kept_exp,
        "runs": kept_runs,
        "parsing_metrics": kept_metrics,
        "links": kept_links,
        "expired": expired,
    }


def check_constraints(experiments: DataFrame, runs: DataFrame, metrics: DataFrame, preprocessing: DataFrame) -> DataFrame:
    """Rows that break a CHECK or NOT NULL rule, with the rule name.  A NULL
    value passes a CHECK (SQL semantics); NOT NULL columns are checked apart."""

    def bad(df: DataFrame, table: str, rule: str, cond: Column) -> DataFrame:
        return df.filter(F.coalesce(cond, F.lit(False))).select(
            F.lit(table).alias("table_name"), F.col("id").cast("string").alias("row_id"), F.lit(rule).alias("rule")
        )

    def not_in(c: str, values: list[str]) -> Column:
        return ~F.col(c).isin(values)

    def out_of_unit(c: str) -> Column:
        return (F.col(c) < 0) | (F.col(c) > 1)

    parts = [
        bad(experiments, "experiments", "status", not_in("status", EXPERIMENT_STATUSES)),
        bad(experiments, "experiments", "config_json not null", F.col("config_json").isNull()),
        bad(runs, "runs", "parsing_method", not_in("parsing_method", PARSING_METHODS)),
        bad(runs, "runs", "parsing_confidence range", out_of_unit("parsing_confidence")),
        bad(runs, "runs", "experiment_id not null", F.col("experiment_id").isNull()),
        bad(metrics, "parsing_metrics", "confidence_score range", out_of_unit("confidence_score")),
        bad(preprocessing, "dataset_preprocessing", "status", not_in("status", PREPROCESSING_STATUSES)),
        bad(preprocessing, "dataset_preprocessing", "confidence_score range", out_of_unit("confidence_score")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
