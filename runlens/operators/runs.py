"""Analysis of runs tables: filters, joins and aggregates.

Every aggregate is grouped by ``experiment_id`` (plus its own keys), so one job
answers for all experiments at once; pass ``experiment_id=`` to restrict.

Runs and parsing metrics both grow with the data.  The reference joins them
with a fanning left join (a run with k metric rows counts k times).  Here the
metrics are first reduced per ``run_id`` (map-side partial aggregation, so a
hot run id never lands whole in one task), the reduced side is joined on the
run id, and the fan-out is applied arithmetically as a row weight
``w = max(k, 1)``.  Results equal the fanning join exactly, without building it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, pystrip, truncate_text
from .common import exact_quantiles, flag, iflag, maybe_broadcast


def _exp(runs: DataFrame, experiment_id: str | None) -> DataFrame:
    return runs if experiment_id is None else runs.filter(F.col("experiment_id") == experiment_id)


# --------------------------------------------------------------------------- filters (2.2)


def filter_experiment(runs: DataFrame, experiment_id: str) -> DataFrame:
    return runs.filter(F.col("experiment_id") == F.lit(experiment_id))


def filter_approaches(runs: DataFrame, approaches: Iterable[str] | None = None) -> DataFrame:
    approaches = list(approaches or [])
    return runs.filter(F.col("approach_name").isin(approaches)) if approaches else runs


def filter_name_like(runs: DataFrame, experiments: DataFrame, fragment: str) -> DataFrame:
    """Runs whose experiment name contains ``fragment`` (``LIKE '%x%'``, ASCII case ignored), with the name."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    folded = [F.translate(c, upper, upper.lower()) for c in (F.col("name"), F.lit(fragment))]
    exps = experiments.filter(folded[0].contains(folded[1])).select(
        F.col("id").alias("experiment_id"), F.col("name").alias("experiment_name")
    )
    return runs.join(maybe_broadcast(exps), "experiment_id", "inner")


def list_experiments(experiments: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Experiments newest first with the config JSON parsed into columns."""
    df = experiments if status is None else experiments.filter(F.col("status") == status)
    df = df.select(
        "*",
        F.get_json_object("config_json", "$.provider").alias("config_provider"),
        F.get_json_object("config_json", "$.sample_count").cast("long").alias("config_sample_count"),
    ).drop("config_json")
    df = df.orderBy(F.col("created_at").desc(), F.col("id"))
    return df.limit(limit) if limit else df


def run_details(runs: DataFrame, metrics: DataFrame, run_id: str | None = None) -> DataFrame:
    """One run (or all) with its metric row(s) and parsed metadata."""
    r = runs if run_id is None else runs.filter(F.col("id") == run_id)
    m = metrics.select(
        F.col("run_id"),
        "parsing_attempts",
        "fallback_used",
        F.col("confidence_score").alias("parsing_confidence_score"),
        "extraction_time_ms",
        "error_details",
    )
    out = fanout_left_join(r, m)
    if "metadata_json" in r.columns:
        out = out.withColumn(
            "metadata", F.from_json("metadata_json", "map<string,string>")
        ).drop("metadata_json")
    return out


def filter_difficulty(df: DataFrame, difficulty: str | None, column: str = "difficulty") -> DataFrame:
    """Keep rows whose lower-cased difficulty equals the step's value; only when
    both the step and the column exist."""
    if not difficulty or column not in df.columns:
        return df
    return df.filter(F.lower(F.col(column)) == difficulty.lower())


def performance_metrics(responses: DataFrame) -> DataFrame:
    """Per run: times, tokens, cost, response length, depth and the
    approach-specific fields with their defaults.

    Expects columns: approach_name, execution_time, total_tokens, prompt_tokens,
    completion_tokens, cost_estimate, text, metadata (map<string,string>, may be null).
    """
    md = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))

    def get(key: str, default, typ: str) -> Column:
        return F.coalesce(md.getItem(key).cast(typ), F.lit(default).cast(typ))

    a = F.col("approach_name")
    tot = a.isin("TreeOfThought", "GraphOfThought")
    cov = a == "ChainOfVerification"
    sot = a == "SkeletonOfThought"
    plan = a == "AsPlanning"
    return responses.select(
        "id",
        "approach_name",
        F.col("execution_time"),
        F.col("total_tokens"),
        F.col("prompt_tokens"),
        F.col("completion_tokens"),
        F.col("cost_estimate"),
        F.length("text").cast("long").alias("response_length"),
        get("reasoning_steps", 1, "long").alias("reasoning_depth"),
        F.when(tot, get("branches_explored", 1, "long")).alias("branch_exploration"),
        F.when(tot, get("selected_path", "unknown", "string")).alias("selected_path"),
        F.when(cov, get("verification_count", 1, "long")).alias("verification_steps"),
        F.when(cov, get("verification_confidence", 0.5, "double")).alias("verification_confidence"),
        F.when(sot, get("outline_depth", 1, "long")).alias("outline_depth"),
        F.when(sot, get("expansion_ratio", 1.0, "double")).alias("expansion_ratio"),
        F.when(plan, get("planning_stages", 1, "long")).alias("planning_stages"),
        F.when(plan, get("risk_assessments", 0, "long")).alias("risk_assessments"),
    )


def answer_or_text(answer, text) -> Column:
    """Extracted answer if non-blank, else the raw text."""
    ans = F.col(answer) if isinstance(answer, str) else answer
    txt = F.col(text) if isinstance(text, str) else text
    return F.when(blank_to_null(ans).isNotNull(), ans).otherwise(txt)


def accuracy_breakdown(
    results: DataFrame,
    sample_col: str = "sample_id",
    expected_col: str = "expected_output",
    answer_col: str = "extracted_answer",
    text_col: str = "response_text",
) -> DataFrame:
    """Expected vs actual per sample; actual is the answer, else the raw text;
    both shown truncated to 27 chars + ``...`` past 30; correct = equal after
    strip + lower."""
    expected = F.coalesce(F.col(expected_col).cast("string"), F.lit("N/A"))
    actual = F.coalesce(answer_or_text(answer_col, F.col(text_col)).cast("string"), F.lit("N/A"))
    return results.select(
        F.coalesce(F.col(sample_col).cast("string"), F.lit("?")).alias("sample_id"),
        truncate_text(expected, 30, 27).alias("expected"),
        truncate_text(actual, 30, 27).alias("actual"),
        (F.lower(pystrip(expected)) == F.lower(pystrip(actual))).alias("correct"),
    )


# --------------------------------------------------------------------------- joins (2.3)


def metrics_per_run(metrics: DataFrame) -> DataFrame:
    """Metrics reduced to one row per run: row count and count with confidence > 0.5."""
    return metrics.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("m_rows"),
        F.sum(iflag(F.col("confidence_score") > 0.5)).alias("m_ok"),
    )


def _weighted(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with fan-out weight ``w`` and parsing-success count ``ok`` (see module doc)."""
    m = metrics_per_run(metrics)
    j = runs.join(m, runs["id"] == m["run_id"], "left").drop("run_id")
    return j.withColumn("w", F.greatest(F.coalesce(F.col("m_rows"), F.lit(0)), F.lit(1)).cast("long")).withColumn(
        "ok", F.coalesce(F.col("m_ok"), F.lit(0)).cast("long")
    )


def fanout_left_join(runs: DataFrame, m: DataFrame) -> DataFrame:
    """``runs LEFT JOIN m ON runs.id = m.run_id`` that survives a run holding a
    large share of the metric rows.

    A left outer join can only split skew on its left side, so the matches are
    an inner join (AQE splits a skewed partition of either side) and the runs
    without a match an anti join against the distinct run ids, with NULL metric
    columns."""
    matched = m.join(runs, m["run_id"] == runs["id"], "inner").drop("run_id")
    ids = m.select(F.col("run_id").alias("_mid")).distinct()
    alone = runs.join(ids, runs["id"] == ids["_mid"], "left_anti")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in m.schema if f.name != "run_id"]
    out = [*runs.columns, *[c for c in m.columns if c != "run_id"]]
    return matched.select(*out).unionByName(alone.select(*runs.columns, *nulls))


def _metric_columns(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        F.col("run_id"),
        "parsing_attempts",
        "fallback_used",
        F.col("confidence_score").alias("parsing_confidence_score"),
        F.col("extraction_time_ms").alias("parsing_time_ms"),
        "error_details",
    )


def runs_with_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Left outer equi-join runs.id = metrics.run_id; fans out like the reference."""
    return fanout_left_join(runs, _metric_columns(metrics))


def latest_metric_per_run(metrics: DataFrame) -> DataFrame:
    """The latest (highest id) metric row of each run."""
    return metrics.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in metrics.columns]), F.col("id")).alias("m")).select(
        "m.*"
    )


def runs_latest_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Same as ``runs_with_metrics`` but with one (latest) metric row per run,
    so a plain left join cannot fan out."""
    m = _metric_columns(latest_metric_per_run(metrics))
    return runs.join(m, runs["id"] == m["run_id"], "left").drop("run_id")


def experiment_lineage(links: DataFrame, preprocessing: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """Links joined to their preprocessing pass, columns disambiguated."""
    l = links if experiment_id is None else links.filter(F.col("experiment_id") == experiment_id)
    l = l.select([F.col(c).alias(f"link_{c}") if c in ("id", "dataset_name") else F.col(c) for c in l.columns])
    p = preprocessing.select([F.col(c).alias(f"prep_{c}") for c in preprocessing.columns])
    return l.join(p, l["preprocessing_id"] == p["prep_id"], "inner")


def runs_with_experiment(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    e = experiments.select(
        F.col("id").alias("experiment_id"),
        F.col("name").alias("experiment_name"),
        F.col("status").alias("experiment_status"),
    )
    return runs.join(maybe_broadcast(e), "experiment_id", "inner")


def normalize_registry(registry: DataFrame) -> DataFrame:
    """Dataset registry rows as (name, url, description, task_type): for each
    field the first column present wins (dataset_name or name, url or
    dataset_url, description, task_type or category), else a default."""
    cols = set(registry.columns)

    def first(names: list[str], default: str) -> Column:
        for n in names:
            if n in cols:
                return F.col(n).cast("string")
        return F.lit(default)

    return registry.select(
        first(["dataset_name", "name"], "unknown").alias("name"),
        first(["url", "dataset_url"], "").alias("url"),
        first(["description"], "").alias("description"),
        first(["task_type", "category"], "unknown").alias("task_type"),
    )


def unprocessed_datasets(registry: DataFrame, preprocessing: DataFrame) -> DataFrame:
    """Registry rows whose dataset has no ``processed`` preprocessing record,
    normalized and marked ``unprocessed``."""
    done = preprocessing.filter(F.col("status") == "processed").select(F.col("dataset_name").alias("_done")).distinct()
    reg = normalize_registry(registry)
    out = reg.join(done, reg["name"] == done["_done"], "left_anti")
    return out.withColumn("status", F.lit("unprocessed"))


def sample_approach_grid(samples: DataFrame, approaches: Iterable[str], id_col: str = "id") -> DataFrame:
    """Every sample x every approach: the work list.

    The approaches are a short list of names given by the caller, so each
    sample row is expanded by ``explode`` of a literal array: a map-only step,
    no join and no shuffle.
    """
    names = list(approaches)
    return samples.select("*", F.explode(F.array(*[F.lit(a) for a in names])).alias("approach"))


def baseline_overhead(
    metrics: DataFrame,
    baseline: str = "None",
    keys: Iterable[str] = ("experiment_id",),
    time_col: str = "avg_response_time",
    tokens_col: str = "avg_tokens_used",
    approach_col: str = "approach",
) -> DataFrame:
    """Each approach vs the baseline row of its group: time and token ratios;
    1.0 when the baseline value is <= 0."""
    keys = list(keys)
    base = metrics.filter(F.col(approach_col) == baseline).select(
        *keys, F.col(time_col).alias("_bt"), F.col(tokens_col).alias("_bk")
    )
    j = metrics.join(base, keys, "inner")

    def over(v, b):
        return F.when(F.col(b) > 0, F.col(v) / F.col(b)).otherwise(F.lit(1.0))

    return j.select(
        *keys,
        F.col(approach_col).alias("approach"),
        over(time_col, "_bt").alias("time_overhead"),
        over(tokens_col, "_bk").alias("token_overhead"),
    )


def orphan_rows(runs: DataFrame, experiments: DataFrame, metrics: DataFrame, links: DataFrame, preprocessing: DataFrame) -> DataFrame:
    """Foreign-key check: child rows whose parent is missing, with the FK name."""
    exp_ids = experiments.select(F.col("id").alias("_pid"))
    run_ids = runs.select(F.col("id").alias("_pid"))
    prep_ids = preprocessing.select(F.col("id").alias("_pid"))

    def anti(child: DataFrame, fk: str, parent: DataFrame, name: str, child_table: str) -> DataFrame:
        return child.join(parent, child[fk] == parent["_pid"], "left_anti").select(
            F.lit(child_table).alias("table_name"),
            F.col("id").cast("string").alias("row_id"),
            F.lit(name).alias("fk"),
            F.col(fk).cast("string").alias("missing_parent"),
        )

    return (
        anti(runs, "experiment_id", exp_ids, "runs.experiment_id->experiments.id", "runs")
        .unionByName(anti(metrics, "run_id", run_ids, "parsing_metrics.run_id->runs.id", "parsing_metrics"))
        .unionByName(
            anti(links, "experiment_id", exp_ids, "link.experiment_id->experiments.id", "preprocessing_eval_link")
        )
        .unionByName(
            anti(links, "preprocessing_id", prep_ids, "link.preprocessing_id->dataset_preprocessing.id", "preprocessing_eval_link")
        )
    )


def pending_samples(grid: DataFrame, results: DataFrame, errors: DataFrame, keys: Iterable[str] = ("sample_id", "approach")) -> DataFrame:
    """Resume: grid rows with no recorded result or error."""
    keys = list(keys)
    done = results.select(*keys).unionByName(errors.select(*keys))
    return grid.join(done, keys, "left_anti")


# --------------------------------------------------------------------------- aggregates (2.4)


def experiment_summary(
    runs: DataFrame, metrics: DataFrame, experiments: DataFrame, experiment_id: str | None = None
) -> DataFrame:
    """Per experiment: totals, accuracy (NULL verdict counts as wrong), time,
    cost, distinct approaches and models, parsing success over the fanning
    join, last update. No row when the experiment is absent; zeros when it has
    no runs."""
    r = _weighted(_exp(runs, experiment_id), metrics)
    agg = r.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count("is_correct").alias("completed_runs"),
        F.sum(iflag(F.col("is_correct").isNull())).alias("failed_runs"),
        F.avg(flag(F.col("is_correct"))).alias("accuracy"),
        F.avg("execution_time_ms").alias("avg_execution_time_ms"),
        F.sum("cost_estimate").alias("total_cost"),
        F.sort_array(F.collect_set("approach_name")).alias("approaches_tested"),
        F.sort_array(F.collect_set("model")).alias("models_used"),
        (F.sum("ok") / F.sum("w")).alias("parsing_success_rate"),
        F.max("created_at").alias("last_run_at"),
    )
    return experiment_overview(experiments, agg, experiment_id)


def experiment_overview(experiments: DataFrame, agg: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """Every experiment with its aggregates, zeros when it has no runs."""
    e = experiments if experiment_id is None else experiments.filter(F.col("id") == experiment_id)
    e = e.select(F.col("id").alias("experiment_id"), "name", "status", "created_at")
    out = e.join(agg, "experiment_id", "left")
    return out.select(
        "experiment_id",
        "name",
        "status",
        F.coalesce("total_runs", F.lit(0)).cast("long").alias("total_runs"),
        F.coalesce("completed_runs", F.lit(0)).cast("long").alias("completed_runs"),
        F.coalesce("failed_runs", F.lit(0)).cast("long").alias("failed_runs"),
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("avg_execution_time_ms", F.lit(0.0)).alias("avg_execution_time_ms"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        F.coalesce("approaches_tested", F.array().cast("array<string>")).alias("approaches_tested"),
        F.size(F.coalesce("approaches_tested", F.array())).cast("long").alias("approach_count"),
        F.coalesce("models_used", F.array().cast("array<string>")).alias("models_used"),
        F.size(F.coalesce("models_used", F.array())).cast("long").alias("model_count"),
        F.coalesce("parsing_success_rate", F.lit(0.0)).alias("parsing_success_rate"),
        F.col("created_at"),
        F.coalesce("last_run_at", "created_at").alias("last_updated"),
    )


def compare_approaches(
    runs: DataFrame, metrics: DataFrame, experiment_id: str | None = None, approaches: Iterable[str] | None = None
) -> DataFrame:
    """Per (experiment, approach) over the fanning runs x metrics join:
    samples, accuracy, avg time, cost, avg confidence, failure rate, parsing
    success. Ordered by accuracy desc within an experiment."""
    r = _weighted(filter_approaches(_exp(runs, experiment_id), approaches), metrics)
    w = F.col("w")

    def wavg(c: str) -> Column:
        return F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))

    out = r.groupBy("experiment_id", "approach_name").agg(
        F.sum(w).alias("sample_count"),
        (F.sum(w * flag(F.col("is_correct"))) / F.sum(w)).alias("accuracy"),
        wavg("execution_time_ms").alias("avg_execution_time_ms"),
        F.sum(w * F.col("cost_estimate")).alias("total_cost"),
        wavg("parsing_confidence").alias("confidence_avg"),
        (F.sum(w * flag(F.col("is_correct").isNull())) / F.sum(w)).alias("failure_rate"),
        (F.sum("ok") / F.sum(w)).alias("parsing_success_rate"),
    )
    return approach_comparison(out)


def approach_comparison(agg: DataFrame) -> DataFrame:
    """Aggregates per (experiment, approach), zeros for missing ones, best accuracy first within an experiment."""
    out = agg.select(
        "experiment_id",
        "approach_name",
        F.col("sample_count").cast("long").alias("sample_count"),
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("avg_execution_time_ms", F.lit(0.0)).alias("avg_execution_time_ms"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        F.coalesce("confidence_avg", F.lit(0.0)).alias("confidence_avg"),
        F.coalesce("failure_rate", F.lit(0.0)).alias("failure_rate"),
        F.coalesce("parsing_success_rate", F.lit(0.0)).alias("parsing_success_rate"),
    )
    return out.orderBy("experiment_id", F.col("accuracy").desc(), "approach_name")


def accuracy_by_approach(runs: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """total, correct, accuracy per approach; NULL verdicts excluded."""
    r = _exp(runs, experiment_id).filter(F.col("is_correct").isNotNull())
    return r.groupBy("experiment_id", "approach_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(iflag(F.col("is_correct"))).alias("correct"),
        F.avg(flag(F.col("is_correct"))).alias("accuracy"),
    )


def accuracy_by_model(runs: DataFrame, experiment_id: str | None = None) -> DataFrame:
    r = _exp(runs, experiment_id).filter(F.col("is_correct").isNotNull())
    return r.groupBy("experiment_id", "model").agg(
        F.avg(flag(F.col("is_correct"))).alias("accuracy"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def parsing_effectiveness(runs: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """Per parsing method: count, avg confidence, accuracy (NULL verdict = wrong)."""
    r = _exp(runs, experiment_id).filter(F.col("parsing_method").isNotNull())
    return r.groupBy("experiment_id", "parsing_method").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("parsing_confidence").alias("avg_confidence"),
        F.avg(flag(F.col("is_correct"))).alias("accuracy"),
    )


def _failures(runs: DataFrame, metrics: DataFrame, experiment_id: str | None) -> DataFrame:
    """Wrong runs with their metric rows, typed; one row per (run, error text)
    with the number ``w`` of metric rows behind it (at least 1).

    Metrics are first counted per (run_id, error_details) - a partial
    aggregate, so repeated texts of a run are combined map-side; a run with many
    different texts is split like any skewed key of ``fanout_left_join``."""
    r = _exp(runs, experiment_id).filter(F.col("is_correct") == F.lit(False))
    m = metrics.groupBy("run_id", "error_details").agg(F.count(F.lit(1)).alias("_w"))
    j = fanout_left_join(r, m)
    parsed_empty = F.coalesce(F.col("parsed_answer"), F.lit("")) == ""
    has_error = F.coalesce(F.col("error_details"), F.lit("")) != ""
    return j.select(
        "experiment_id",
        F.col("id").alias("run_id"),
        "created_at",
        F.col("approach_name").alias("approach"),
        "model",
        truncate_text(F.col("input_text"), 100).alias("input"),
        F.col("expected_answer").alias("expected"),
        F.col("parsed_answer").alias("parsed"),
        "parsing_method",
        F.col("error_details").alias("error"),
        F.when(parsed_empty, "parsing_failed")
        .when(has_error, "execution_error")
        .otherwise("incorrect_answer")
        .alias("failure_type"),
        F.coalesce(F.col("_w"), F.lit(1)).cast("long").alias("w"),
    )


def failure_patterns(
    runs: DataFrame, metrics: DataFrame, experiment_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Wrong runs typed and grouped by (failure type, approach, model) with a
    count and up to 3 examples; counts include the metric fan-out, as in the
    reference.  ``limit`` keeps the first n failures per experiment by
    (created_at, run id); None analyses all.

    Counts are partial aggregates of the weights; examples come from a
    ``row_number() <= 3`` filter (planned with a map-side group limit) over
    rows repeated at most 3 times, so a hot group never ships all its rows to
    one task."""
    f = _failures(runs, metrics, experiment_id)
    order = ["created_at", "run_id", "error"]
    # a (run, error) row stands for w identical failures: three copies suffice
    # for the examples, ``limit`` copies for a row limit (both small)
    copies = 3 if limit is None else max(int(limit), 3)
    f = f.select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("w"), F.lit(copies)))).alias("_copy"))
    if limit is not None:
        w_exp = Window.partitionBy("experiment_id").orderBy(*order, "_copy")
        f = f.withColumn("_n", F.row_number().over(w_exp)).filter(F.col("_n") <= limit).drop("_n")
        f = f.withColumn("w", F.lit(1).cast("long"))
    else:
        f = f.withColumn("w", F.when(F.col("_copy") == 1, F.col("w")).otherwise(F.lit(0)).cast("long"))
    keys = ["experiment_id", "failure_type", "approach", "model"]
    counts = f.groupBy(*keys).agg(F.sum("w").alias("count"))
    g = Window.partitionBy(*keys).orderBy(*order, "_copy")
    ex = f.withColumn("_k", F.row_number().over(g)).filter(F.col("_k") <= 3)
    examples = ex.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_k").cast("long").alias("k"), "input", "expected", "parsed"))).alias(
            "examples")
    )
    return counts.join(examples, keys)


def run_summary(results: DataFrame, errors: DataFrame, approaches: Iterable[str] | None = None) -> DataFrame:
    """Per approach: samples, success rate ok/(ok+errors), avg time, avg
    tokens, cost, errors, accuracy; zeros when an approach has no results.

    results: experiment_id, approach, expected_output, extracted_answer, text,
    execution_time, total_tokens, cost_estimate. errors: experiment_id, approach.
    """
    actual = F.lower(pystrip(answer_or_text("extracted_answer", "text")))
    expected = F.lower(pystrip(F.coalesce(F.col("expected_output").cast("string"), F.lit(""))))
    ok = results.groupBy("experiment_id", "approach").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.avg("execution_time").alias("avg_execution_time"),
        F.avg("total_tokens").alias("avg_tokens"),
        F.sum("cost_estimate").alias("total_cost"),
        F.sum(iflag((expected != "") & (expected == actual))).alias("correct"),
    )
    er = errors.groupBy("experiment_id", "approach").agg(F.count(F.lit(1)).alias("error_count"))
    j = ok.join(er, ["experiment_id", "approach"], "full_outer")
    if approaches is not None:
        j = j.filter(F.col("approach").isin(list(approaches)))
    n = F.coalesce(F.col("total_samples"), F.lit(0))
    e = F.coalesce(F.col("error_count"), F.lit(0))
    return j.select(
        "experiment_id",
        "approach",
        n.cast("long").alias("total_samples"),
        F.when(n > 0, n / (n + e)).otherwise(F.lit(0.0)).alias("success_rate"),
        F.coalesce("avg_execution_time", F.lit(0.0)).alias("avg_execution_time"),
        F.coalesce("avg_tokens", F.lit(0.0)).alias("avg_tokens"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        e.cast("long").alias("error_count"),
        F.when(n > 0, F.col("correct") / n).otherwise(F.lit(0.0)).alias("accuracy"),
    )


def cost_summary(runs: DataFrame, cost_col: str = "cost_estimate") -> DataFrame:
    """Per (experiment, approach) cost and count, with the experiment total,
    request count and average per request (divided by max(1, n))."""
    per = runs.groupBy("experiment_id", "approach_name").agg(
        F.sum(cost_col).alias("approach_cost"), F.count(F.lit(1)).alias("approach_count")
    )
    w = Window.partitionBy("experiment_id")
    total = F.sum("approach_cost").over(w)
    reqs = F.sum("approach_count").over(w)
    return per.select(
        "experiment_id",
        "approach_name",
        "approach_cost",
        "approach_count",
        total.alias("total_cost"),
        reqs.alias("total_requests"),
        (total / F.greatest(reqs, F.lit(1))).alias("average_cost_per_request"),
    )


def cost_by_provider_model(runs: DataFrame, tokens_col: str = "total_tokens", cost_col: str = "cost_estimate") -> DataFrame:
    """Requests, tokens, cost per (provider, model) plus one TOTAL row
    (``GROUPING SETS ((provider, model), ())``)."""
    g = runs.groupingSets([[F.col("provider"), F.col("model")], []], F.col("provider"), F.col("model"))
    out = g.agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(tokens_col).alias("tokens"),
        F.sum(cost_col).alias("cost"),
        F.grouping_id().alias("_gid"),
    )
    return out.select(
        F.when(F.col("_gid") == 0, F.col("provider")).otherwise(F.lit("")).alias("provider"),
        F.when(F.col("_gid") == 0, F.col("model")).otherwise(F.lit("TOTAL")).alias("model"),
        "requests",
        "tokens",
        "cost",
    )


def performance_summary(runs: DataFrame, time_col: str = "execution_time_ms", tokens_col: str = "total_tokens") -> DataFrame:
    return runs.groupBy("experiment_id", "approach_name").agg(
        F.avg(time_col).alias("average_time"),
        F.min(time_col).alias("min_time"),
        F.max(time_col).alias("max_time"),
        F.avg(tokens_col).alias("average_tokens"),
        F.count(F.lit(1)).alias("total_executions"),
    )


def response_time_stats(calls: DataFrame, keys: Iterable[str] = (), total_time: Column | None = None) -> DataFrame:
    """n ok/failed, total time, mean, sample sd, min, max, throughput, token
    stats of successful calls. ``calls``: success, duration, tokens."""
    keys = list(keys)
    ok = F.col("success")
    dur = F.when(ok, F.col("duration"))
    tok = F.when(ok, F.col("tokens"))
    g = calls.groupBy(*keys) if keys else calls.groupBy()
    out = g.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.sum(iflag(ok)).alias("successful"),
        F.sum(iflag(~ok)).alias("failed"),
        F.sum("duration").alias("total_time"),
        F.avg(dur).alias("avg_response_time"),
        F.stddev_samp(dur).alias("sd_response_time"),
        F.min(dur).alias("min_response_time"),
        F.max(dur).alias("max_response_time"),
        F.coalesce(F.sum(tok), F.lit(0)).cast("long").alias("total_tokens"),
        F.avg(tok).alias("avg_tokens"),
        F.stddev_samp(tok).alias("sd_tokens"),
        F.min(tok).alias("min_tokens"),
        F.max(tok).alias("max_tokens"),
    )
    return out.withColumn(
        "throughput",
        F.when(F.col("total_time") > 0, F.col("successful") / F.col("total_time")).otherwise(F.lit(0.0)),
    )


def approach_ranking_rounded(runs: DataFrame) -> DataFrame:
    """accuracy to 3 places, avg ms to 1 place, n; accuracy desc."""
    out = runs.groupBy("approach_name").agg(
        F.round(F.avg(F.col("is_correct").cast("double")), 3).alias("accuracy"),
        F.round(F.avg("execution_time_ms"), 1).alias("avg_time_ms"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    return out.orderBy(F.col("accuracy").desc_nulls_last(), "approach_name")


def cost_benefit(runs: DataFrame, baseline: str = "None") -> DataFrame:
    """accuracy, avg cost, avg seconds and accuracy per dollar (NULL when the
    cost is 0), baseline excluded."""
    r = runs.filter(F.col("approach_name") != baseline)
    acc = F.avg(F.col("is_correct").cast("double"))
    cost = F.avg("cost_estimate")
    out = r.groupBy("approach_name").agg(
        F.round(acc, 3).alias("accuracy"),
        F.round(cost, 6).alias("avg_cost"),
        F.round(F.avg("execution_time_ms") / 1000.0, 1).alias("avg_seconds"),
        F.round(F.try_divide(acc, F.when(cost != 0, cost)), 2).alias("accuracy_per_dollar"),
    )
    return out.orderBy(F.col("accuracy_per_dollar").desc_nulls_last(), "approach_name")


def approach_moments(runs: DataFrame, keys: Iterable[str] = ("experiment_id", "approach_name")) -> DataFrame:
    """mean, sd, n of the verdict; mean and (exact) median time; cost sum."""
    keys = list(keys)
    v = F.col("is_correct").cast("double")
    moments = runs.groupBy(*keys).agg(
        F.avg(v).alias("is_correct_mean"),
        F.stddev_samp(v).alias("is_correct_std"),
        F.count(v).alias("is_correct_count"),
        F.avg("execution_time_ms").alias("execution_time_ms_mean"),
        F.sum("cost_estimate").alias("cost_estimate_sum"),
    )
    # exact median from ranks: no group is held whole in one task
    med = exact_quantiles(runs, keys, "execution_time_ms", {"execution_time_ms_median": 0.5})
    return moments.join(med, keys, "left")


def approach_metrics(runs: DataFrame, benchmark_id: Column | None = None) -> DataFrame:
    """Runs reduced to one row per (experiment, approach): the input of the
    study statistics."""
    g = runs.groupBy("experiment_id", "approach_name").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(iflag(F.col("is_correct"))).alias("correct_samples"),
        F.sum(iflag(F.col("is_correct").isNull())).alias("error_samples"),
        (F.avg("execution_time_ms") / 1000.0).alias("avg_response_time"),
        F.avg("total_tokens").alias("avg_tokens_used"),
        F.sum("cost_estimate").alias("total_cost"),
        F.max("created_at").alias("ts"),
    )
    g = g.withColumnRenamed("approach_name", "approach")
    if benchmark_id is not None:
        g = g.withColumn("benchmark_id", benchmark_id)
    return g


def describe_metrics(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """count, mean, sd, min, quartiles (exact, linear interpolation), max of
    numeric columns, one row per column.  Moments come from one aggregate;
    quartiles from ranks (``exact_quantiles``), so no column is gathered in
    one task."""
    num = ("int", "bigint", "double", "float", "smallint", "tinyint")
    cols = list(columns) if columns else [c for c, t in df.dtypes if t in num or t.startswith("decimal")]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            ).alias(f"_s{len(aggs)}")
        )
    wide = df.agg(*aggs)
    moments = wide.select(F.explode(F.array(*[F.col(f"_s{i}") for i in range(len(aggs))])).alias("s")).select("s.*")
    # all columns in one ranking pass: unpivot to (column, value)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("_c")).select("_c.*")
    quart = exact_quantiles(long, ["column"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    out = moments.join(quart, "column", "left")
    return out.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named table (one small job per table, unioned)."""
    parts = [df.select(F.lit(name).alias("table_name")).groupBy("table_name").count() for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("count", "row_count")


def preprocessing_usage(links: DataFrame, preprocessing_id: str | None = None) -> DataFrame:
    """Experiments using each preprocessing pass: the count per pass and the
    experiments newest first, one row per (pass, experiment).

    Long form instead of one collected list per pass: a pass used by a very
    large number of experiments must not become one row built in one task.
    """
    l = links if preprocessing_id is None else links.filter(F.col("preprocessing_id") == preprocessing_id)
    ts = F.col("created_at") if "created_at" in links.columns else F.lit(None).cast("timestamp")
    l = l.select("preprocessing_id", "experiment_id", ts.alias("created_at"))
    counts = l.groupBy("preprocessing_id").agg(F.count(F.lit(1)).alias("experiment_count"))
    out = l.join(counts, "preprocessing_id", "inner")
    return out.orderBy("preprocessing_id", F.col("created_at").desc_nulls_last(), "experiment_id")


STEP_SLICE = 4096


def rollup_steps(steps: DataFrame, run_col: str = "run_id", order_col: str = "step", sep: str = "\n\n") -> DataFrame:
    """Multi-call run: sum tokens and time, count steps, refined flag, and the
    step texts joined in step order.

    A run's texts are folded in two levels: steps are put in order by a range sort
    that cuts a long run over tasks, each slice of ``STEP_SLICE`` neighbouring steps is joined
    on its own, and the slices are joined by their place.  So no task sorts or lists all
    steps of a run: what meets in one row is one text a slice, and the result."""
    from .common import running_sums

    runs = steps.groupBy(run_col).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("generation_time").alias("generation_time"),
        F.count(F.lit(1)).alias("step_count"),
        (F.count(F.lit(1)) > 1).alias("refined"),
    )
    text = steps.select(F.col(run_col).alias("_run"), F.col(order_col).alias("_o"), F.col("text").alias("_t"))
    # the run as a struct: rows of a run without a name meet like others
    text = text.withColumn("_run", F.struct("_run"))
    placed = running_sums(text, ["_run"], [F.col("_o").asc_nulls_first(), F.col("_t").asc_nulls_first()], {"_n": F.lit(1)})
    in_order = lambda place, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("t")))), lambda s: s["t"]), sep)
    # a slice of steps without any text joins to nothing and is left out, as a step without one is
    slices = placed.groupBy("_run", F.floor(F.col("_n") / STEP_SLICE).alias("_slice")).agg(
        F.when(F.count("_t") > 0, in_order("_n", "_t")).alias("_text"))
    joined = slices.groupBy("_run").agg(in_order("_slice", "_text").alias("text"))
    joined = joined.select(F.col("_run._run").alias("_run"), "text")
    return runs.join(joined, runs[run_col].eqNullSafe(joined["_run"]), "left").select(*runs.columns, "text")
