"""Registered queries for runs analysis: filters (2.2), joins (2.3), aggregates (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import mask_raw_output, sanitize_name, truncate_text
from ..operators import runs as R
from .registry import query

RM = ("runs_v", "parsing_metrics_v")

# ----------------------------------------------------------------------------- 2.2


@query("filter_experiment", ["runs_v"], section="2.2", oracle="""
SELECT * FROM runs_v WHERE experiment_id = 'exp_3'
""")
def _q(fx):
    return R.filter_experiment(fx.runs_v, "exp_3")


@query("filter_approaches", ["runs_v"], section="2.2", oracle="""
SELECT * FROM runs_v WHERE approach_name IN ('None', 'ChainOfThought')
""")
def _q(fx):
    return R.filter_approaches(fx.runs_v, ["None", "ChainOfThought"])


@query("filter_name_like", ["runs_v", "experiments_v"], section="2.2", oracle="""
SELECT r.*, e.name AS experiment_name
FROM runs_v r JOIN experiments_v e ON r.experiment_id = e.id
WHERE e.name ILIKE '%BBEH%'
""")
def _q(fx):
    return R.filter_name_like(fx.runs_v, fx.experiments_v, "BBEH")


@query("list_experiments", ["experiments_v"], section="2.2", oracle="""
SELECT id, name, status, dataset_name, created_at,
       json_extract_string(config_json, '$.provider') AS config_provider,
       CAST(json_extract_string(config_json, '$.sample_count') AS BIGINT) AS config_sample_count
FROM experiments_v WHERE status = 'completed'
ORDER BY created_at DESC
""")
def _q(fx):
    return R.list_experiments(fx.experiments_v, status="completed")


@query("run_details", RM, section="2.2", oracle="""
SELECT r.*, pm.parsing_attempts, pm.fallback_used, pm.confidence_score AS parsing_confidence_score,
       pm.extraction_time_ms, pm.error_details
FROM runs_v r LEFT JOIN parsing_metrics_v pm ON r.id = pm.run_id
""")
def _q(fx):
    return R.run_details(fx.runs_v, fx.parsing_metrics_v)


@query("filter_difficulty", ["code_v"], section="2.2", oracle="""
SELECT * FROM code_v WHERE lower(difficulty) = 'hard'
""")
def _q(fx):
    return R.filter_difficulty(fx.code_v, "HARD")


@query("mask_raw_output", ["responses_v"], section="2.2", oracle="""
SELECT id, concat('[', CAST(length(raw_output) AS VARCHAR), ' chars]') AS raw_output FROM responses_v
""")
def _q(fx):
    return fx.responses_v.select("id", mask_raw_output("raw_output").alias("raw_output"))


@query("truncate_text", ["runs_v"], section="2.2", oracle="""
SELECT id,
  CASE WHEN length(input_text) > 100 THEN concat(substr(input_text, 1, 100), '...') ELSE input_text END AS input_100,
  CASE WHEN length(input_text) > 30 THEN concat(substr(input_text, 1, 27), '...') ELSE input_text END AS input_30,
  CASE WHEN length(input_text) > 500 THEN concat(substr(input_text, 1, 500), '...') ELSE input_text END AS input_500
FROM runs_v
""")
def _q(fx):
    t = F.col("input_text")
    return fx.runs_v.select(
        "id",
        truncate_text(t, 100).alias("input_100"),
        truncate_text(t, 30, 27).alias("input_30"),
        truncate_text(t, 500).alias("input_500"),
    )


@query("sanitize_name", [], section="2.2", oracle="""
SELECT page_id,
  regexp_replace(regexp_replace(regexp_replace(url, '[/\\\\:*?"<>| ]', '_', 'g'), '_{2,}', '_', 'g'), '^_+|_+$', '', 'g') AS safe_name
FROM pages
""")
def _q(fx):
    return fx.pages.select("page_id", sanitize_name("url").alias("safe_name"))


@query("performance_metrics", ["runs_v"], section="2.2", oracle="""
SELECT id, approach_name, CAST(execution_time_ms AS DOUBLE) / 1000 AS execution_time, total_tokens,
       total_tokens - total_tokens // 3 AS prompt_tokens, total_tokens // 3 AS completion_tokens,
       cost_estimate, length(input_text) AS response_length, CAST(1 AS BIGINT) AS reasoning_depth,
       CASE WHEN approach_name = 'TreeOfThought' THEN CAST(1 AS BIGINT) END AS branch_exploration,
       CASE WHEN approach_name = 'TreeOfThought' THEN 'unknown' END AS selected_path,
       CAST(NULL AS BIGINT) AS verification_steps, CAST(NULL AS DOUBLE) AS verification_confidence,
       CAST(NULL AS BIGINT) AS outline_depth, CAST(NULL AS DOUBLE) AS expansion_ratio,
       CAST(NULL AS BIGINT) AS planning_stages, CAST(NULL AS BIGINT) AS risk_assessments
FROM runs_v
""")
def _q(fx):
    r = fx.runs_v.select(
        "id",
        "approach_name",
        (F.col("execution_time_ms").cast("double") / 1000).alias("execution_time"),
        "total_tokens",
        (F.col("total_tokens") - F.floor(F.col("total_tokens") / 3)).cast("long").alias("prompt_tokens"),
        F.floor(F.col("total_tokens") / 3).cast("long").alias("completion_tokens"),
        "cost_estimate",
        F.col("input_text").alias("text"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    return R.performance_metrics(r)


@query("performance_metrics_metadata", ["runs_v"], section="2.2", oracle="""
WITH r AS (
  SELECT *, CASE sample_index % 8 WHEN 0 THEN 'TreeOfThought' WHEN 1 THEN 'ChainOfVerification' WHEN 2 THEN 'SkeletonOfThought'
                 WHEN 3 THEN 'AsPlanning' WHEN 4 THEN 'GraphOfThought' ELSE approach_name END AS a,
         sample_index % 3 > 0 AS has, sample_index % 11 AS m FROM runs_v)
SELECT id, a AS approach_name, CAST(execution_time_ms AS DOUBLE) / 1000 AS execution_time, total_tokens,
       total_tokens - total_tokens // 3 AS prompt_tokens, total_tokens // 3 AS completion_tokens, cost_estimate, length(input_text) AS response_length,
       CASE WHEN has THEN m ELSE 1 END AS reasoning_depth,
       CASE WHEN a IN ('TreeOfThought', 'GraphOfThought') THEN CASE WHEN has THEN m + 1 ELSE 1 END END AS branch_exploration,
       CASE WHEN a IN ('TreeOfThought', 'GraphOfThought') THEN CASE WHEN has THEN concat('path ', CAST(m AS VARCHAR)) ELSE 'unknown' END END AS selected_path,
       CASE WHEN a = 'ChainOfVerification' THEN CASE WHEN has THEN m + 2 ELSE 1 END END AS verification_steps,
       CASE WHEN a = 'ChainOfVerification' THEN CASE WHEN has THEN CAST(m AS DOUBLE) / 16 ELSE 0.5 END END AS verification_confidence,
       CASE WHEN a = 'SkeletonOfThought' THEN CASE WHEN has THEN m + 3 ELSE 1 END END AS outline_depth,
       CASE WHEN a = 'SkeletonOfThought' THEN CASE WHEN has THEN CAST(m AS DOUBLE) / 4 ELSE 1.0 END END AS expansion_ratio,
       CASE WHEN a = 'AsPlanning' THEN CASE WHEN has THEN m + 4 ELSE 1 END END AS planning_stages,
       CASE WHEN a = 'AsPlanning' THEN CASE WHEN has THEN m + 5 ELSE 0 END END AS risk_assessments
FROM r
""")
def _q(fx):
    """The approach-specific fields from metadata maps: a third of the runs have none and get the defaults."""
    s, m = F.col("sample_index"), F.col("sample_index") % 11
    approach = F.when(s % 8 < 5, F.element_at(F.array(*map(F.lit, ("TreeOfThought", "ChainOfVerification", "SkeletonOfThought", "AsPlanning", "GraphOfThought"))),
                                              F.least(s % 8, F.lit(4)).cast("int") + 1)).otherwise(F.col("approach_name"))
    fields = {"reasoning_steps": m, "branches_explored": m + 1, "selected_path": F.concat(F.lit("path "), m.cast("string")), "verification_count": m + 2,
              "verification_confidence": m / 16, "outline_depth": m + 3, "expansion_ratio": m / 4, "planning_stages": m + 4, "risk_assessments": m + 5}
    metadata = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    r = fx.runs_v.select(
        "id",
        approach.alias("approach_name"),
        (F.col("execution_time_ms").cast("double") / 1000).alias("execution_time"),
        "total_tokens",
        (F.col("total_tokens") - F.floor(F.col("total_tokens") / 3)).cast("long").alias("prompt_tokens"),
        F.floor(F.col("total_tokens") / 3).cast("long").alias("completion_tokens"),
        "cost_estimate",
        F.col("input_text").alias("text"),
        F.when(s % 3 > 0, metadata).alias("metadata"),
    )
    return R.performance_metrics(r)


@query("accuracy_breakdown", ["runs_v"], section="2.2", oracle="""
WITH b AS (
  SELECT id AS sample_id, coalesce(expected_answer, 'N/A') AS e,
         coalesce(CASE WHEN regexp_replace(parsed_answer, '^\\s+|\\s+$', '', 'g') <> '' THEN parsed_answer ELSE input_text END, 'N/A') AS a
  FROM runs_v)
SELECT sample_id,
  CASE WHEN length(e) > 30 THEN concat(substr(e, 1, 27), '...') ELSE e END AS expected,
  CASE WHEN length(a) > 30 THEN concat(substr(a, 1, 27), '...') ELSE a END AS actual,
  lower(regexp_replace(e, '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(a, '^\\s+|\\s+$', '', 'g')) AS correct
FROM b
""")
def _q(fx):
    r = fx.runs_v.select(
        F.col("id").alias("sample_id"),
        F.col("expected_answer").alias("expected_output"),
        F.col("parsed_answer").alias("extracted_answer"),
        F.col("input_text").alias("response_text"),
    )
    return R.accuracy_breakdown(r)


# ----------------------------------------------------------------------------- 2.3


@query("runs_with_metrics", RM, section="2.3", oracle="""
SELECT r.*, pm.parsing_attempts, pm.fallback_used, pm.confidence_score AS parsing_confidence_score,
       pm.extraction_time_ms AS parsing_time_ms, pm.error_details
FROM runs_v r LEFT JOIN parsing_metrics_v pm ON r.id = pm.run_id
""")
def _q(fx):
    return R.runs_with_metrics(fx.runs_v, fx.parsing_metrics_v)


@query("runs_latest_metrics", RM, section="2.3", oracle="""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS rn FROM parsing_metrics_v)
SELECT r.*, m.parsing_attempts, m.fallback_used, m.confidence_score AS parsing_confidence_score,
       m.extraction_time_ms AS parsing_time_ms, m.error_details
FROM runs_v r LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON r.id = m.run_id
""")
def _q(fx):
    return R.runs_latest_metrics(fx.runs_v, fx.parsing_metrics_v)


@query("experiment_lineage", ["prep_link_v", "preprocessing_v"], section="2.3", oracle="""
SELECT l.id AS link_id, l.experiment_id, l.preprocessing_id, l.dataset_name AS link_dataset_name,
       p.id AS prep_id, p.dataset_name AS prep_dataset_name, p.dataset_config AS prep_dataset_config,
       p.status AS prep_status, p.confidence_score AS prep_confidence_score,
       p.original_samples AS prep_original_samples, p.processed_samples AS prep_processed_samples,
       p.processed_at AS prep_processed_at
FROM prep_link_v l JOIN preprocessing_v p ON l.preprocessing_id = p.id
""")
def _q(fx):
    return R.experiment_lineage(fx.prep_link_v, fx.preprocessing_v)


@query("runs_with_experiment", ["runs_v", "experiments_v"], section="2.3", oracle="""
SELECT r.*, e.name AS experiment_name, e.status AS experiment_status
FROM runs_v r JOIN experiments_v e ON r.experiment_id = e.id
""")
def _q(fx):
    return R.runs_with_experiment(fx.runs_v, fx.experiments_v)


@query("unprocessed_datasets", ["preprocessing_v"], section="2.3", oracle="""
WITH registry AS (
  SELECT concat('ds_', CAST(item_id % 8 AS VARCHAR)) AS name, concat('hub/set', CAST(item_id AS VARCHAR)) AS dataset_url,
         CASE WHEN item_id % 2 = 0 THEN 'qa' ELSE 'mcq' END AS category FROM benchmark)
SELECT name, dataset_url AS url, '' AS description, category AS task_type, 'unprocessed' AS status
FROM registry g
WHERE NOT EXISTS (SELECT 1 FROM preprocessing_v p WHERE p.status = 'processed' AND p.dataset_name = g.name)
""")
def _q(fx):
    # a dataset registry derived from the benchmark items (ds_0 .. ds_7), with
    # the alternative column names: name, dataset_url, category
    registry = fx.benchmark.select(
        F.concat(F.lit("ds_"), (F.col("item_id") % 8).cast("string")).alias("name"),
        F.concat(F.lit("hub/set"), F.col("item_id").cast("string")).alias("dataset_url"),
        F.when(F.col("item_id") % 2 == 0, F.lit("qa")).otherwise(F.lit("mcq")).alias("category"),
    )
    return R.unprocessed_datasets(registry, fx.preprocessing_v)


APPROACHES = ["None", "ChainOfThought", "ProgramOfThought", "AsPlanning", "Reflection",
              "ChainOfVerification", "SkeletonOfThought", "TreeOfThought"]


@query("sample_approach_grid", [], section="2.3", oracle="""
SELECT b.item_id, b.text, a.approach
FROM benchmark b CROSS JOIN (VALUES ('None'), ('ChainOfThought'), ('ProgramOfThought'), ('AsPlanning'),
  ('Reflection'), ('ChainOfVerification'), ('SkeletonOfThought'), ('TreeOfThought')) AS a(approach)
""")
def _q(fx):
    return R.sample_approach_grid(fx.benchmark, APPROACHES)


@query("baseline_overhead", ["approach_metrics_v"], section="2.3", oracle="""
SELECT m.experiment_id, m.approach,
  CASE WHEN b.avg_response_time > 0 THEN m.avg_response_time / b.avg_response_time ELSE 1.0 END AS time_overhead,
  CASE WHEN b.avg_tokens_used > 0 THEN m.avg_tokens_used / b.avg_tokens_used ELSE 1.0 END AS token_overhead
FROM approach_metrics_v m JOIN approach_metrics_v b ON m.experiment_id = b.experiment_id AND b.approach = 'None'
""")
def _q(fx):
    return R.baseline_overhead(fx.approach_metrics_v)


@query("orphan_rows", ["runs_v", "experiments_v", "parsing_metrics_v", "prep_link_v", "preprocessing_v"], section="2.3", oracle="""
SELECT 'runs' AS table_name, id AS row_id, 'runs.experiment_id->experiments.id' AS fk, experiment_id AS missing_parent
FROM runs_v WHERE experiment_id NOT IN (SELECT id FROM experiments_v)
UNION ALL
SELECT 'parsing_metrics', CAST(id AS VARCHAR), 'parsing_metrics.run_id->runs.id', run_id
FROM parsing_metrics_v WHERE run_id NOT IN (SELECT id FROM runs_v)
UNION ALL
SELECT 'preprocessing_eval_link', CAST(id AS VARCHAR), 'link.experiment_id->experiments.id', experiment_id
FROM prep_link_v WHERE experiment_id NOT IN (SELECT id FROM experiments_v)
UNION ALL
SELECT 'preprocessing_eval_link', CAST(id AS VARCHAR), 'link.preprocessing_id->dataset_preprocessing.id', preprocessing_id
FROM prep_link_v WHERE preprocessing_id NOT IN (SELECT id FROM preprocessing_v)
""")
def _q(fx):
    return R.orphan_rows(fx.runs_v, fx.experiments_v, fx.parsing_metrics_v, fx.prep_link_v, fx.preprocessing_v)


@query("pending_samples", ["runs_v"], section="2.3", oracle="""
WITH grid AS (
  SELECT b.item_id AS sample_id, a.approach FROM benchmark b
  CROSS JOIN (VALUES ('None'), ('ChainOfThought'), ('ProgramOfThought'), ('AsPlanning'),
    ('Reflection'), ('ChainOfVerification'), ('SkeletonOfThought'), ('TreeOfThought')) AS a(approach)),
done AS (
  SELECT sample_index AS sample_id, approach_name AS approach FROM runs_v)
SELECT g.* FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.sample_id = g.sample_id AND d.approach = g.approach)
""")
def _q(fx):
    grid = R.sample_approach_grid(fx.benchmark.select(F.col("item_id").alias("sample_id")), APPROACHES)
    r = fx.runs_v
    results = r.filter(F.col("is_correct").isNotNull()).select(
        F.col("sample_index").alias("sample_id"), F.col("approach_name").alias("approach"))
    errors = r.filter(F.col("is_correct").isNull()).select(
        F.col("sample_index").alias("sample_id"), F.col("approach_name").alias("approach"))
    return R.pending_samples(grid, results, errors)


# ----------------------------------------------------------------------------- 2.4


@query("experiment_summary", ("runs_v", "parsing_metrics_v", "experiments_v"), section="2.4", oracle="""
WITH s AS (
  SELECT experiment_id, count(*) AS total_runs,
         CAST(sum(CASE WHEN is_correct IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS completed_runs,
         CAST(sum(CASE WHEN is_correct IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed_runs,
         avg(CASE WHEN is_correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy,
         avg(execution_time_ms) AS avg_execution_time_ms, sum(cost_estimate) AS total_cost,
         list_sort(list(DISTINCT approach_name)) AS approaches_tested,
         count(DISTINCT approach_name) AS approach_count,
         list_sort(list(DISTINCT model)) AS models_used, count(DISTINCT model) AS model_count,
         max(created_at) AS last_run_at
  FROM runs_v GROUP BY experiment_id),
p AS (
  SELECT r.experiment_id,
         avg(CASE WHEN pm.confidence_score > 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS parsing_success_rate
  FROM runs_v r LEFT JOIN parsing_metrics_v pm ON r.id = pm.run_id GROUP BY r.experiment_id)
SELECT e.id AS experiment_id, e.name, e.status,
       coalesce(s.total_runs, 0) AS total_runs, coalesce(s.completed_runs, 0) AS completed_runs,
       coalesce(s.failed_runs, 0) AS failed_runs, coalesce(s.accuracy, 0.0) AS accuracy,
       coalesce(s.avg_execution_time_ms, 0.0) AS avg_execution_time_ms, coalesce(s.total_cost, 0.0) AS total_cost,
       coalesce(s.approaches_tested, CAST([] AS VARCHAR[])) AS approaches_tested,
       coalesce(s.approach_count, 0) AS approach_count,
       coalesce(s.models_used, CAST([] AS VARCHAR[])) AS models_used,
       coalesce(s.model_count, 0) AS model_count,
       coalesce(p.parsing_success_rate, 0.0) AS parsing_success_rate,
       e.created_at, coalesce(s.last_run_at, e.created_at) AS last_updated
FROM experiments_v e LEFT JOIN s ON s.experiment_id = e.id LEFT JOIN p ON p.experiment_id = e.id
""")
def _q(fx):
    return R.experiment_summary(fx.runs_v, fx.parsing_metrics_v, fx.experiments_v)


COMPARE_SQL = """
SELECT r.experiment_id, r.approach_name, count(*) AS sample_count,
  coalesce(avg(CASE WHEN r.is_correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0.0) AS accuracy,
  coalesce(avg(r.execution_time_ms), 0.0) AS avg_execution_time_ms,
  coalesce(sum(r.cost_estimate), 0.0) AS total_cost,
  coalesce(avg(r.parsing_confidence), 0.0) AS confidence_avg,
  coalesce(avg(CASE WHEN r.is_correct IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0.0) AS failure_rate,
  coalesce(avg(CASE WHEN pm.confidence_score > 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0.0) AS parsing_success_rate
FROM runs_v r LEFT JOIN parsing_metrics_v pm ON r.id = pm.run_id
GROUP BY r.experiment_id, r.approach_name
ORDER BY r.experiment_id, accuracy DESC
"""


@query("compare_approaches", RM, section="2.4", oracle=COMPARE_SQL)
def _q(fx):
    return R.compare_approaches(fx.runs_v, fx.parsing_metrics_v)


@query("accuracy_by_approach", ["runs_v"], section="2.4", oracle="""
SELECT experiment_id, approach_name, count(*) AS total,
       CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       avg(CASE WHEN is_correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy
FROM runs_v WHERE is_correct IS NOT NULL GROUP BY experiment_id, approach_name
""")
def _q(fx):
    return R.accuracy_by_approach(fx.runs_v)


@query("accuracy_by_model", ["runs_v"], section="2.4", oracle="""
SELECT experiment_id, model,
       avg(CASE WHEN is_correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy,
       count(*) AS sample_count
FROM runs_v WHERE is_correct IS NOT NULL GROUP BY experiment_id, model
""")
def _q(fx):
    return R.accuracy_by_model(fx.runs_v)


@query("parsing_effectiveness", ["runs_v"], section="2.4", oracle="""
SELECT experiment_id, parsing_method, count(*) AS count, avg(parsing_confidence) AS avg_confidence,
       avg(CASE WHEN is_correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy
FROM runs_v WHERE parsing_method IS NOT NULL GROUP BY experiment_id, parsing_method
""")
def _q(fx):
    return R.parsing_effectiveness(fx.runs_v)


@query("failure_patterns", RM, section="2.4", oracle="""
WITH f AS (
  SELECT r.experiment_id, r.id AS run_id, r.created_at, r.approach_name AS approach, r.model,
    CASE WHEN length(r.input_text) > 100 THEN concat(substr(r.input_text, 1, 100), '...') ELSE r.input_text END AS input,
    r.expected_answer AS expected, r.parsed_answer AS parsed, pm.error_details AS error,
    CASE WHEN coalesce(r.parsed_answer, '') = '' THEN 'parsing_failed'
         WHEN coalesce(pm.error_details, '') <> '' THEN 'execution_error'
         ELSE 'incorrect_answer' END AS failure_type
  FROM runs_v r LEFT JOIN parsing_metrics_v pm ON r.id = pm.run_id
  WHERE r.is_correct = FALSE),
k AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, failure_type, approach, model
                                   ORDER BY created_at, run_id, error) AS k FROM f)
SELECT experiment_id, failure_type, approach, model, count(*) AS count,
  list({'k': k, 'input': input, 'expected': expected, 'parsed': parsed} ORDER BY k) FILTER (WHERE k <= 3) AS examples
FROM k GROUP BY experiment_id, failure_type, approach, model
""")
def _q(fx):
    return R.failure_patterns(fx.runs_v, fx.parsing_metrics_v)


def _results_errors(fx):
    r = fx.runs_v
    results = r.filter(F.col("is_correct").isNotNull()).select(
        "experiment_id",
        F.col("approach_name").alias("approach"),
        F.col("expected_answer").alias("expected_output"),
        F.col("parsed_answer").alias("extracted_answer"),
        F.col("input_text").alias("text"),
        (F.col("execution_time_ms") / 1000.0).alias("execution_time"),
        "total_tokens",
        "cost_estimate",
    )
    errors = r.filter(F.col("is_correct").isNull()).select("experiment_id", F.col("approach_name").alias("approach"))
    return results, errors


@query("run_summary", ["runs_v"], section="2.4", oracle="""
WITH ok AS (
  SELECT experiment_id, approach_name AS approach, count(*) AS n,
    avg(execution_time_ms / 1000.0) AS avg_execution_time, avg(total_tokens) AS avg_tokens,
    sum(cost_estimate) AS total_cost,
    sum(CASE WHEN lower(regexp_replace(coalesce(expected_answer, ''), '^\\s+|\\s+$', '', 'g')) <> ''
              AND lower(regexp_replace(coalesce(expected_answer, ''), '^\\s+|\\s+$', '', 'g')) =
                  lower(regexp_replace(CASE WHEN regexp_replace(parsed_answer, '^\\s+|\\s+$', '', 'g') <> ''
                                            THEN parsed_answer ELSE input_text END, '^\\s+|\\s+$', '', 'g'))
             THEN 1 ELSE 0 END) AS correct
  FROM runs_v WHERE is_correct IS NOT NULL GROUP BY 1, 2),
er AS (SELECT experiment_id, approach_name AS approach, count(*) AS e FROM runs_v WHERE is_correct IS NULL GROUP BY 1, 2)
SELECT coalesce(ok.experiment_id, er.experiment_id) AS experiment_id, coalesce(ok.approach, er.approach) AS approach,
  coalesce(n, 0) AS total_samples,
  CASE WHEN coalesce(n, 0) > 0 THEN n / CAST(n + coalesce(e, 0) AS DOUBLE) ELSE 0.0 END AS success_rate,
  coalesce(avg_execution_time, 0.0) AS avg_execution_time, coalesce(avg_tokens, 0.0) AS avg_tokens,
  coalesce(total_cost, 0.0) AS total_cost, coalesce(e, 0) AS error_count,
  CASE WHEN coalesce(n, 0) > 0 THEN correct / CAST(n AS DOUBLE) ELSE 0.0 END AS accuracy
FROM ok FULL OUTER JOIN er ON ok.experiment_id = er.experiment_id AND ok.approach = er.approach
""")
def _q(fx):
    results, errors = _results_errors(fx)
    return R.run_summary(results, errors)


@query("cost_summary", ["runs_v"], section="2.4", oracle="""
WITH p AS (SELECT experiment_id, approach_name, sum(cost_estimate) AS approach_cost, count(*) AS approach_count
           FROM runs_v GROUP BY 1, 2)
SELECT experiment_id, approach_name, approach_cost, approach_count,
  sum(approach_cost) OVER (PARTITION BY experiment_id) AS total_cost,
  CAST(sum(approach_count) OVER (PARTITION BY experiment_id) AS BIGINT) AS total_requests,
  sum(approach_cost) OVER (PARTITION BY experiment_id) / greatest(sum(approach_count) OVER (PARTITION BY experiment_id), 1) AS average_cost_per_request
FROM p
""")
def _q(fx):
    return R.cost_summary(fx.runs_v)


@query("cost_by_provider_model", ["runs_v"], section="2.4", oracle="""
SELECT provider, model, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens, sum(cost_estimate) AS cost
FROM runs_v GROUP BY provider, model
UNION ALL
SELECT '', 'TOTAL', count(*), CAST(sum(total_tokens) AS BIGINT), sum(cost_estimate) FROM runs_v
""")
def _q(fx):
    return R.cost_by_provider_model(fx.runs_v)


@query("performance_summary", ["runs_v"], section="2.4", oracle="""
SELECT experiment_id, approach_name, avg(execution_time_ms) AS average_time, min(execution_time_ms) AS min_time,
       max(execution_time_ms) AS max_time, avg(total_tokens) AS average_tokens, count(*) AS total_executions
FROM runs_v GROUP BY 1, 2
""")
def _q(fx):
    return R.performance_summary(fx.runs_v)


@query("response_time_stats", ["call_log_v"], section="2.4", oracle="""
SELECT provider, count(*) AS total_tests,
  CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successful,
  CAST(sum(CASE WHEN NOT success THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  sum(duration) AS total_time,
  avg(CASE WHEN success THEN duration END) AS avg_response_time,
  stddev_samp(CASE WHEN success THEN duration END) AS sd_response_time,
  min(CASE WHEN success THEN duration END) AS min_response_time,
  max(CASE WHEN success THEN duration END) AS max_response_time,
  CAST(coalesce(sum(CASE WHEN success THEN tokens END), 0) AS BIGINT) AS total_tokens,
  avg(CASE WHEN success THEN tokens END) AS avg_tokens,
  stddev_samp(CASE WHEN success THEN tokens END) AS sd_tokens,
  min(CASE WHEN success THEN tokens END) AS min_tokens,
  max(CASE WHEN success THEN tokens END) AS max_tokens,
  CASE WHEN sum(duration) > 0 THEN sum(CASE WHEN success THEN 1 ELSE 0 END) / sum(duration) ELSE 0.0 END AS throughput
FROM call_log_v GROUP BY provider
""")
def _q(fx):
    return R.response_time_stats(fx.call_log_v, ["provider"])


@query("approach_ranking_rounded", ["runs_v", "experiments_v"], section="2.4", oracle="""
SELECT approach_name, round(avg(CAST(is_correct AS DOUBLE)), 3) AS accuracy,
       round(avg(execution_time_ms), 1) AS avg_time_ms, count(*) AS sample_count
FROM runs_v r JOIN experiments_v e ON r.experiment_id = e.id
WHERE e.name ILIKE '%BBEH%' GROUP BY approach_name ORDER BY accuracy DESC
""")
def _q(fx):
    return R.approach_ranking_rounded(R.filter_name_like(fx.runs_v, fx.experiments_v, "BBEH"))


@query("cost_benefit", ["runs_v", "experiments_v"], section="2.4", oracle="""
SELECT approach_name, round(avg(CAST(is_correct AS DOUBLE)), 3) AS accuracy,
       round(avg(cost_estimate), 6) AS avg_cost,
       round(avg(execution_time_ms) / 1000.0, 1) AS avg_seconds,
       round(avg(CAST(is_correct AS DOUBLE)) / nullif(avg(cost_estimate), 0), 2) AS accuracy_per_dollar
FROM runs_v r JOIN experiments_v e ON r.experiment_id = e.id
WHERE e.name ILIKE '%BBEH%' AND approach_name <> 'None'
GROUP BY approach_name ORDER BY accuracy_per_dollar DESC
""")
def _q(fx):
    return R.cost_benefit(R.filter_name_like(fx.runs_v, fx.experiments_v, "BBEH"))


@query("approach_moments", ["runs_v"], section="2.4", oracle="""
SELECT experiment_id, approach_name,
  avg(CAST(is_correct AS DOUBLE)) AS is_correct_mean, stddev_samp(CAST(is_correct AS DOUBLE)) AS is_correct_std,
  count(is_correct) AS is_correct_count, avg(execution_time_ms) AS execution_time_ms_mean,
  quantile_cont(CAST(execution_time_ms AS DOUBLE), 0.5) AS execution_time_ms_median,
  sum(cost_estimate) AS cost_estimate_sum
FROM runs_v GROUP BY 1, 2
""")
def _q(fx):
    return R.approach_moments(fx.runs_v)


@query("approach_metrics", ["runs_v"], section="2.4", oracle="""
SELECT experiment_id, approach_name AS approach, count(*) AS sample_count,
  CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS correct_samples,
  CAST(sum(CASE WHEN is_correct IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS error_samples,
  avg(execution_time_ms) / CAST(1000 AS DOUBLE) AS avg_response_time,
  avg(total_tokens) AS avg_tokens_used, sum(cost_estimate) AS total_cost, max(created_at) AS ts
FROM runs_v GROUP BY experiment_id, approach_name
""")
def _q(fx):
    return R.approach_metrics(fx.runs_v)


@query("describe_metrics", ["approach_metrics_v"], section="2.4", oracle="""
SELECT * FROM (
""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean,
       stddev_samp(CAST({c} AS DOUBLE)) AS std, min(CAST({c} AS DOUBLE)) AS min,
       quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,
       quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, max(CAST({c} AS DOUBLE)) AS max
FROM approach_metrics_v"""
    for c in ["sample_count", "correct_samples", "error_samples", "avg_response_time", "avg_tokens_used", "total_cost"]
) + "\n)")
def _q(fx):
    return R.describe_metrics(fx.approach_metrics_v)


@query("table_stats", ["experiments_v", "runs_v", "parsing_metrics_v"], section="2.4", oracle="""
SELECT 'experiments' AS table_name, count(*) AS row_count FROM experiments_v
UNION ALL SELECT 'runs', count(*) FROM runs_v
UNION ALL SELECT 'parsing_metrics', count(*) FROM parsing_metrics_v
""")
def _q(fx):
    return R.table_stats({"experiments": fx.experiments_v, "runs": fx.runs_v, "parsing_metrics": fx.parsing_metrics_v})


@query("preprocessing_usage", ["prep_link_v"], section="2.4", oracle="""
WITH l AS (SELECT *, CAST('2024-03-01 00:00:00' AS TIMESTAMP) + to_minutes(CAST(id % 1000 AS BIGINT)) AS created_at
           FROM prep_link_v)
SELECT preprocessing_id, experiment_id, created_at,
       count(*) OVER (PARTITION BY preprocessing_id) AS experiment_count
FROM l
""")
def _q(fx):
    # links stamped with a creation time derived from their id
    links = fx.prep_link_v.withColumn(
        "created_at",
        F.expr("CAST('2024-03-01 00:00:00' AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(id % 1000 AS INT), 0)"))
    return R.preprocessing_usage(links)
