"""Registered queries for table maintenance (2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import last_nonblank_line
from ..operators import maintain as M
from .extract_plans import last_line
from .registry import query

RUN_COLS = ("id, experiment_id, approach_name, provider, model, sample_index, input_text, expected_answer, "
            "parsed_answer, parsing_method, parsing_confidence, is_correct, execution_time_ms, cost_estimate, created_at")

RESULTS_SQL = f"""
res AS (
  SELECT CASE WHEN id % 5 = 0 THEN concat('run_', CAST(id AS VARCHAR)) ELSE concat('new_', CAST(id AS VARCHAR)) END AS id,
         concat('exp_', CAST(id % 20 AS VARCHAR)) AS experiment_id, approach_name, 'cohere' AS provider,
         'model_0' AS model, id AS sample_index, concat('Q', CAST(id AS VARCHAR)) AS input_text,
         expected_answer, coalesce({last_line('raw_output')}, '') AS parsed_answer, 'regex' AS parsing_method,
         CAST(id % 10 AS DOUBLE) / 10.0 AS parsing_confidence,
         {last_line('raw_output')} IS NOT NULL AND {last_line('raw_output')} <> '' AND expected_answer <> ''
           AND lower(regexp_replace({last_line('raw_output')}, '^\\s+|\\s+$', '', 'g'))
               = lower(regexp_replace(expected_answer, '^\\s+|\\s+$', '', 'g')) AS is_correct,
         CAST(trunc(CAST(id % 97 AS DOUBLE) / 10.0 * 1000) AS BIGINT) AS execution_time_ms,
         0.001 AS cost_estimate, CAST('2024-03-01 00:00:00' AS TIMESTAMP) AS created_at
  FROM responses_v)
"""


def _results(fx):
    return fx.responses_v.select(
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("run_"), F.col("id").cast("string")))
        .otherwise(F.concat(F.lit("new_"), F.col("id").cast("string"))).alias("run_id"),
        F.concat(F.lit("exp_"), (F.col("id") % 20).cast("string")).alias("experiment_id"),
        F.col("approach_name").alias("approach"),
        F.lit("cohere").alias("provider"),
        F.lit("model_0").alias("model"),
        F.col("id").alias("sample_index"),
        F.concat(F.lit("Q"), F.col("id").cast("string")).alias("input_text"),
        "expected_answer",
        F.col("raw_output").alias("text"),
        last_nonblank_line("raw_output").alias("extracted_answer"),
        F.lit("regex").alias("parsing_method"),
        ((F.col("id") % 10).cast("double") / 10.0).alias("parsing_confidence"),
        ((F.col("id") % 97).cast("double") / 10.0).alias("latency"),
        F.lit(0.001).alias("cost"),
        F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


@query("upsert_runs", ["runs_v", "responses_v"], section="2.13", oracle=f"""
WITH {RESULTS_SQL.strip()}
SELECT {RUN_COLS} FROM runs_v WHERE id NOT IN (SELECT id FROM res)
UNION ALL SELECT {RUN_COLS} FROM res
""")
def _q(fx):
    existing = fx.runs_v.select(*[c.strip() for c in RUN_COLS.split(",")])
    return M.upsert_runs(existing, _results(fx))


PREP_COLS = "id, dataset_name, dataset_config, status, confidence_score, original_samples, processed_samples, processed_at"


@query("upsert_preprocessing", ["preprocessing_v"], section="2.13", oracle=f"""
WITH rec AS (
  SELECT CASE WHEN s_suppkey % 3 = 0 THEN concat('prep_', CAST(s_suppkey AS VARCHAR))
              ELSE concat('prep_new_', CAST(s_suppkey AS VARCHAR)) END AS id,
         concat('ds_', CAST(s_suppkey % 6 AS VARCHAR)) AS dataset_name,
         CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('v', CAST(s_suppkey % 14 AS VARCHAR)) END AS dataset_config,
         CASE WHEN s_suppkey % 2 = 0 THEN 'processed' ELSE 'failed' END AS status,
         CAST(0.9 AS DOUBLE) AS confidence_score, s_suppkey * 20 AS original_samples,
         s_suppkey * 19 AS processed_samples, CAST('2024-03-05 00:00:00' AS TIMESTAMP) AS processed_at
  FROM supplier),
old AS (
  SELECT id, dataset_name, CASE WHEN dataset_config = 'main' THEN concat('v', CAST(original_samples % 140 / 10 AS INT)) END AS dataset_config,
         status, confidence_score, original_samples, processed_samples, processed_at
  FROM preprocessing_v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_name, dataset_config ORDER BY processed_at DESC, id DESC) AS rk FROM rec)
SELECT {PREP_COLS} FROM old WHERE id NOT IN (SELECT id FROM rec)
  AND NOT EXISTS (SELECT 1 FROM rec WHERE rec.dataset_name = old.dataset_name AND rec.dataset_config = old.dataset_config)
UNION ALL SELECT {PREP_COLS} FROM ranked WHERE rk = 1 OR dataset_config IS NULL
""")
def _q(fx):
    old = fx.preprocessing_v.withColumn("dataset_config", F.when(
        F.col("dataset_config") == "main", F.concat(F.lit("v"), (F.col("original_samples") % 140 / 10).cast("int").cast("string"))))
    rec = fx.supplier.select(
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("prep_"), F.col("s_suppkey").cast("string")))
        .otherwise(F.concat(F.lit("prep_new_"), F.col("s_suppkey").cast("string"))).alias("id"),
        F.concat(F.lit("ds_"), (F.col("s_suppkey") % 6).cast("string")).alias("dataset_name"),
        F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("v"), (F.col("s_suppkey") % 14).cast("string"))).alias("dataset_config"),
        (F.col("s_suppkey") % 2 == 0).alias("validation_passed"),
        F.lit(0.9).alias("confidence_score"),
        (F.col("s_suppkey") * 20).alias("original_samples"),
        (F.col("s_suppkey") * 19).alias("processed_samples"),
        F.lit("2024-03-05 00:00:00").cast("timestamp_ntz").alias("processed_at"),
    )
    return M.upsert_preprocessing(old, rec)


@query("set_experiment_status", ["experiments_v", "runs_v"], section="2.13", oracle="""
SELECT id, name, config_json,
       CASE WHEN id NOT IN (SELECT DISTINCT experiment_id FROM runs_v) THEN 'failed' ELSE status END AS status,
       dataset_name, created_at
FROM experiments_v
""")
def _q(fx):
    # experiments that produced no runs are marked failed
    no_runs = fx.experiments_v.join(fx.runs_v.select(F.col("experiment_id").alias("id")).distinct(), "id", "left_anti")
    flagged = fx.experiments_v.join(no_runs.select("id").withColumn("_f", F.lit(True)), "id", "left")
    out = M.set_experiment_status(flagged, F.coalesce(F.col("_f"), F.lit(False)), "failed").drop("_f")
    return out.select("id", "name", "config_json", "status", "dataset_name", "created_at")


@query("link_preprocessing", ["experiments_v"], section="2.13", oracle="""
WITH nl AS (
  SELECT 100000 + c_custkey AS id, concat('exp_', CAST(c_custkey % 22 AS VARCHAR)) AS experiment_id,
         concat('prep_', CAST(c_custkey % 100 AS VARCHAR)) AS preprocessing_id, 'ds_new' AS dataset_name,
         concat('rules/', CAST(c_custkey AS VARCHAR)) AS rules_path, concat('out/', CAST(c_custkey AS VARCHAR)) AS eval_output_path
  FROM customer),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY id DESC) AS rk FROM nl) WHERE rk = 1)
SELECT e.id, e.name, e.status, coalesce(l.dataset_name, e.dataset_name) AS dataset_name,
       l.preprocessing_id AS preprocessing_id, l.rules_path AS preprocessing_rules_path,
       l.eval_output_path AS eval_output_path
FROM experiments_v e LEFT JOIN latest l ON e.id = l.experiment_id
""")
def _q(fx):
    return _linked(fx)[1]


def _linked(fx):
    e = fx.experiments_v.select(
        "id", "name", "status", "dataset_name",
        F.lit(None).cast("string").alias("preprocessing_id"),
        F.lit(None).cast("string").alias("preprocessing_rules_path"),
        F.lit(None).cast("string").alias("eval_output_path"),
    )
    new_links = fx.customer.select(
        (F.lit(100000) + F.col("c_custkey")).alias("id"),
        F.concat(F.lit("exp_"), (F.col("c_custkey") % 22).cast("string")).alias("experiment_id"),
        F.concat(F.lit("prep_"), (F.col("c_custkey") % 100).cast("string")).alias("preprocessing_id"),
        F.lit("ds_new").alias("dataset_name"),
        F.concat(F.lit("rules/"), F.col("c_custkey").cast("string")).alias("rules_path"),
        F.concat(F.lit("out/"), F.col("c_custkey").cast("string")).alias("eval_output_path"),
    )
    return M.link_preprocessing(fx.prep_link_v, e, new_links)


@query("link_preprocessing_links", ["prep_link_v"], section="2.13", oracle="""
SELECT id, experiment_id, preprocessing_id, dataset_name, CAST(NULL AS VARCHAR) AS rules_path, CAST(NULL AS VARCHAR) AS eval_output_path FROM prep_link_v
UNION ALL
SELECT 100000 + c_custkey, concat('exp_', CAST(c_custkey % 22 AS VARCHAR)), concat('prep_', CAST(c_custkey % 100 AS VARCHAR)), 'ds_new',
       concat('rules/', CAST(c_custkey AS VARCHAR)), concat('out/', CAST(c_custkey AS VARCHAR))
FROM customer
""")
def _q(fx):
    """The link table after new links were appended."""
    return _linked(fx)[0].select("id", "experiment_id", "preprocessing_id", "dataset_name", "rules_path", "eval_output_path")


@query("expire_experiments", ["experiments_v", "runs_v", "parsing_metrics_v", "prep_link_v"], section="2.13", oracle="""
WITH ex AS (SELECT id AS experiment_id FROM experiments_v
            WHERE (epoch(CAST('2024-01-20 00:00:00' AS TIMESTAMP)) - epoch(created_at)) / 86400.0 > 10),
kr AS (SELECT * FROM runs_v WHERE experiment_id NOT IN (SELECT experiment_id FROM ex))
SELECT 'experiments' AS table_name, id AS row_id FROM experiments_v WHERE id NOT IN (SELECT experiment_id FROM ex)
UNION ALL SELECT 'runs', id FROM kr
UNION ALL SELECT 'parsing_metrics', CAST(id AS VARCHAR) FROM parsing_metrics_v
  WHERE run_id NOT IN (SELECT id FROM runs_v WHERE experiment_id IN (SELECT experiment_id FROM ex))
UNION ALL SELECT 'links', CAST(id AS VARCHAR) FROM prep_link_v WHERE experiment_id NOT IN (SELECT experiment_id FROM ex)
UNION ALL SELECT 'expired', experiment_id FROM ex
""")
def _q(fx):
    out = M.expire_experiments(fx.experiments_v, fx.runs_v, fx.parsing_metrics_v, fx.prep_link_v, 10,
                               F.lit("2024-01-20 00:00:00").cast("timestamp"))
    parts = [
        out["experiments"].select(F.lit("experiments").alias("table_name"), F.col("id").alias("row_id")),
        out["runs"].select(F.lit("runs").alias("table_name"), F.col("id").alias("row_id")),
        out["parsing_metrics"].select(F.lit("parsing_metrics").alias("table_name"), F.col("id").cast("string").alias("row_id")),
        out["links"].select(F.lit("links").alias("table_name"), F.col("id").cast("string").alias("row_id")),
        out["expired"].select(F.lit("expired").alias("table_name"), F.col("experiment_id").alias("row_id")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


@query("check_constraints", ["experiments_v", "runs_v", "parsing_metrics_v", "preprocessing_v"], section="2.13", oracle="""
WITH e AS (SELECT id, config_json, CASE WHEN CAST(substr(id, 5) AS INT) % 7 = 0 THEN 'invalid_status' ELSE status END AS status
           FROM experiments_v),
r AS (SELECT id, experiment_id, CASE WHEN sample_index % 29 = 0 THEN 'invalid_method' ELSE parsing_method END AS parsing_method,
             parsing_confidence * 1.5 AS parsing_confidence FROM runs_v)
SELECT 'experiments' AS table_name, id AS row_id, 'status' AS rule FROM e
  WHERE status NOT IN ('running', 'completed', 'failed')
UNION ALL SELECT 'experiments', id, 'config_json not null' FROM e WHERE config_json IS NULL
UNION ALL SELECT 'runs', id, 'parsing_method' FROM r
  WHERE parsing_method NOT IN ('instructor', 'instructor_multiple', 'regex', 'manual', 'none')
UNION ALL SELECT 'runs', id, 'parsing_confidence range' FROM r WHERE parsing_confidence < 0 OR parsing_confidence > 1
UNION ALL SELECT 'runs', id, 'experiment_id not null' FROM r WHERE experiment_id IS NULL
UNION ALL SELECT 'parsing_metrics', CAST(id AS VARCHAR), 'confidence_score range' FROM parsing_metrics_v
  WHERE confidence_score < 0 OR confidence_score > 1
UNION ALL SELECT 'dataset_preprocessing', id, 'status' FROM preprocessing_v
  WHERE status NOT IN ('pending', 'processed', 'failed')
UNION ALL SELECT 'dataset_preprocessing', id, 'confidence_score range' FROM preprocessing_v
  WHERE confidence_score < 0 OR confidence_score > 1
""")
def _q(fx):
    e = fx.experiments_v.withColumn(
        "status", F.when(F.substring("id", 5, 10).cast("int") % 7 == 0, F.lit("invalid_status")).otherwise(F.col("status")))
    r = fx.runs_v.withColumn(
        "parsing_method", F.when(F.col("sample_index") % 29 == 0, F.lit("invalid_method")).otherwise(F.col("parsing_method"))
    ).withColumn("parsing_confidence", F.col("parsing_confidence") * 1.5)
    return M.check_constraints(e, r, fx.parsing_metrics_v, fx.preprocessing_v)
