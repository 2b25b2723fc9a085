"""Registered queries for ordered per-group work (2.5), sorts and limits (2.6),
set operations (2.7) and dataset-level sources (2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators import runs as R
from ..operators import windows as W
from .registry import query


@query("number_samples", ["runs_v"], section="2.5", oracle="""
SELECT id, experiment_id, sample_index,
       row_number() OVER (PARTITION BY experiment_id ORDER BY sample_index, id) - 1 AS sample_no
FROM runs_v
""")
def _q(fx):
    r = fx.runs_v.select("id", "experiment_id", "sample_index")
    return W.number_samples(r)


@query("first_examples", ["runs_v", "parsing_metrics_v"], section="2.5", oracle="""
WITH f AS (
  SELECT r.experiment_id, r.id AS run_id, r.created_at, r.approach_name AS approach, r.model, pm.error_details AS error,
    CASE WHEN coalesce(r.parsed_answer, '') = '' THEN 'parsing_failed'
         WHEN coalesce(pm.error_details, '') <> '' THEN 'execution_error' ELSE 'incorrect_answer' END AS failure_type
  FROM runs_v r LEFT JOIN parsing_metrics_v pm ON r.id = pm.run_id WHERE r.is_correct = FALSE)
SELECT experiment_id, failure_type, approach, model, run_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_id, failure_type, approach, model
                               ORDER BY created_at, run_id, error) AS rank FROM f)
WHERE rank <= 3
""")
def _q(fx):
    f = R._failures(fx.runs_v, fx.parsing_metrics_v, None)
    f = f.select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("w"), F.lit(3)))).alias("_copy"))
    out = W.first_k(f, ["experiment_id", "failure_type", "approach", "model"],
                    [F.col("created_at"), F.col("run_id"), F.col("error"), F.col("_copy")], 3)
    return out.select("experiment_id", "failure_type", "approach", "model", "run_id", "rank")


@query("latest_preprocessing", ["preprocessing_v"], section="2.5", oracle="""
SELECT * EXCLUDE (rk) FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_name, dataset_config ORDER BY processed_at DESC, id DESC) AS rk
  FROM preprocessing_v WHERE status = 'processed')
WHERE rk = 1
""")
def _q(fx):
    return W.latest_preprocessing(fx.preprocessing_v, ["dataset_name", "dataset_config"])


@query("dedupe_last", ["runs_v"], section="2.5", oracle="""
SELECT * EXCLUDE (rk) FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_id, sample_index % 50, approach_name
                               ORDER BY created_at DESC, id DESC) AS rk FROM runs_v)
WHERE rk = 1
""")
def _q(fx):
    # re-runs of the same (experiment, sample slot, approach): the last write wins
    r = fx.runs_v.withColumn("_slot", F.col("sample_index") % 50)
    return W.dedupe_last(r, ["experiment_id", "_slot", "approach_name"], ["created_at", "id"]).drop("_slot")


@query("cost_guard", ["runs_v"], section="2.5", oracle="""
WITH g AS (
  SELECT id, experiment_id, created_at,
    coalesce(sum(cost_estimate) OVER (PARTITION BY experiment_id ORDER BY created_at, id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cost_before,
    coalesce(sum(CASE WHEN approach_name = 'Reflection' THEN 3 ELSE 1 END)
             OVER (PARTITION BY experiment_id ORDER BY created_at, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS calls_before
  FROM runs_v)
SELECT id, experiment_id, created_at, cost_before, CAST(calls_before AS BIGINT) AS calls_before,
       cost_before > 1.0 AS cost_warning, cost_before > 5.0 AS cost_high, calls_before >= 500 AS calls_limit_reached
FROM g
""")
def _q(fx):
    r = fx.runs_v.select("id", "experiment_id", "created_at", "cost_estimate", "approach_name")
    calls = F.when(F.col("approach_name") == "Reflection", F.lit(3)).otherwise(F.lit(1))
    out = W.cost_guard(r, calls=calls, max_calls=500)
    return out.select("id", "experiment_id", "created_at", "cost_before", "calls_before",
                      "cost_warning", "cost_high", "calls_limit_reached")


@query("checkpoint_batches", ["runs_v"], section="2.5", oracle="""
WITH n AS (SELECT experiment_id,
                  row_number() OVER (PARTITION BY experiment_id ORDER BY sample_index, id) - 1 AS sample_no FROM runs_v),
b AS (SELECT experiment_id, sample_no // 10 AS batch_no, count(*) AS n_samples, max(sample_no) AS last_index
      FROM n GROUP BY 1, 2),
t AS (SELECT experiment_id, count(*) AS total_samples, max(sample_no) + 1 AS current_sample FROM n GROUP BY 1)
SELECT b.experiment_id, b.batch_no, b.n_samples, b.last_index, (b.last_index + 1) % 10 = 0 AS checkpoint_saved,
       CASE WHEN total_samples > 0 THEN current_sample / total_samples * 100.0 ELSE 0.0 END AS progress_percentage
FROM b JOIN t ON b.experiment_id = t.experiment_id
""")
def _q(fx):
    n = W.number_samples(fx.runs_v.select("id", "experiment_id", "sample_index"))
    return W.checkpoint_batches(n)


@query("sample_seeded", [], section="2.6", oracle="""
SELECT doc_id, source FROM documents ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '-42')), doc_id LIMIT 25
""")
def _q(fx):
    return D.sample_seeded(fx.documents.select("doc_id", "source"), 25, "doc_id", seed=42)


@query("head_n", [], section="2.6", oracle="""
SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10
""")
def _q(fx):
    return D.head_n(fx.benchmark, 10, ["item_id"])


def _question_sets(fx):
    b = fx.benchmark.select("item_id", F.col("text").alias("INPUT"),
                            (F.col("item_id") % 5).cast("string").alias("OUTPUT"))
    return {
        "basic": b.filter(F.col("item_id") % 3 == 0),
        "reasoning": b.filter(F.col("item_id") % 3 == 1),
        "extended": b.filter(F.col("item_id") % 3 == 2),
    }


@query("union_question_sets", [], section="2.7", oracle="""
WITH u AS (
  SELECT item_id, text AS "INPUT", CAST(item_id % 5 AS VARCHAR) AS "OUTPUT",
         CASE item_id % 3 WHEN 0 THEN 'basic' ELSE 'extended' END AS category,
         CASE item_id % 3 WHEN 0 THEN 0 ELSE 1 END AS s
  FROM benchmark WHERE item_id % 3 IN (0, 2))
SELECT item_id, "INPUT", "OUTPUT", category,
       printf('LOCAL_TEST_%03d', row_number() OVER (ORDER BY s, item_id)) AS id
FROM u
""")
def _q(fx):
    return D.union_question_sets(_question_sets(fx), ["basic", "extended"], "item_id")


@query("evolve_schema", ["runs_v"], section="2.7", oracle="""
SELECT * FROM runs_v WHERE is_correct IS NOT NULL
UNION ALL
SELECT * REPLACE (CAST(NULL AS VARCHAR) AS parsing_method, CAST(NULL AS DOUBLE) AS parsing_confidence,
                  CAST(NULL AS DOUBLE) AS cost_estimate)
FROM runs_v WHERE is_correct IS NULL
""")
def _q(fx):
    r = fx.runs_v
    new = r.filter(F.col("is_correct").isNotNull())
    old = r.filter(F.col("is_correct").isNull()).drop("parsing_method", "parsing_confidence", "cost_estimate")
    return D.evolve_schema(old, new)


@query("cycle_to_n", [], section="2.1", oracle="""
WITH b AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark),
c AS (SELECT count(*) AS n FROM benchmark),
g AS (SELECT range AS i FROM c, range(0, 3 * c.n + 7))
SELECT b.item_id, b.text, g.i AS _i, printf('LOCAL_TEST_LARGE_%03d', g.i + 1) AS id
FROM g, c, b WHERE b.pos = g.i % c.n
""")
def _q(fx):
    base = fx.benchmark
    n = 3 * base.count() + 7
    return D.cycle_to_n(base, n, "item_id", "LOCAL_TEST_LARGE")


SPLIT_SQL = """CASE WHEN lang = 'en' AND source NOT IN ('src0', 'src1') THEN 'train'
     WHEN lang = 'de' AND source <> 'src1' THEN 'test' WHEN lang = 'fr' THEN 'validation' ELSE 'dev' END"""


@query("resolve_split", [], section="2.1", oracle=f"""
WITH d AS (SELECT doc_id, source AS dataset_name, {SPLIT_SQL} AS split FROM documents),
c AS (SELECT dataset_name, min((CASE split WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, split)) AS m
      FROM d GROUP BY dataset_name)
SELECT d.* FROM d JOIN c ON d.dataset_name = c.dataset_name WHERE d.split = c.m[2]
""")
def _q(fx):
    d = fx.documents.select("doc_id", F.col("source").alias("dataset_name"), F.expr(SPLIT_SQL).alias("split"))
    return D.resolve_split(d)


@query("catalog_list", [], section="2.1", oracle="""
SELECT DISTINCT benchmark_id FROM (
  SELECT 'LOCAL_TEST' AS benchmark_id UNION ALL SELECT 'LOCAL_TEST_LARGE'
  UNION ALL SELECT concat(source, '.csv') FROM documents
  UNION ALL SELECT concat('bench_', CAST(item_id % 7 AS VARCHAR)) FROM benchmark)
ORDER BY benchmark_id
""")
def _q(fx):
    spark = fx.spark
    local = spark.createDataFrame([("LOCAL_TEST",), ("LOCAL_TEST_LARGE",)], "benchmark_id string")
    csv = fx.documents.select(F.concat("source", F.lit(".csv")).alias("benchmark_id"))
    legacy = fx.benchmark.select(F.concat(F.lit("bench_"), (F.col("item_id") % 7).cast("string")).alias("benchmark_id"))
    return D.catalog_list(local, csv, legacy)


@query("dataset_info", [], section="2.1", oracle="""
SELECT (SELECT count(*) FROM benchmark) AS num_rows,
       list_value('item_id', 'text') AS columns, list_value('bigint', 'string') AS types,
       FALSE AS has_input_output,
       (SELECT list(to_json({'item_id': item_id, 'text': text})::VARCHAR ORDER BY item_id)
        FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 3)) AS sample_data
""")
def _q(fx):
    return D.dataset_info(fx.benchmark, "item_id")
