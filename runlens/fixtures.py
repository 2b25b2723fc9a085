"""Test views over the provided parquet tables.

Each view is written once, as SQL that both Spark and DuckDB run (DuckDB spells
``array(`` as ``list_value(``).  The Spark side registers the base tables of a
scale-factor folder and builds the view DataFrames from this text; the oracle
side prepends the same text as CTEs to its own, independently written query.
These are fixture inputs only: every operator of the library takes plain
DataFrames and never reads this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["runs_v"] = """
SELECT concat('run_', CAST(event_id AS STRING)) AS id,
       concat('exp_', CAST(user_id % 20 AS STRING)) AS experiment_id,
       CASE event_type WHEN 'view' THEN 'None' WHEN 'click' THEN 'ChainOfThought'
            WHEN 'purchase' THEN 'TreeOfThought' WHEN 'signup' THEN 'ProgramOfThought'
            ELSE 'Reflection' END AS approach_name,
       CASE user_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'cohere'
            WHEN 2 THEN 'openrouter' ELSE 'local-openai' END AS provider,
       concat('model_', CAST(user_id % 3 AS STRING)) AS model,
       event_id AS sample_index,
       concat('Question ', CAST(event_id AS STRING), ': what is ',
              CAST(event_id % 5 AS STRING), ' plus ', repeat('0', CAST(event_id % 120 AS INT)), '?') AS input_text,
       CAST(event_id % 5 AS STRING) AS expected_answer,
       CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'wrong'
            ELSE concat(' ', CAST(event_id % 5 AS STRING), ' ') END AS parsed_answer,
       CASE event_id % 4 WHEN 0 THEN 'instructor' WHEN 1 THEN 'instructor_multiple'
            WHEN 2 THEN 'regex' ELSE NULL END AS parsing_method,
       CAST(event_id % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS parsing_confidence,
       CASE WHEN event_id % 13 = 0 THEN NULL
            WHEN event_id % 17 = 0 OR event_id % 3 = 0 THEN FALSE ELSE TRUE END AS is_correct,
       CAST(floor(value * CAST(100 AS DOUBLE)) AS BIGINT) AS execution_time_ms,
       50 + event_id % 150 AS total_tokens,
       CAST(50 + event_id % 150 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS cost_estimate,
       ts AS created_at
FROM events
"""

VIEWS["parsing_metrics_v"] = """
SELECT concat('run_', CAST(event_id AS STRING)) AS run_id, 1 AS parsing_attempts,
       event_id % 2 = 0 AS fallback_used,
       CAST(event_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence_score,
       event_id % 400 AS extraction_time_ms,
       CASE WHEN event_id % 6 = 1 THEN 'timeout' ELSE '' END AS error_details,
       event_id * 2 AS id
FROM events WHERE event_id % 3 <> 0
UNION ALL
SELECT concat('run_', CAST(event_id AS STRING)) AS run_id, 2 AS parsing_attempts,
       TRUE AS fallback_used, CAST(0.9 AS DOUBLE) AS confidence_score,
       event_id % 400 AS extraction_time_ms, '' AS error_details, event_id * 2 + 1 AS id
FROM events WHERE event_id % 30 = 1
"""

VIEWS["experiments_v"] = """
SELECT concat('exp_', CAST(n_nationkey AS STRING)) AS id,
       concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN ' BBEH' ELSE ' MMLU' END) AS name,
       concat('{"provider":"cohere","sample_count":', CAST(n_nationkey AS STRING), '}') AS config_json,
       CASE n_nationkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS status,
       concat('ds_', CAST(n_nationkey % 4 AS STRING)) AS dataset_name,
       CAST(concat('2024-01-', lpad(CAST(n_nationkey + 1 AS STRING), 2, '0'), ' 00:00:00') AS TIMESTAMP) AS created_at
FROM nation WHERE n_nationkey < 22
"""

VIEWS["preprocessing_v"] = """
SELECT concat('prep_', CAST(s_suppkey AS STRING)) AS id,
       concat('ds_', CAST(s_suppkey % 6 AS STRING)) AS dataset_name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'main' ELSE NULL END AS dataset_config,
       CASE s_suppkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'processed' END AS status,
       CAST(s_suppkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence_score,
       s_suppkey * 10 AS original_samples, s_suppkey * 10 - s_suppkey % 3 AS processed_samples,
       CAST(concat('2024-02-', lpad(CAST(s_suppkey % 28 + 1 AS STRING), 2, '0'), ' 00:00:00') AS TIMESTAMP) AS processed_at
FROM supplier
"""

VIEWS["prep_link_v"] = """
SELECT c_custkey AS id, concat('exp_', CAST(c_custkey % 22 AS STRING)) AS experiment_id,
       concat('prep_', CAST(c_custkey % 105 AS STRING)) AS preprocessing_id,
       concat('ds_', CAST(c_custkey % 6 AS STRING)) AS dataset_name
FROM customer
"""

VIEWS["mcq_v"] = """
SELECT p_partkey AS id, p_type AS story, concat('Which brand is ', p_name, '?') AS question,
       array(concat('  ', p_brand), p_type, concat(p_name, ' ')) AS candidate_answers,
       CAST(p_partkey % 5 AS INT) - 1 AS answer
FROM part
"""

VIEWS["code_v"] = """
SELECT doc_id AS id, text AS content,
       CASE WHEN doc_id % 3 = 0 THEN concat('x = ', CAST(n_chars AS STRING))
            ELSE concat('Intro', chr(10), repeat(chr(96), 3), 'python', chr(10), 'x = ',
                        CAST(n_chars AS STRING), chr(10), repeat(chr(96), 3), chr(10), 'End') END AS python,
       CASE doc_id % 3 WHEN 0 THEN 'Easy' WHEN 1 THEN 'medium' ELSE 'HARD' END AS difficulty
FROM documents
"""

VIEWS["responses_v"] = """
SELECT event_id AS id, event_type AS approach_name, CAST(event_id % 5 AS STRING) AS expected_answer,
  CASE event_id % 10
   WHEN 0 THEN concat('Step 1. Add the numbers.', chr(10), 'Step 2. Check because it matters.', chr(10),
                      'Therefore, the total is ', CAST(event_id % 7 AS STRING), '.', chr(10),
                      'Final Answer: ', CAST(event_id % 7 AS STRING))
   WHEN 1 THEN concat('The answer is (', CAST(event_id % 5 AS STRING), ')')
   WHEN 2 THEN 'Multiple choice: [B]'
   WHEN 3 THEN concat('So, we evaluate each approach!', chr(10), 'Paris')
   WHEN 4 THEN 'Yes!'
   WHEN 5 THEN 'Option: C) maybe?'
   WHEN 6 THEN '***'
   WHEN 7 THEN ''
   WHEN 8 THEN concat('Let', chr(39), 's compute.', chr(10), repeat(chr(96), 3), 'python', chr(10), 'total = ',
                      CAST(event_id AS STRING), chr(10), repeat(chr(96), 3), chr(10), 'Answer: ', CAST(event_id % 5 AS STRING))
   ELSE concat('**Initial Response**', chr(10), 'My answer may be wrong.', chr(10), '**Reflection**', chr(10),
               'However, I realize an error; approach 1 is better than approach 2. Is it correct?', chr(10),
               '**Refined Response**', chr(10), 'Answer: the answer is ', CAST(event_id % 5 AS STRING), '.')
  END AS raw_output
FROM events
"""

VIEWS["approach_metrics_v"] = """
SELECT experiment_id,
       CASE WHEN CAST(substr(experiment_id, 5) AS INT) < 10 THEN 'LOCAL_TEST' ELSE 'LOCAL_TEST_LARGE' END AS benchmark_id,
       approach_name AS approach, count(*) AS sample_count,
       sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS correct_samples,
       sum(CASE WHEN is_correct IS NULL THEN 1 ELSE 0 END) AS error_samples,
       avg(execution_time_ms) / CAST(1000 AS DOUBLE) AS avg_response_time,
       avg(total_tokens) AS avg_tokens_used, sum(cost_estimate) AS total_cost, max(created_at) AS ts
FROM runs_v GROUP BY experiment_id, approach_name
"""

VIEWS["call_log_v"] = """
SELECT event_id AS call_id, ts, CASE user_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'cohere'
       WHEN 2 THEN 'openrouter' ELSE 'local-openai' END AS provider,
       value AS duration, 50 + event_id % 150 AS tokens, event_type <> 'error' AS success
FROM events
"""

# views that read other views
_DEPENDS = {"approach_metrics_v": ["runs_v"]}


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in _DEPENDS.get(n, []):
            if d not in out:
                out.append(d)
        if n not in out:
            out.append(n)
    return out


def duckdb_with(names: list[str]) -> str:
    """``WITH`` clause defining the fixture views for a DuckDB oracle query."""
    if not names:
        return ""
    parts = []
    for n in _ordered(names):
        body = VIEWS[n].strip().replace("array(", "list_value(")
        # DuckDB: approach_metrics_v sums are HUGEINT; keep them BIGINT like Spark
        if n == "approach_metrics_v":
            body = body.replace(
                "sum(CASE WHEN is_correct THEN 1 ELSE 0 END)",
                "CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT)",
            ).replace(
                "sum(CASE WHEN is_correct IS NULL THEN 1 ELSE 0 END)",
                "CAST(sum(CASE WHEN is_correct IS NULL THEN 1 ELSE 0 END) AS BIGINT)",
            )
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"


class Fixtures:
    """Lazy access to the base tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        if name in self._cache:
            return self._cache[name]
        for dep in _DEPENDS.get(name, []):
            self.view(dep).createOrReplaceTempView(dep)
        for t in BASE_TABLES:
            if t in VIEWS[name]:
                self.table(t).createOrReplaceTempView(t)
        df = self.spark.sql(VIEWS[name])
        # timestamps stay wall-clock (like the parquet ts and DuckDB's TIMESTAMP),
        # whatever the session time zone
        for f in df.schema.fields:
            if f.dataType.typeName() == "timestamp":
                df = df.withColumn(f.name, df[f.name].cast("timestamp_ntz"))
        self._cache[name] = df
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            return self.view(name)
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)
