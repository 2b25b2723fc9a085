"""Spark schemas of the fixed tables (experiments, runs, parsing metrics,
preprocessing records, links) and of the nested run record."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


EXPERIMENTS = _schema(
    ("id", S, False), ("name", S, True), ("description", S, True), ("created_at", TS, True),
    ("config_json", S, False), ("status", S, True), ("preprocessing_id", S, True),
    ("preprocessing_rules_path", S, True), ("dataset_name", S, True), ("eval_output_path", S, True),
)

RUNS = _schema(
    ("id", S, False), ("experiment_id", S, False), ("approach_name", S, False), ("provider", S, False),
    ("model", S, False), ("sample_index", L, False), ("input_text", S, False), ("expected_answer", S, True),
    ("raw_output", S, True), ("parsed_answer", S, True), ("parsing_method", S, True),
    ("parsing_confidence", D, True), ("is_correct", B, True), ("execution_time_ms", L, True),
    ("cost_estimate", D, True), ("created_at", TS, True), ("metadata_json", S, True),
)

PARSING_METRICS = _schema(
    ("id", L, False), ("run_id", S, False), ("parsing_attempts", L, True), ("fallback_used", B, True),
    ("confidence_score", D, True), ("extraction_time_ms", L, True), ("error_details", S, True),
)

DATASET_PREPROCESSING = _schema(
    ("id", S, False), ("dataset_name", S, False), ("dataset_config", S, True), ("dataset_url", S, True),
    ("status", S, True), ("schema_analysis", S, True), ("transformation_rules", S, True),
    ("confidence_score", D, True), ("original_samples", L, True), ("processed_samples", L, True),
    ("validation_results", S, True), ("output_path", S, True), ("rules_path", S, True),
    ("analysis_path", S, True), ("processed_at", TS, True), ("created_at", TS, True),
)

PREPROCESSING_EVAL_LINK = _schema(
    ("id", L, False), ("experiment_id", S, False), ("preprocessing_id", S, False), ("dataset_name", S, True),
    ("dataset_config", S, True), ("preprocessing_path", S, True), ("rules_path", S, True),
    ("processed_data_path", S, True), ("eval_output_path", S, True), ("created_at", TS, True),
)

STANDARDIZED = _schema(("INPUT", S, False), ("OUTPUT", S, False))

RESPONSE = T.StructType([
    T.StructField("text", S), T.StructField("provider", S), T.StructField("model", S),
    T.StructField("prompt_tokens", L), T.StructField("completion_tokens", L), T.StructField("total_tokens", L),
    T.StructField("generation_time", D), T.StructField("parameters", T.MapType(S, S)),
    T.StructField("response_id", S), T.StructField("metadata", T.MapType(S, S)),
    T.StructField("extracted_answer", S),
])

RUN_RECORD = T.StructType([
    T.StructField("sample_id", S), T.StructField("input", S), T.StructField("expected_output", S),
    T.StructField("approach", S), T.StructField("timestamp", S),
    T.StructField("result", T.StructType([
        T.StructField("response", RESPONSE), T.StructField("approach_name", S),
        T.StructField("execution_time", D), T.StructField("cost_estimate", D),
        T.StructField("metadata", T.MapType(S, S)),
    ])),
])

ERROR_RECORD = _schema(("sample_id", S, True), ("approach", S, True), ("error", S, True), ("timestamp", S, True))

# --- fixed values: CHECK constraints of the fixed tables ---------------------
EXPERIMENT_STATUSES = ["running", "completed", "failed"]
PARSING_METHODS = ["instructor", "instructor_multiple", "regex", "manual", "none"]
PREPROCESSING_STATUSES = ["pending", "processed", "failed"]
