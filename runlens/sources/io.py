"""Sources and sinks (2.1): dataset readers, standardized writers, run exports
and imports, versioned table directories.

Everything reads and writes through Spark's distributed readers/writers; no
table passes through the driver.  Exports write JSON lines / CSV part files
(one per task) instead of one document built in memory.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mask_raw_output
from ..operators.common import global_index
from ..operators.runs import (
    accuracy_by_approach,
    accuracy_by_model,
    compare_approaches,
    experiment_summary,
    failure_patterns,
    fanout_left_join,
    parsing_effectiveness,
)
from ..operators.standardize import validate_export
from ..schemas import RUN_RECORD, STANDARDIZED
from ..session import ship_package


# ----------------------------------------------------------------------------- readers


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# a token no cell holds: empty unquoted cells read as NULL, quoted "" as ''
_NULL_TOKEN = "\u0001NULL\u0001"


def _csv_options(**more) -> dict[str, str]:
    return {"multiLine": "true", "escape": '"', "timestampFormat": TS_FORMAT, "timestampNTZFormat": TS_FORMAT,
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": _NULL_TOKEN, **more}


def _csv_rows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """(row struct, _file, _block, _pos) of a CSV with a header: the last three give the rows' order in their files."""
    from .splitscan import CSV, split_records, split_states

    states = split_states(spark, path, CSV)
    # the first line's end is the file's, as Spark's own reader detects it; in quotes it becomes a line feed
    text = F.when(F.col("crlf"), F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", "")).otherwise(F.col("text"))
    records = split_records(spark, path, CSV, states).withColumn("text", text).where("not first and text <> ''")
    if schema is None:
        schema = _inferred(records.select("text"), states)
    else:
        schema = spark.createDataFrame([], schema).schema
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    row = F.from_csv("text", ddl, _csv_options()) if ddl else F.struct()
    return records.select(row.alias("row"), F.col("file").alias("_file"), F.col("at").alias("_block"), F.col("pos").alias("_pos"))


def _inferred(records: DataFrame, states: DataFrame):
    """Schema of CSV records by Spark's own type inference; names are those of the first file's header."""
    from pyspark.sql.types import StructField, StructType

    spark = records.sparkSession
    heads = states.where("at = 0 and trim(head) <> ''").orderBy("file").select(F.regexp_replace("head", "^\ufeff|\r$", "").alias("text")).limit(1)
    if heads.isEmpty():
        return StructType([])
    as_text = lambda df: getattr(df._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = lambda **o: spark.read.options(**_csv_options(**o))._jreader
    names = [f["name"] for f in json.loads(reader(header="true").csv(as_text(heads)).schema().json())["fields"]]
    # an empty line of as many cells comes first: it sets the number of columns, not their types
    lines = spark.createDataFrame([("," * (len(names) - 1),)], "text string").unionByName(records)
    found = StructType.fromJson(json.loads(reader(header="false", inferSchema="true").csv(as_text(lines)).schema().json()))
    kinds = [f.dataType for f in found][: len(names)]
    return StructType([StructField(n, k) for n, k in zip(names, kinds + [None] * (len(names) - len(kinds))) if k is not None])


def read_csv_dataset(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header; types given, or inferred by a read of their own.

    Files are split between tasks although quoted fields may span lines (see
    ``splitscan``).  Records end at a line feed, or at a carriage return and one if
    a file's first line does; empty lines are skipped; a quote inside an unquoted field is text."""
    return _csv_rows(spark, path, schema).select("row.*")


def read_json_records(spark: SparkSession, path: str, schema=STANDARDIZED, lines: bool = False) -> DataFrame:
    """JSON documents, each a list of ``{INPUT, OUTPUT}`` records; a document
    that is no list (any file's) is an error, and so is a list that holds anything
    but objects or is not closed.  Lists are split between tasks (see ``splitscan``).
    With ``lines`` the files hold one record a line."""
    if lines:
        df = spark.read.schema(schema).json(path)
        return df.select(*schema.fieldNames())  # drop discovered partition columns
    from .splitscan import JSON_LIST, split_records, split_states

    states = split_states(spark, path, JSON_LIST)  # the pass that finds where records begin sees the top level too
    if not states.where("opening not in ('', '[')").isEmpty():
        raise ValueError("JSON data must be a list of records")
    if not states.where("opening <> '' and closing <> -1").isEmpty():  # the list's bracket and one brace too many
        raise ValueError("JSON data must be a closed list of records")
    records = split_records(spark, path, JSON_LIST, states)
    # between records: a bracket once, then commas; the last one's rest closes the list
    opening = F.when((F.col("at") == 0) & (F.col("pos") == 0), F.lit(r"^\s*\[\s*")).otherwise(F.lit(r"^\s*,\s*"))
    closing = F.when((F.col("at") == 0) & (F.col("pos") == 0), F.lit(r"^\s*(\[\s*\])?\s*$")).otherwise(F.lit(r"^\s*\]\s*$"))
    body = F.regexp_replace(F.col("text"), opening, F.lit(""))
    wrong = F.raise_error(F.lit("JSON data must be a closed list of records")).cast("string")
    kept = (records.where(F.col("ended") | ~F.regexp_like("text", closing))
            .select(F.when(F.col("ended") & F.startswith(body, F.lit("{")), F.concat(body, F.lit("}"))).otherwise(wrong).alias("text")))
    return kept.select(F.from_json("text", schema).alias("r")).select("r.*")


def _holds_lists(spark: SparkSession, path: str) -> bool:
    """Every JSON file with text in it opens with a bracket."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1).alias("c"),
        F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("place"))
    opening = text.where("c <> ''").groupBy("file").agg(F.min_by("c", "place").alias("c"))
    return opening.where("c <> '['").isEmpty()


def validate_export_file(spark: SparkSession, path: str, max_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """``validate_export`` of what lies at ``path``: existence, format, shape
    of the records, rows and real size; one row."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([(None, 0, False, False, ["File not found"], [])],
                                     "format string, num_rows long, has_input_output boolean, is_valid boolean, errors array<string>, warnings array<string>")
    size = fs.getContentSummary(p).getLength()
    if path.endswith(".csv"):
        df = read_csv_dataset(spark, path)
    elif path.endswith(".json"):
        lists = _holds_lists(spark, path)
        df = spark.read.option("multiLine", lists).json(path)
        if not lists:
            error = F.array(F.lit("JSON data must be a list of records"))
            return validate_export(df, path, size, max_bytes).withColumn("errors", F.concat(error, "errors")).withColumn("is_valid", F.lit(False))
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.text(path)
    return validate_export(df, path, size, max_bytes)


# ----------------------------------------------------------------------------- writers


def write_standardized(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Format by suffix: ``.csv`` -> CSV with header, ``.json`` -> a JSON list
    of records in each part file (JSON lines if partitioned by columns),
    anything else -> Parquet.  Returns the format used."""
    w = df.write.mode(mode).option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path.endswith(".csv"):
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
        return "csv"
    if path.endswith(".json"):
        if partition_by:
            w.json(path)
        else:
            options = {"ignoreNullFields": "false", "timestampFormat": TS_FORMAT, "timestampNTZFormat": TS_FORMAT}
            records = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options).alias("value"))
            ship_package(df.sparkSession)
            # a file is one task's list: no cut by row count
            records.mapInArrow(_bracketed, "value string").write.mode(mode).option("maxRecordsPerFile", 0).text(path)
        return "json"
    w.parquet(path)
    return "parquet"


def _bracketed(batches):
    """One task's records, a line each, as the lines of one JSON list."""
    import pyarrow as pa

    sep = "["
    for b in batches:
        out = []
        for record in b.column(0).to_pylist():
            out.append(sep + record)
            sep = ","
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if sep == "[" else "]"])], ["value"])


_VERSION = re.compile(r"^version=(\d+)$")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_versions(spark: SparkSession, base: str) -> list[int]:
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        m = _VERSION.match(st.getPath().getName())
        if m and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(m.group(1)))
    return sorted(out)


def write_version(df: DataFrame, base: str, version: int | None = None) -> int:
    """Commit a table version as ``base/version=<n>`` (written whole, then
    marked by Spark's ``_SUCCESS``); readers take the newest complete one."""
    spark = df.sparkSession
    if version is None:
        versions = list_versions(spark, base)
        version = (versions[-1] + 1) if versions else 0
    df.write.mode("overwrite").parquet(f"{base}/version={version}")
    return version


def read_latest(spark: SparkSession, base: str) -> DataFrame | None:
    versions = list_versions(spark, base)
    return spark.read.parquet(f"{base}/version={versions[-1]}") if versions else None


def write_delta(df: DataFrame, base: str, batch_id: int) -> None:
    """Merge-on-read table: a micro-batch writes only its own rows to
    ``base/delta/batch=<id>`` (overwrite, so a replayed batch is idempotent)."""
    df.write.mode("overwrite").parquet(f"{base}/delta/batch={batch_id}")


def _compacted_upto(spark: SparkSession, base: str) -> int | None:
    fs, p = _fs(spark, f"{base}/compacted")
    if not fs.exists(p):
        return None
    done = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("upto=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            done.append(int(name.split("=", 1)[1]))
    return max(done) if done else None


def read_merged(spark: SparkSession, base: str, keys: list[str], order: list[str] | None = None,
                initial: DataFrame | None = None) -> DataFrame | None:
    """Current rows of a merge-on-read table: the newest compaction (or the
    initial rows, one per key) overlaid with every later delta, the latest
    batch winning per key (then ``order`` inside a batch).

    Deltas already compacted are pruned by the ``batch`` partition filter; the
    remaining deltas are deduplicated with ``max_by`` (partial aggregation), and
    the base is only anti-joined with their keys - it is never re-aggregated."""
    from ..operators.common import maybe_broadcast
    from ..operators.windows import dedupe_last

    upto = _compacted_upto(spark, base)
    if upto is not None:
        base_df = spark.read.parquet(f"{base}/compacted/upto={upto}")
    else:
        base_df = initial
    fs, p = _fs(spark, f"{base}/delta")
    deltas = None
    if fs.exists(p):
        d = spark.read.parquet(f"{base}/delta")
        deltas = d if upto is None else d.filter(F.col("batch") > upto)
    if deltas is None:
        return base_df
    latest = dedupe_last(deltas, keys, ["batch", *(order or [])]).drop("batch")
    if base_df is None:
        return latest
    # the keys are the deltas' own: taken from the latest rows they would cost a second sort of whole rows beside that of the base
    kept = base_df.join(maybe_broadcast(deltas.select(*keys).distinct()), keys, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def compact(spark: SparkSession, base: str, keys: list[str], order: list[str] | None = None,
            initial: DataFrame | None = None) -> int | None:
    """Fold every delta into ``compacted/upto=<last batch>``; later reads start
    from it and skip the folded deltas.  Returns the last folded batch id."""
    fs, p = _fs(spark, f"{base}/delta")
    if not fs.exists(p):
        return None
    last = spark.read.parquet(f"{base}/delta").agg(F.max("batch")).first()[0]
    merged = read_merged(spark, base, keys, order, initial)
    merged.write.mode("overwrite").parquet(f"{base}/compacted/upto={last}")
    return int(last)


# ----------------------------------------------------------------------------- run exports


def export_runs_table(runs: DataFrame, metrics: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """Runs left-joined to their metric rows (fan-out kept), four renamed metric
    columns, ``metadata_json`` dropped, ordered by created_at."""
    r = runs if experiment_id is None else runs.filter(F.col("experiment_id") == experiment_id)
    m = metrics.select(
        "run_id",
        "parsing_attempts",
        "fallback_used",
        F.col("confidence_score").alias("parsing_confidence_score"),
        F.col("extraction_time_ms").alias("parsing_time_ms"),
    )
    out = fanout_left_join(r, m)
    if "metadata_json" in out.columns:
        out = out.drop("metadata_json")
    return out.orderBy("created_at", "id")


def export_runs_csv(runs: DataFrame, metrics: DataFrame, path: str, experiment_id: str | None = None) -> DataFrame:
    out = export_runs_table(runs, metrics, experiment_id)
    (out.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return out


def export_runs_json_lines(runs: DataFrame, metrics: DataFrame, experiment_id: str | None = None,
                           include_raw: bool = False) -> DataFrame:
    """The runs part of the experiment export: one JSON object per run with its
    metric columns and parsed metadata; ``raw_output`` masked as
    ``[<n> chars]`` unless asked; ordered by (approach, sample)."""
    r = runs if experiment_id is None else runs.filter(F.col("experiment_id") == experiment_id)
    m = metrics.select("run_id", "parsing_attempts", "fallback_used",
                       F.col("confidence_score").alias("parsing_confidence_score"))
    if "raw_output" in r.columns and not include_raw:
        r = r.withColumn("raw_output", mask_raw_output("raw_output"))  # before the join: its text need not be shuffled
    j = fanout_left_join(r, m)
    if "metadata_json" in j.columns:
        j = j.withColumn("metadata", F.from_json("metadata_json", "map<string,string>")).drop("metadata_json")
    return j.orderBy("experiment_id", "approach_name", "sample_index", "id")


def export_experiment_json(runs: DataFrame, metrics: DataFrame, experiments: DataFrame, path: str,
                           experiment_id: str | None = None, include_raw: bool = False) -> None:
    """Experiment export: ``path/header`` holds, per experiment, the metadata,
    summary statistics and the analysis (accuracy report, approach comparison,
    first 10 failure patterns) - all aggregates, lists bounded by the number of
    approaches, models, parsing methods or the 10 failures; ``path/runs`` holds
    the runs as JSON lines."""
    summary = experiment_summary(runs, metrics, experiments, experiment_id)
    e = experiments if experiment_id is None else experiments.filter(F.col("id") == experiment_id)
    meta = e.select(F.col("id").alias("experiment_id"), F.struct(*[F.col(c) for c in e.columns]).alias("experiment_metadata"))

    def listed(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c != "experiment_id"]
        return df.groupBy("experiment_id").agg(F.collect_list(F.struct(*cols)).alias(name))

    parts = [
        summary.select("experiment_id", F.struct(*[c for c in summary.columns]).alias("summary_statistics")),
        listed(compare_approaches(runs, metrics, experiment_id), "approach_comparison"),
        listed(accuracy_by_approach(runs, experiment_id), "accuracy_by_approach"),
        listed(accuracy_by_model(runs, experiment_id), "accuracy_by_model"),
        listed(parsing_effectiveness(runs, experiment_id), "parsing_effectiveness"),
        listed(failure_patterns(runs, metrics, experiment_id, limit=10), "failure_patterns"),
    ]
    header = meta
    for p in parts:
        header = header.join(p, "experiment_id", "left")
    header.write.mode("overwrite").option("timestampNTZFormat", TS_FORMAT).json(f"{path}/header")
    runs_out = export_runs_json_lines(runs, metrics, experiment_id, include_raw)
    runs_out.write.mode("overwrite").option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT).json(
        f"{path}/runs")


def report_tables(runs: DataFrame, metrics: DataFrame, experiments: DataFrame,
                  experiment_ids: list[str] | None = None) -> dict[str, DataFrame]:
    """Three tables for many experiments: summary, per-run detail, and the
    approach comparison with the experiment id cut to 8 characters."""
    r = runs if experiment_ids is None else runs.filter(F.col("experiment_id").isin(list(experiment_ids)))
    e = experiments if experiment_ids is None else experiments.filter(F.col("id").isin(list(experiment_ids)))
    s = experiment_summary(r, metrics, e).filter(F.col("total_runs") > 0)
    summary = s.select(
        F.col("experiment_id").alias("Experiment ID"),
        F.col("total_runs").alias("Total Runs"),
        F.col("accuracy").alias("Accuracy"),
        F.col("avg_execution_time_ms").alias("Avg Time (ms)"),
        F.col("total_cost").alias("Total Cost"),
        F.array_join("approaches_tested", ", ").alias("Approaches"),
        F.array_join("models_used", ", ").alias("Models"),
    )
    detail = r.select(
        "experiment_id", "approach_name", "model", "sample_index", "input_text", "expected_answer", "parsed_answer",
        "is_correct", "parsing_confidence", "execution_time_ms", "cost_estimate",
    ).orderBy("experiment_id", "approach_name", "sample_index")
    comparison = compare_approaches(r, metrics).select(
        F.substring("experiment_id", 1, 8).alias("Experiment"),
        F.col("approach_name").alias("Approach"),
        F.col("accuracy").alias("Accuracy"),
        F.col("avg_execution_time_ms").alias("Avg Time (ms)"),
        F.col("total_cost").alias("Total Cost"),
        F.col("sample_count").alias("Samples"),
    )
    return {"summary": summary, "detail": detail, "comparison": comparison}


# ----------------------------------------------------------------------------- run imports


def import_runs(df: DataFrame, experiment_id: str, existing_ids: DataFrame | None = None,
                source: str = "", order: list | None = None) -> DataFrame:
    """Rows of a results CSV as runs: ``id = <exp>_<n>`` and sample_index = n
    in file order (a distributed global index: partition offsets plus position,
    no single-partition window), column defaults as the reference's import,
    insert-or-ignore on id."""
    n = global_index(df, order, "_n")

    def col_or(name: str, default, typ: str):
        # the default applies when the column is absent; an empty cell stays NULL
        return F.col(name).cast(typ) if name in df.columns else F.lit(default).cast(typ)

    meta = json.dumps({"imported_from": source})
    runs = n.select(
        F.concat(F.lit(f"{experiment_id}_"), F.col("_n").cast("string")).alias("id"),
        F.lit(experiment_id).alias("experiment_id"),
        col_or("approach", "unknown", "string").alias("approach_name"),
        col_or("provider", "unknown", "string").alias("provider"),
        col_or("model", "unknown", "string").alias("model"),
        F.col("_n").alias("sample_index"),
        (F.col("input").cast("string") if "input" in df.columns else F.lit("")).alias("input_text"),
        (F.col("expected").cast("string") if "expected" in df.columns else F.lit("")).alias("expected_answer"),
        (F.col("output").cast("string") if "output" in df.columns else F.lit("")).alias("raw_output"),
        (F.col("parsed_answer").cast("string") if "parsed_answer" in df.columns else F.lit("")).alias("parsed_answer"),
        (F.col("is_correct").cast("boolean") if "is_correct" in df.columns else F.lit(False)).alias("is_correct"),
        (F.col("execution_time_ms").cast("long") if "execution_time_ms" in df.columns else F.lit(0).cast("long")).alias(
            "execution_time_ms"),
        (F.col("cost").cast("double") if "cost" in df.columns else F.lit(0.0)).alias("cost_estimate"),
        F.lit(meta).alias("metadata_json"),
    )
    if existing_ids is not None:
        runs = runs.join(existing_ids.select(F.col("id")), "id", "left_anti")
    return runs


def import_runs_csv(spark: SparkSession, csv_path: str, experiment_id: str,
                    existing_ids: DataFrame | None = None) -> DataFrame:
    """Runs of a results CSV (files are split between tasks), numbered in file order."""
    place = ["_file", "_block", "_pos"]
    df = _csv_rows(spark, csv_path).select("row.*", *place)
    return import_runs(df, experiment_id, existing_ids, os.path.basename(csv_path.rstrip("/")), [F.col(c) for c in place])


def flatten_run_records(records: DataFrame) -> DataFrame:
    """Nested run records -> the 11 flat result columns; the answer is '' when
    missing, the display text falls back to the response text."""
    resp = F.col("result.response")
    return records.select(
        "sample_id",
        "approach",
        "input",
        "expected_output",
        F.coalesce(resp["extracted_answer"], F.lit("")).alias("extracted_answer"),
        resp["text"].alias("response_text"),
        F.col("result.execution_time").alias("execution_time"),
        resp["total_tokens"].alias("total_tokens"),
        F.col("result.cost_estimate").alias("cost_estimate"),
        F.coalesce(F.col("result.metadata")["reasoning_steps"].cast("long"), F.lit(0).cast("long")).alias("reasoning_steps"),
        "timestamp",
    )


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """Nested run records (JSON lines) with the fixed schema."""
    return spark.read.schema(RUN_RECORD).json(path)

