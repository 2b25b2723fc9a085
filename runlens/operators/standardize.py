"""Standardization to ``{INPUT, OUTPUT}`` (2.12): rules, overrides, the column
transforms, validation and the batch over many datasets.

Rules are one small row per dataset (metadata, not data); applying them builds
one ``select`` of built-in expressions over the whole dataset, so the
transform is a single map-only pass with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_regex, pystrip
from .common import combine_rows
from .profile import profile_datasets, recommend_mapping, value_string

# --- fixed values: coding languages, option fields and code fences ----------
CODING_LANGUAGES = ["java", "c++", "python", "javascript"]
OPTIONS_FIELDS = ["options", "candidate_answers", "choices", "alternatives"]
ANSWER_OPTION_FIELDS = ["options", "candidate_answers", "choices", "alternatives", "answers", "answer_choices"]
CODE_PATTERNS = {
    "javascript": r"```javascript\s*\n(.*?)\n```",
    "python": r"```python\s*\n(.*?)\n```",
    "java": r"```java\s*\n(.*?)\n```",
    "cpp": r"```cpp\s*\n(.*?)\n```",
    "c++": r"```cpp\s*\n(.*?)\n```",
}
FIELD_SEPARATOR = "\n\n"
PAIR_LABELS = {
    "sentence_pair": ["SENTENCE 1:", "SENTENCE 2:"],
    "context_question": ["CONTEXT:", "QUESTION:"],
}
STORY_LABELS = {"story": "STORY:", "question": "QUESTION:", "candidate_answers": "OPTIONS:"}
MIN_CONFIDENCE = 0.6
MAX_EMPTY_RATIO = 0.1

RULES_SCHEMA = T.StructType([
    T.StructField("dataset_name", T.StringType()),
    T.StructField("transformation_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("input_format", T.StringType()),
    T.StructField("input_fields", T.ArrayType(T.StringType())),
    T.StructField("output_field", T.StringType()),
    T.StructField("field_separator", T.StringType()),
    T.StructField("field_labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("preprocessing_steps", T.ArrayType(T.StringType())),
    T.StructField("language", T.StringType()),
    T.StructField("difficulty_filter", T.StringType()),
])


# ----------------------------------------------------------------------------- column transforms


def format_options(arr) -> Column:
    """``A) x\\nB) y``: letter from ``chr(65 + i)`` (after Z comes ``[``), each
    option stripped; empty for an empty or NULL list."""
    a = F.col(arr) if isinstance(arr, str) else arr
    parts = F.transform(a, lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(") "), pystrip(x.cast("string"))))
    return F.coalesce(F.array_join(parts, "\n"), F.lit(""))


def extract_code(text, language: str | None) -> Column:
    """First fenced block of the language, stripped; the whole text when there
    is none or the language is unknown (``c++`` uses ``cpp`` fences)."""
    t = F.col(text) if isinstance(text, str) else text
    pattern = CODE_PATTERNS.get(language.lower()) if language else None
    if not pattern:
        return t
    rx = py_regex(pattern, "s")
    return F.when(t.rlike(rx), pystrip(F.regexp_extract(t, rx, 1))).otherwise(t)


def _py_str(df: DataFrame, field: str) -> Column:
    """``str(value)`` of a field, ``None`` for NULL as Python prints it."""
    dtype = df.schema[field].dataType
    return F.coalesce(value_string(F.col(f"`{field}`"), dtype), F.lit("None"))


def to_io_single(df: DataFrame, field: str | None) -> Column:
    """INPUT from one field; '' when the field is absent."""
    if not field or field not in df.columns:
        return F.lit("")
    return _py_str(df, field)


def to_io_multi(df: DataFrame, fields: list[str], labels: dict[str, str], separator: str = FIELD_SEPARATOR,
                options_field: str | None = None) -> Column:
    """``LABEL\\n\\nvalue`` parts joined by ``\\n\\n`` + separator; missing fields
    skipped; list fields named like options are formatted as lettered options."""
    parts = []
    for f in fields:
        if f not in df.columns:
            continue
        label = labels.get(f, f"{f.upper()}:")
        dtype = df.schema[f].dataType
        if isinstance(dtype, T.ArrayType) and (f == options_field or f in OPTIONS_FIELDS):
            value = F.when(F.col(f"`{f}`").isNull(), F.lit("None")).otherwise(format_options(F.col(f"`{f}`")))
        else:
            value = _py_str(df, f)
        parts.append(F.concat(F.lit(f"{label}\n\n"), value))
    if not parts:
        return F.lit("")
    return F.concat_ws(f"\n\n{separator}", *parts)


def resolve_answer_index(df: DataFrame, answer_field: str, options_field: str | None = None) -> Column:
    """Integer answer -> the option text (stripped); out of range or negative ->
    the number as text.  Options: the given field, else the first common option
    name holding a list, else the first list column with more than one item."""
    ans = F.col(f"`{answer_field}`")
    if not isinstance(df.schema[answer_field].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return _py_str(df, answer_field)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if options_field and options_field in arrays:
        cands = F.col(f"`{options_field}`")
    else:
        named = [n for n in ANSWER_OPTION_FIELDS if n in arrays]
        if named:
            cands = F.col(f"`{named[0]}`")
        elif arrays:
            cands = F.coalesce(*[F.when(F.size(F.col(f"`{n}`")) > 1, F.col(f"`{n}`")) for n in arrays])
        else:
            return ans.cast("string")
    ok = cands.isNotNull() & (ans >= 0) & (ans < F.size(cands))
    return F.when(ok, pystrip(F.get(cands, ans.cast("int")).cast("string"))).otherwise(ans.cast("string"))


# ----------------------------------------------------------------------------- rules


def make_rules(reco: DataFrame, profile: DataFrame, language: str | None = None,
               difficulty: str | None = None) -> DataFrame:
    """One rules row per dataset from its recommendation: coding datasets
    (``content`` + a language column) override the detection; multi-field
    recommendations get labels (and ``resolve_answer_index`` for story sets);
    a difficulty becomes a filter step."""
    cols = profile.groupBy("dataset_name").agg(F.collect_list("column").alias("columns"))
    j = reco.join(cols, "dataset_name", "left")
    columns = F.coalesce(F.col("columns"), F.array().cast("array<string>"))
    has_content = F.array_contains(columns, "content")
    has_lang = F.lit(False)
    for lang in CODING_LANGUAGES:
        has_lang = has_lang | F.array_contains(columns, lang)
    coding = has_content & has_lang
    field_name = ("c++" if language == "cpp" else language) if language else None
    lang_present = F.array_contains(columns, field_name) if field_name else F.lit(False)
    coding_ok = coding & lang_present
    coding_ask = coding & F.lit(language is None)

    ttype = (
        F.when(coding_ok, F.lit("coding_dataset"))
        .when(coding_ask, F.lit("coding_dataset_needs_language"))
        .otherwise(F.coalesce(F.col("type"), F.lit("manual")))
    )
    conf = F.when(coding_ok, F.lit(1.0)).when(coding_ask, F.lit(0.0)).otherwise(F.coalesce(F.col("confidence"), F.lit(0.0)))
    inputs = F.when(coding_ok | coding_ask, F.array(F.lit("content"))).otherwise(F.col("input_fields"))
    output = F.when(coding_ok, F.lit(field_name)).when(coding_ask, F.lit(None)).otherwise(F.col("output_field"))
    multi = F.col("type") == "multi_field"
    generic = F.map_from_arrays(inputs, F.transform(inputs, lambda f: F.concat(F.upper(F.regexp_replace(f, "_", " ")), F.lit(":"))))
    pair_labels = F.lit(None).cast("map<string,string>")
    for name, labs in PAIR_LABELS.items():
        # the reference indexes two input fields but a pair set has one input
        # field (the other is the output); label the fields that exist
        keys = F.slice(inputs, 1, 2)
        vals = F.slice(F.array(*[F.lit(x) for x in labs]), 1, F.size(keys))
        pair_labels = F.when(F.col("pattern_name") == name, F.map_from_arrays(keys, vals)).otherwise(pair_labels)
    story = F.create_map(*[x for k, v in STORY_LABELS.items() for x in (F.lit(k), F.lit(v))])
    labels = (
        F.when(multi & (F.col("pattern_name") == "story_question_choices"), story)
        .when(multi & F.col("pattern_name").isin(list(PAIR_LABELS)), pair_labels)
        .when(multi, generic)
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    steps = (
        F.when(coding_ok, F.array(F.lit("extract_code_only")))
        .when(multi & (F.col("pattern_name") == "story_question_choices"), F.array(F.lit("resolve_answer_index")))
        .otherwise(F.array().cast("array<string>"))
    )
    if difficulty:
        steps = F.concat(steps, F.array(F.lit("filter_by_difficulty")))
    return j.select(
        "dataset_name",
        ttype.alias("transformation_type"),
        conf.cast("double").alias("confidence"),
        F.when(multi, F.lit("multi_field")).otherwise(F.lit("single_field")).alias("input_format"),
        inputs.alias("input_fields"),
        output.cast("string").alias("output_field"),
        F.lit(FIELD_SEPARATOR).alias("field_separator"),
        labels.alias("field_labels"),
        steps.alias("preprocessing_steps"),
        F.when(coding_ok, F.lit(language)).cast("string").alias("language"),
        F.lit(difficulty.lower() if difficulty else None).cast("string").alias("difficulty_filter"),
    )


def override_rules(rules: DataFrame, overrides: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual corrections (dataset_name, input_fields, output_field,
    preprocessing_steps) win over generated rules when all their fields exist;
    confidence 1.0 and labels rebuilt.  Returns (rules, rejected overrides)."""
    cols = profile.groupBy("dataset_name").agg(F.collect_set("column").alias("_cols"))
    o = overrides.join(cols, "dataset_name", "left")
    valid = F.coalesce(
        F.forall("input_fields", lambda f: F.array_contains(F.col("_cols"), f))
        & F.array_contains(F.col("_cols"), F.col("output_field")),
        F.lit(False),
    )
    o = o.withColumn("_valid", valid)
    rejected = o.filter(~F.col("_valid")).select(
        "dataset_name", "input_fields", "output_field", F.lit("field not in dataset").alias("reason")
    )
    good = o.filter(F.col("_valid"))
    fields = F.col("o_in")
    story = F.create_map(*[x for k, v in STORY_LABELS.items() for x in (F.lit(k), F.lit(v))])
    is_story = (F.size(F.array_distinct(fields)) == 3) & F.forall(fields, lambda f: f.isin(list(STORY_LABELS)))
    ctx_q = F.array_contains(fields, "context") & F.array_contains(fields, "question")
    f0, f1 = F.get(fields, 0), F.get(fields, 1)
    pair = F.map_from_arrays(
        F.array(f0, f1),
        F.array(
            F.when(f0.contains("context"), F.lit("CONTEXT:")).otherwise(F.lit("INPUT:")),
            F.when(f1.contains("question"), F.lit("QUESTION:")).otherwise(F.lit("QUERY:")),
        ),
    )
    generic = F.map_from_arrays(fields, F.transform(fields, lambda f: F.concat(F.upper(f), F.lit(":"))))
    labels = F.when(is_story, story).when(ctx_q, pair).otherwise(generic)
    g = good.select(
        "dataset_name",
        F.col("input_fields").alias("o_in"),
        F.col("output_field").alias("o_out"),
        F.col("preprocessing_steps").alias("o_steps"),
    )
    j = rules.join(g, "dataset_name", "left")
    has = F.col("o_in").isNotNull()
    out = j.select(
        "dataset_name",
        "transformation_type",
        F.when(has, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        "input_format",
        F.when(has, F.col("o_in")).otherwise(F.col("input_fields")).alias("input_fields"),
        F.when(has, F.col("o_out")).otherwise(F.col("output_field")).alias("output_field"),
        "field_separator",
        F.when(has, labels).otherwise(F.col("field_labels")).alias("field_labels"),
        F.when(has, F.coalesce(F.col("o_steps"), F.array().cast("array<string>"))).otherwise(F.col("preprocessing_steps")).alias(
            "preprocessing_steps"
        ),
        "language",
        "difficulty_filter",
        has.alias("manually_corrected"),
    )
    return out, rejected


def apply_rules(df: DataFrame, rules: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """``{INPUT, OUTPUT}`` of a dataset under one rules row (a dict): one select
    of built-in expressions, after the optional difficulty filter; ``keep``
    carries key columns along."""
    steps = list(rules.get("preprocessing_steps") or [])
    if "filter_by_difficulty" in steps and rules.get("difficulty_filter") and "difficulty" in df.columns:
        df = df.filter(F.lower(F.col("difficulty")) == rules["difficulty_filter"])
    fields = list(rules.get("input_fields") or [])
    if rules.get("input_format") == "multi_field":
        inp = to_io_multi(df, fields, dict(rules.get("field_labels") or {}), rules.get("field_separator") or FIELD_SEPARATOR,
                          rules.get("answer_options_field"))
    else:
        inp = to_io_single(df, fields[0] if fields else None)
    out_f = rules.get("output_field")
    if out_f and out_f in df.columns:
        if "extract_code_only" in steps:
            out = extract_code(_py_str(df, out_f), rules.get("language"))
        elif "resolve_answer_index" in steps:
            out = resolve_answer_index(df, out_f, rules.get("answer_options_field"))
        else:
            out = _py_str(df, out_f)
    else:
        out = F.lit("")
    return df.select(*keep, inp.alias("INPUT"), out.alias("OUTPUT"))


# ----------------------------------------------------------------------------- validation


def validate_io(original: DataFrame, transformed: DataFrame) -> DataFrame:
    """Counts kept, blank INPUT / OUTPUT; fails when counts differ or blanks
    exceed 10% of all cells; issues listed."""
    o = original.agg(F.count(F.lit(1)).alias("original_samples"))
    t = transformed.agg(
        F.count(F.lit(1)).alias("transformed_samples"),
        F.sum((pystrip(F.coalesce("INPUT", F.lit(""))) == "").cast("long")).alias("empty_inputs"),
        F.sum((pystrip(F.coalesce("OUTPUT", F.lit(""))) == "").cast("long")).alias("empty_outputs"),
    )
    j = combine_rows(o, t)  # one row each, side by side
    n = F.col("transformed_samples")
    ei = F.coalesce(F.col("empty_inputs"), F.lit(0))
    eo = F.coalesce(F.col("empty_outputs"), F.lit(0))
    ratio = F.when(n > 0, (ei + eo) / (2.0 * n))
    preserved = F.col("original_samples") == n
    issues = F.filter(
        F.array(
            F.when(~preserved, F.concat(F.lit("Sample count changed: "), F.col("original_samples").cast("string"),
                                        F.lit(" -> "), n.cast("string"))),
            F.when(ei > 0, F.concat(ei.cast("string"), F.lit(" samples have empty INPUT fields"))),
            F.when(eo > 0, F.concat(eo.cast("string"), F.lit(" samples have empty OUTPUT fields"))),
            F.when(ratio > MAX_EMPTY_RATIO, F.lit("Too many empty fields")),
        ),
        lambda x: x.isNotNull(),
    )
    return j.select(
        preserved.alias("sample_count_preserved"),
        "original_samples",
        "transformed_samples",
        ei.alias("empty_inputs"),
        eo.alias("empty_outputs"),
        F.coalesce(ratio, F.lit(0.0)).alias("empty_ratio"),
        (preserved & F.coalesce(ratio <= MAX_EMPTY_RATIO, F.lit(True))).alias("validation_passed"),
        issues.alias("issues"),
    )


def validate_format(df: DataFrame, key: str | None = None) -> DataFrame:
    """Required INPUT/OUTPUT columns, empty table, blank first row, all-NULL
    columns: one row with is_valid and the errors."""
    has_in, has_out = "INPUT" in df.columns, "OUTPUT" in df.columns
    aggs = [F.count(F.lit(1)).alias("num_rows")]
    if has_in and has_out:
        first = F.min_by(F.struct("INPUT", "OUTPUT"), F.col(key)) if key else F.first(F.struct("INPUT", "OUTPUT"))
        aggs += [F.count("INPUT").alias("_nin"), F.count("OUTPUT").alias("_nout"), first.alias("_first")]
    a = df.agg(*aggs)
    errors = [F.when(F.lit(not has_in), F.lit("Missing required 'INPUT' column")),
              F.when(F.lit(not has_out), F.lit("Missing required 'OUTPUT' column")),
              F.when(F.col("num_rows") == 0, F.lit("File is empty"))]
    if has_in and has_out:
        errors += [
            F.when((F.col("num_rows") > 0) & (F.col("_nin") == 0), F.lit("INPUT column is empty")),
            F.when((F.col("num_rows") > 0) & (F.col("_nout") == 0), F.lit("OUTPUT column is empty")),
            F.when(F.coalesce(F.col("_first.INPUT"), F.lit("")) == "", F.lit("INPUT column contains empty values")),
            F.when(F.coalesce(F.col("_first.OUTPUT"), F.lit("")) == "", F.lit("OUTPUT column contains empty values")),
        ]
    errs = F.filter(F.array(*errors), lambda x: x.isNotNull())
    return a.select(
        (F.size(errs) == 0).alias("is_valid"),
        errs.alias("errors"),
        "num_rows",
        F.lit(has_in).alias("has_input"),
        F.lit(has_out).alias("has_output"),
    )


def validate_export(df: DataFrame, path: str, size_bytes: int | None = None, max_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """Format by suffix (csv / json / parquet), rows, schema, and a warning
    past 100 MB: one row."""
    fmt = "csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet" if path.endswith(".parquet") else None
    ok_schema = "INPUT" in df.columns and "OUTPUT" in df.columns
    a = df.agg(F.count(F.lit(1)).alias("num_rows"))
    errors = F.filter(F.array(
        F.when(F.lit(fmt is None), F.lit("Unsupported file format")),
        F.when(F.lit(not ok_schema), F.lit("Dataset must have INPUT and OUTPUT columns")),
        F.when(F.col("num_rows") == 0, F.lit("Dataset is empty")),
    ), lambda x: x.isNotNull())
    warnings = F.filter(F.array(
        F.when(F.lit(size_bytes is not None and size_bytes > max_bytes), F.lit("File is larger than 100 MB")),
    ), lambda x: x.isNotNull())
    return a.select(
        F.lit(fmt).cast("string").alias("format"),
        "num_rows",
        F.lit(ok_schema).alias("has_input_output"),
        (F.size(errors) == 0).alias("is_valid"),
        errors.alias("errors"),
        warnings.alias("warnings"),
    )


# ----------------------------------------------------------------------------- batch


def standardize_batch(datasets: dict[str, tuple[DataFrame, str | None]], language: str | None = None,
                      difficulty: str | None = None, min_confidence: float = MIN_CONFIDENCE,
                      writer=None) -> DataFrame:
    """Many datasets: profile, rules, skip below ``min_confidence``, transform,
    validate, record.  One job profiles all datasets (each on its own if that
    fails); transforming and validating is a job a dataset; a failure is
    recorded and the rest go on.  ``writer(name, df)`` persists outputs."""
    spark = next(iter(datasets.values()))[0].sparkSession

    def rules_of(some: dict) -> dict[str, dict]:
        prof = profile_datasets(some)
        found = make_rules(recommend_mapping(prof), prof, language, difficulty).collect()  # one row of metadata a dataset
        return {r.dataset_name: r.asDict(recursive=True) for r in found}

    try:
        rules = rules_of(datasets)
    except Exception:  # one of them cannot be read: find out which below
        rules = {}
    records = []
    for name, (df, key) in datasets.items():
        try:
            r = rules[name] if name in rules else rules_of({name: (df, key)})[name]
            if r["confidence"] < min_confidence:
                records.append((name, "skipped", float(r["confidence"]), None, None, None, "low confidence"))
                continue
            out = apply_rules(df, r)
            v = validate_io(df, out).collect()[0]
            if writer is not None and v["validation_passed"]:
                writer(name, out)
            records.append((name, "processed" if v["validation_passed"] else "failed", float(r["confidence"]),
                            int(v["original_samples"]), int(v["transformed_samples"]), bool(v["validation_passed"]),
                            "; ".join(v["issues"]) or None))
        except Exception as e:  # one failure does not stop the batch
            records.append((name, "failed", None, None, None, None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(
        records,
        "dataset_name string, status string, confidence double, original_samples long, "
        "processed_samples long, validation_passed boolean, error string",
    )


def preprocessing_status(prep: DataFrame, dataset_name: str | None = None, config: str | None = None) -> DataFrame:
    """Latest record per dataset (and config), optionally for one name."""
    p = prep if dataset_name is None else prep.filter(F.col("dataset_name") == dataset_name)
    if config is not None:
        p = p.filter(F.col("dataset_config") == config)
    cols = p.columns
    return p.groupBy("dataset_name", "dataset_config").agg(
        F.max_by(F.struct(*cols), F.struct("processed_at", "id")).alias("_r")
    ).select("_r.*")


def list_preprocessed(prep: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Records newest first, optionally by status."""
    p = prep if status is None else prep.filter(F.col("status") == status)
    p = p.orderBy(F.col("processed_at").desc(), F.col("id"))
    return p.limit(limit) if limit else p

