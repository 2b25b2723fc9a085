"""Dataset profiling (2.12): column profiles, input/output role detection,
field sets and the recommended mapping.

A profile covers every row of a dataset (its first ``n_rows`` by a key only if
the caller asks).  Values are counted by their lower-cased digest first, a
partial aggregation, so no task holds a column; the sample values are a top 3
of each column by the key.  The fixed pattern lists become CASE chains and
aggregate expressions, so no step joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PY_WS

# --- fixed values: role patterns, in order of specificity -------------------
INPUT_PATTERNS = [
    "question", "input", "text", "sentence", "context", "prompt", "query",
    "problem", "statement", "passage", "content",
]
OUTPUT_PATTERNS = [
    "full_answer", "complete_answer", "detailed_answer", "oracle_full_answer",
    "full_response", "complete_response", "detailed_response", "answer", "output",
    "label", "target", "response", "solution", "result", "ground_truth",
    "correct_answer", "expected",
]
# --- fixed values: multi-field sets, in order --------------------------------
FIELD_SETS = [
    ("sentence_pair", ["sentence1", "sentence2"]),
    ("premise_hypothesis", ["premise", "hypothesis"]),
    ("context_question", ["context", "question"]),
    ("passage_question", ["passage", "question"]),
    ("story_question_choices", ["story", "question", "candidate_answers"]),
    ("conversation", ["conversation", "response"]),
    ("code_description", ["code", "description"]),
    ("instruction_input", ["instruction", "input"]),
]
# --- fixed values: scoring words and prefixes --------------------------------
COMPLETE_WORDS = ["full", "complete", "detailed", "comprehensive"]
ORACLE_WORDS = ["oracle", "ground_truth", "reference"]
BOOST_PATTERNS = ["answer", "response", "output"]
STRUCTURED_PREFIXES = ["A.", "B.", "C.", "D.", "1.", "2.", "("]
BOOLEAN_VALUES = ["true", "false", "1", "0", "yes", "no"]

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def value_string(col: Column, dtype: T.DataType) -> Column:
    """Text of a value as Python's ``str`` shows it (booleans ``True``/``False``,
    lists of strings as ``['a', 'b']``)."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    if isinstance(dtype, T.ArrayType):
        inner = F.transform(col, lambda v: F.concat(F.lit("'"), v.cast("string"), F.lit("'")))
        return F.when(col.isNotNull(), F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]")))
    return col.cast("string")


SAMPLE_VALUES = 3


def first_rows(df: DataFrame, key: str | None, n_rows: int) -> DataFrame:
    """The first ``n_rows`` rows by ``key``, NULL keys first (read order without a key)."""
    return df.orderBy(key).limit(n_rows) if key else df.limit(n_rows)


def _structured(x: Column) -> Column:
    """The stripped text begins like a list item: one anchored pattern, the text itself is not copied."""
    return x.rlike(f"^{PY_WS}*(?:{'|'.join(re.escape(p) for p in STRUCTURED_PREFIXES)})")


_KEYS = ["dataset_name", "column", "position", "dtype", "native_numeric"]


def _counted(df: DataFrame, dataset_name: str) -> DataFrame:
    """One row per column and distinct lower-cased value, in one scan of the dataset.

    Cells are grouped by fixed-width keys: the column's number and a 128-bit hash
    of the value; names and types are put beside the counts afterwards.
    """
    fields = df.schema.fields
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), value_string(F.col(f"`{f.name}`"), f.dataType).alias("v")) for i, f in enumerate(fields)
    ]))
    v, low = F.col("v"), F.lower(F.col("v"))
    counts = (
        df.select(cells.alias("c")).select("c.*").filter(v.isNotNull())
        .groupBy("position", F.xxhash64(low).alias("_h1"), F.xxhash64(F.lit(1), low).alias("_h2"))
        .agg(
            F.count(v).alias("n"),
            F.sum(F.length(v)).alias("chars"),
            F.bool_and(v.try_cast("double").isNotNull()).alias("num"),
            F.bool_and(low.isin(BOOLEAN_VALUES)).alias("boo"),
            F.sum(F.when(_structured(v), 1).otherwise(0)).alias("structured"),
        )
    )
    named = F.element_at(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.lit(isinstance(f.dataType, _NUMERIC + (T.BooleanType,))).alias("native_numeric")) for f in fields
    ]), F.col("position") + 1)
    return counts.select(F.lit(dataset_name).alias("dataset_name"), "position", named.alias("_f"), "n", "chars", "num", "boo", "structured").select(
        "dataset_name", "_f.column", "position", "_f.dtype", "_f.native_numeric", "n", "chars", "num", "boo", "structured")


def _samples(df: DataFrame, dataset_name: str, key: str | None) -> DataFrame:
    """The first non-NULL values of each column: a top-n per column that reads the key and that column alone."""
    out = None
    for i, f in enumerate(df.schema.fields):
        order = F.col(f"`{key}`") if key else F.monotonically_increasing_id()
        top = (df.select(order.alias("k"), value_string(F.col(f"`{f.name}`"), f.dataType).alias("v"))
               .filter(F.col("v").isNotNull()).orderBy("k").limit(SAMPLE_VALUES))
        got = top.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("samples")).select(
            F.lit(dataset_name).alias("dataset_name"), F.lit(f.name).alias("column"), F.lit(i).alias("position"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(isinstance(f.dataType, _NUMERIC + (T.BooleanType,))).alias("native_numeric"), "samples")
        out = got if out is None else out.unionByName(got)
    return out


def _profile(counted: DataFrame, samples: DataFrame) -> DataFrame:
    stats = counted.groupBy(*_KEYS).agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("uq"),
        F.bool_and("num").alias("num"), F.bool_and("boo").alias("boo"), F.sum("structured").alias("sc"),
    )
    # one stats row at most and one sample row per column: put side by side by an aggregate
    both = stats.unionByName(samples, allowMissingColumns=True).groupBy(*_KEYS).agg(
        *[F.max(c).alias(c) for c in ("n", "chars", "uq", "num", "boo", "sc")], F.first("samples", ignorenulls=True).alias("_s"))
    g = both.select(
        *_KEYS,
        F.coalesce("n", F.lit(0)).alias("n_values"),
        F.try_divide(F.col("chars").cast("double"), F.col("n").cast("double")).alias("avg_length_raw"),
        F.coalesce("uq", F.lit(0)).alias("unique_values"),
        (F.col("native_numeric") | F.col("num")).alias("_numeric"),
        F.col("boo").alias("_boolean"),
        F.coalesce("sc", F.lit(0)).alias("structured_count"),
        "_s",
    )
    ctype = (
        F.when(F.col("n_values") == 0, F.lit("empty"))
        .when((F.col("avg_length_raw") < 10) & (F.col("unique_values") < F.col("n_values") * 0.5), F.lit("categorical"))
        .when(F.col("_boolean"), F.lit("boolean"))
        .when(F.col("_numeric"), F.lit("numeric"))
        .otherwise(F.lit("text"))
    )
    return g.select(
        "dataset_name",
        "column",
        "position",
        "dtype",
        ctype.alias("type"),
        F.coalesce(F.round("avg_length_raw", 1), F.lit(0.0)).alias("avg_length"),
        F.coalesce("avg_length_raw", F.lit(0.0)).alias("avg_length_raw"),
        F.col("unique_values").cast("long").alias("unique_values"),
        F.col("n_values").cast("long").alias("n_values"),
        F.col("structured_count").cast("long").alias("structured_count"),
        F.col("_s").alias("sample_values"),
    )


def profile_datasets(datasets: dict[str, tuple[DataFrame, str | None]], n_rows: int | None = None,
                     materialize: bool = True) -> DataFrame:
    """Profiles of many datasets in one job.  ``datasets`` maps a name to
    (DataFrame, key); ``n_rows`` reads only that many first rows of each."""
    counted = samples = None
    for name, (df, key) in datasets.items():
        if n_rows is not None:
            df = first_rows(df, key, n_rows)
        c, s = _counted(df, name), _samples(df, name, key)
        counted = c if counted is None else counted.unionByName(c)
        samples = s if samples is None else samples.unionByName(s)
    out = _profile(counted, samples)
    if materialize:
        from ..session import cut_lineage

        out = cut_lineage(out)
    return out


def profile_columns(df: DataFrame, dataset_name: str, key: str | None = None,
                    n_rows: int | None = None, materialize: bool = True) -> DataFrame:
    """One row per column: type (empty / text / numeric / boolean / categorical),
    average length (1 place), distinct lower-cased values, 3 sample values, and
    the content statistics the role scoring uses.

    The profile (one small row per column) is checkpointed into the shared
    checkpoint dir, so the steps that read it several times (roles, field sets,
    rules) do not scan the dataset again."""
    return profile_datasets({dataset_name: (df, key)}, n_rows, materialize)


def first_pattern(column: Column, patterns: list[str]) -> Column:
    """The first pattern (in list order) the lower-cased name contains, or NULL:
    a CASE chain over the fixed list, no join."""
    low = F.lower(column)
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(low.contains(p), F.lit(p)).otherwise(out)
    return out


def completeness_score(column: Column) -> Column:
    low = F.lower(column)
    full = F.lit(False)
    for w in COMPLETE_WORDS:
        full = full | low.contains(w)
    oracle = F.lit(False)
    for w in ORACLE_WORDS:
        oracle = oracle | low.contains(w)
    return (
        F.when(full, F.lit(0.3)).otherwise(F.lit(0.0))
        + F.when(oracle, F.lit(0.2)).otherwise(F.lit(0.0))
        + F.least(F.lit(0.2), F.length(column) / 50.0)
    )


def content_boost(pattern: Column) -> Column:
    """+0.1 for average length > 20, +0.1 when more than half of the values
    start like an enumerated answer; only for answer/response/output; max 0.2."""
    boost = F.when(F.col("avg_length_raw") > 20, F.lit(0.1)).otherwise(F.lit(0.0)) + F.when(
        F.col("structured_count") > F.col("n_values") * 0.5, F.lit(0.1)
    ).otherwise(F.lit(0.0))
    applies = pattern.isin(BOOST_PATTERNS) & (F.col("n_values") > 0)
    return F.when(applies, F.least(F.lit(0.2), boost)).otherwise(F.lit(0.0))


def detect_roles(profile: DataFrame) -> DataFrame:
    """For every column: the first input pattern and the first output pattern it
    contains, with confidence (1.0 exact / 0.8 contained, plus content boost,
    capped at 1) and completeness score."""
    kinds = F.explode(F.array(
        F.struct(F.lit("input").alias("kind"), first_pattern(F.col("column"), INPUT_PATTERNS).alias("pattern")),
        F.struct(F.lit("output").alias("kind"), first_pattern(F.col("column"), OUTPUT_PATTERNS).alias("pattern")),
    ))
    out = profile.select("*", kinds.alias("_r")).select("*", "_r.kind", "_r.pattern").filter(F.col("pattern").isNotNull())
    base = F.when(F.lower(F.col("column")) == F.col("pattern"), F.lit(1.0)).otherwise(F.lit(0.8))
    return out.select(
        "dataset_name",
        "column",
        "position",
        "kind",
        "pattern",
        F.least(F.lit(1.0), base + content_boost(F.col("pattern"))).alias("confidence"),
        completeness_score(F.col("column")).alias("completeness"),
    )


def detect_field_sets(profile: DataFrame) -> DataFrame:
    """Field sets whose every field maps to a column (the first column, in
    column order, whose name contains the field); columns in field order.
    One aggregate per dataset over the (small) profile, no join."""
    low = F.lower(F.col("column"))
    aggs = []
    for si, (name, fields) in enumerate(FIELD_SETS):
        for fi, field in enumerate(fields):
            pick = F.min(F.when(low.contains(field.lower()), F.struct("position", "column")))
            aggs.append(pick["column"].alias(f"_s{si}_{fi}"))
    per = profile.groupBy("dataset_name").agg(*aggs)
    rows = []
    for si, (name, fields) in enumerate(FIELD_SETS):
        cols = [F.col(f"_s{si}_{fi}") for fi in range(len(fields))]
        complete = F.lit(True)
        for c in cols:
            complete = complete & c.isNotNull()
        rows.append(F.when(complete, F.struct(F.lit(name).alias("set_name"), F.lit(si).alias("set_order"),
                                              F.array(*cols).alias("columns"))))
    found = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return per.select("dataset_name", F.explode(found).alias("s")).select("dataset_name", "s.*")


def recommend_mapping(profile: DataFrame) -> DataFrame:
    """Per dataset: a field set if any (the longest, first on ties; its last
    field is the output; confidence 0.8), else the best input and output columns
    by (confidence, completeness, column order) with their mean confidence,
    else ``unknown``."""
    roles = detect_roles(profile)
    sets = detect_field_sets(profile)
    ws = Window.partitionBy("dataset_name").orderBy(F.size("columns").desc(), F.col("set_order"))
    best_set = sets.withColumn("_r", F.row_number().over(ws)).filter(F.col("_r") == 1).select(
        "dataset_name", F.col("set_name").alias("pattern_name"), F.col("columns").alias("set_columns")
    )
    wr = Window.partitionBy("dataset_name", "kind").orderBy(
        F.col("confidence").desc(), F.col("completeness").desc(), F.col("position")
    )
    top = roles.withColumn("_r", F.row_number().over(wr)).filter(F.col("_r") == 1)
    best_in = top.filter(F.col("kind") == "input").select("dataset_name", F.col("column").alias("in_col"), F.col("confidence").alias("in_conf"))
    best_out = top.filter(F.col("kind") == "output").select(
        "dataset_name", F.col("column").alias("out_col"), F.col("confidence").alias("out_conf")
    )
    ds = profile.select("dataset_name").distinct()
    j = ds.join(best_set, "dataset_name", "left").join(best_in, "dataset_name", "left").join(best_out, "dataset_name", "left")
    multi = F.col("set_columns").isNotNull()
    single = F.col("in_col").isNotNull() & F.col("out_col").isNotNull()
    n = F.size("set_columns")
    return j.select(
        "dataset_name",
        F.when(multi, F.lit("multi_field")).when(single, F.lit("single_field")).otherwise(F.lit("unknown")).alias("type"),
        F.when(multi, F.col("pattern_name")).alias("pattern_name"),
        F.when(multi, F.slice("set_columns", 1, n - 1))
        .when(single, F.array("in_col"))
        .otherwise(F.array().cast("array<string>"))
        .alias("input_fields"),
        F.when(multi, F.element_at("set_columns", -1)).when(single, F.col("out_col")).alias("output_field"),
        F.when(multi, F.lit(0.8)).when(single, (F.col("in_conf") + F.col("out_conf")) / 2).otherwise(F.lit(0.0)).alias("confidence"),
    )
