"""Answer extraction and scoring as column expressions (2.10).

Everything here is a built-in Spark expression evaluated inside whole-stage
codegen; nothing calls Python per row.  Regexes are compiled by
``text.py_regex`` so that Java matches what Python's ``re`` matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prompts import SUFFIXES, TEMPLATES
from .text import blank_to_null, nonblank_lines, py_regex, pystrip, word_count

# --- fixed values: the answer patterns, tried in this order ------------------
ANSWER_PATTERNS = [
    r"(?:final\s+)?answer\s*:\s*(.+?)(?:\n|$)",
    r"\(([^)]+)\)$",
    r"\[([^\]]+)\]$",
    r"(?:^|\n)([A-Za-z0-9\s\-\.]+)(?:\s*\.?\s*)?$",
    r"\b(yes|no|true|false)\b",
    r"\b([A-E])\b(?:\)|\.|\s|$)",
]

# --- fixed values: prefixes removed from an answer, in this order ------------
ANSWER_PREFIXES = [
    "the answer is ",
    "answer: ",
    "final answer: ",
    "therefore, ",
    "thus, ",
    "so, ",
    "hence, ",
    "the final answer to the question",
]

# --- fixed values: cost per 1k tokens by provider; others 0.001 --------------
COST_PER_1K = {"anthropic": 0.008, "cohere": 0.002, "openrouter": 0.0002}
DEFAULT_COST_PER_1K = 0.001

# --- fixed values: multi-call detection --------------------------------------
MULTI_CALL_PATTERNS = [
    r"function_call.*?function_call",
    r"tool_call.*?tool_call",
    r'\{[^}]*"function"[^}]*\}.*?\{[^}]*"function"[^}]*\}',
    r"<tool_call>.*?</tool_call>.*?<tool_call>.*?</tool_call>",
    r"```[^`]*```.*?```[^`]*```",
]
STEP_INDICATORS = [
    "step 1:", "step 2:", "step 3:", "first,", "second,", "third,",
    "1.", "2.", "3.", "next,", "then,", "finally,",
]

CONFIDENCE_THRESHOLD = 0.7


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _last_match(text: Column, pattern: str, flags: str = "im") -> Column:
    """Last capture of ``pattern`` (group 1), NULL when there is no match."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(py_regex(pattern, flags)), F.lit(1)), F.lit(-1))


def first_pattern_last_match(text) -> Column:
    """Last match of the first answer pattern that matches at all.

    ``coalesce`` evaluates lazily, so later patterns only run when the earlier
    ones found nothing.
    """
    t = _c(text)
    return F.coalesce(*[_last_match(t, p) for p in ANSWER_PATTERNS])


def last_line_answer(text) -> Column:
    """Last non-empty (stripped) line, else the first 100 characters."""
    t = _c(text)
    return F.coalesce(F.try_element_at(nonblank_lines(t), F.lit(-1)), F.substring(t, 1, 100))


def extract_answer(df: DataFrame, text_col: str = "raw_output", prefix: str = "") -> DataFrame:
    """Regex answer cascade; adds ``{prefix}final_answer``, ``{prefix}confidence``
    and ``{prefix}extraction_method`` (= 'regex').

    First pattern with a match -> its last match stripped, 0.5; an empty one
    falls through to the last non-empty line, 0.2; else the first 100 chars of
    the stripped text + '...', 0.1.
    """
    m = f"_{prefix}m"
    l = f"_{prefix}l"
    t = F.col(text_col)
    # one projection computes each cascade arm once; the next one combines them
    df = df.withColumn(m, pystrip(first_pattern_last_match(t))).withColumn(
        l, F.try_element_at(nonblank_lines(t), F.lit(-1))
    )
    hit = F.col(m).isNotNull() & (F.col(m) != "")
    df = df.withColumn(
        f"{prefix}final_answer",
        F.when(hit, F.col(m))
        .when(F.col(l).isNotNull(), F.col(l))
        .otherwise(F.concat(F.substring(pystrip(t), 1, 100), F.lit("..."))),
    ).withColumn(
        f"{prefix}confidence",
        F.when(hit, F.lit(0.5)).when(F.col(l).isNotNull(), F.lit(0.2)).otherwise(F.lit(0.1)),
    ).withColumn(f"{prefix}extraction_method", F.lit("regex"))
    return df.drop(m, l)


def _prefix_regex() -> str:
    """One anchored regex equal to the sequential prefix loop: each prefix at
    most once, in list order, with the text stripped in between.  The loop tests
    ``startswith`` on stripped text, so a prefix ending in a space only matches
    when a non-space follows it."""
    from .text import quote_regex

    parts = []
    for p in ANSWER_PREFIXES:
        tail = "(?=\\S)" if p[-1].isspace() else ""
        parts.append(f"(?:{quote_regex(p)}\\s*{tail})?")
    return py_regex("^\\s*" + "".join(parts), "i")


def clean_answer(answer) -> Column:
    """Strip the known prefixes (list order, case-insensitive, each at most once,
    stripping in between), then drop the final period of a one-word answer.
    NULL for an empty answer (the reference rejects it)."""
    a = _c(answer)
    v = F.regexp_replace(F.regexp_replace(a, _prefix_regex(), ""), r"\s+$", "")
    one_word_dot = (word_count(v) == 1) & v.endswith(".")
    v = F.when(one_word_dot, F.regexp_replace(v, r"\.$", "")).otherwise(v)
    return F.when(a.isNull() | (a == ""), F.lit(None).cast("string")).otherwise(pystrip(v))


def answer_or_text(answer, text) -> Column:
    """Extracted answer if non-blank, else the raw text."""
    a, t = _c(answer), _c(text)
    return F.when(blank_to_null(a).isNotNull(), a).otherwise(t)


def is_correct_strict(answer, expected) -> Column:
    """Both non-empty (tested before stripping) and equal after strip + lower;
    never NULL."""
    a = _c(answer).cast("string")
    e = _c(expected).cast("string")
    nonempty = a.isNotNull() & (a != "") & e.isNotNull() & (e != "")
    same = F.lower(pystrip(a)) == F.lower(pystrip(e))
    return F.coalesce(nonempty & same, F.lit(False))


def is_correct_fallback(answer, text, expected) -> Column:
    """Expected non-empty after strip, equal (strip + lower) to the answer, or
    to the raw text when the answer is blank; never NULL."""
    e = F.lower(pystrip(F.coalesce(_c(expected).cast("string"), F.lit(""))))
    actual = F.lower(pystrip(answer_or_text(answer, text)))
    return F.coalesce((e != "") & (e == actual), F.lit(False))


def detect_multi_call(text) -> Column:
    """Any of the tool-call patterns (dot matches newline, case-insensitive), or
    at least two of the step indicators contained in the lower-cased text."""
    t = _c(text)
    pat = F.lit(False)
    for p in MULTI_CALL_PATTERNS:
        pat = pat | t.rlike(py_regex(p, "is"))
    low = F.lower(t)
    steps = sum(low.contains(s).cast("int") for s in STEP_INDICATORS)
    return F.coalesce(pat | (steps >= 2), F.lit(False))


def estimate_cost(tokens, provider) -> Column:
    """tokens / 1000 x provider rate (default 0.001), rounded to 6 places."""
    rates = F.create_map(*[x for k, v in COST_PER_1K.items() for x in (F.lit(k), F.lit(v))])
    rate = F.coalesce(rates[F.lower(_c(provider))], F.lit(DEFAULT_COST_PER_1K))
    return F.round(_c(tokens).cast("double") / 1000.0 * rate, 6)


def accept_extraction(structured_answer, structured_conf, regex_answer, regex_conf,
                      threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    """Structured extraction kept when its confidence >= threshold, else the
    regex fallback. Returns struct(final_answer, confidence, parsing_method)."""
    ok = _c(structured_conf) >= threshold
    return F.when(
        ok, F.struct(_c(structured_answer).alias("final_answer"), _c(structured_conf).cast("double").alias("confidence"),
                     F.lit("instructor").alias("parsing_method"))
    ).otherwise(
        F.struct(_c(regex_answer).alias("final_answer"), _c(regex_conf).cast("double").alias("confidence"),
                 F.lit("regex").alias("parsing_method"))
    )


def primary_extraction(extractions: DataFrame, key: str = "response_id", order_col: str = "position") -> DataFrame:
    """Of several extractions per response: the one with the highest confidence
    (first on ties), and the mean confidence as the combined confidence."""
    best = F.max_by(
        F.struct(F.col(order_col).alias("position"), F.col("final_answer"), F.col("confidence")),
        F.struct(F.col("confidence"), (-F.col(order_col)).alias("neg_pos")),
    )
    return extractions.groupBy(key).agg(
        best.alias("primary"),
        F.avg("confidence").alias("combined_confidence"),
        F.count(F.lit(1)).alias("total_extractions"),
    ).select(
        key,
        F.col("primary.position").alias("primary_position"),
        F.col("primary.final_answer").alias("primary_answer"),
        F.col("primary.confidence").alias("primary_confidence"),
        "combined_confidence",
        "total_extractions",
    )


KINDS = ["multiple_choice", "numerical", "textual", "yes_no", "list", "reasoning_chain", "base"]


def typed_answer(df: DataFrame) -> DataFrame:
    """Per-kind normalization of a structured extraction.

    Input: kind, final_answer, confidence, option, number (string), answer_type,
    items (array<string>), steps (array<string>); yes_no (boolean), unit
    (string) and key_points (array<string>) where the table has them.  Adds the
    normalized columns and ``invalid_reason`` (NULL when the extraction is
    valid).  A yes/no extraction needs a value if the table has the column.
    """
    kind = F.lower(F.col("kind"))
    opt = pystrip(F.col("option"))
    one_letter = F.upper(opt).rlike(r"^\p{L}$")
    given = {c: F.col(c) if c in df.columns else F.lit(None).cast(t)
             for c, t in (("yes_no", "boolean"), ("unit", "string"), ("key_points", "array<string>"))}
    items = F.filter(F.transform(F.col("items"), lambda x: pystrip(x)), lambda x: x != "")
    steps = F.filter(F.transform(F.col("steps"), lambda x: pystrip(x)), lambda x: x != "")
    number = F.col("number").cast("string")
    out = df.select(
        "*",
        pystrip(F.col("final_answer")).alias("answer_clean"),
        F.when(kind == "multiple_choice", F.when(one_letter, F.upper(opt)).otherwise(opt)).alias("option_clean"),
        F.when(kind == "numerical", pystrip(number).try_cast("double")).alias("number_value"),
        F.when(kind == "textual", F.lower(pystrip(F.col("answer_type")))).alias("answer_type_clean"),
        F.when(kind == "list", items).alias("items_clean"),
        F.when((kind == "list") & (F.size(items) > 0), F.size(items).cast("long")).alias("item_count"),
        F.when(kind == "reasoning_chain", steps).alias("steps_clean"),
        F.when(kind == "yes_no", given["yes_no"]).alias("yes_no_value"),
        F.when(kind == "numerical", given["unit"]).alias("number_unit"),
        F.when(kind == "textual", F.coalesce(given["key_points"], F.array().cast("array<string>"))).alias("points"),
    )
    blank = F.coalesce(F.col("answer_clean"), F.lit("")) == ""
    reason = (
        F.when(blank, F.lit("empty final_answer"))
        .when(F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1),
              F.lit("confidence out of range"))
        .when((kind == "multiple_choice") & (F.coalesce(opt, F.lit("")) == ""), F.lit("empty selected_option"))
        .when((kind == "numerical") & F.col("number_value").isNull(), F.lit("invalid numerical_value"))
        .when((kind == "textual") & (F.coalesce(F.col("answer_type_clean"), F.lit("")) == ""), F.lit("empty answer_type"))
        .when((kind == "yes_no") & F.lit("yes_no" in df.columns) & F.col("yes_no_value").isNull(), F.lit("missing yes_no_answer"))
        .when((kind == "list") & (F.coalesce(F.size(F.col("items")), F.lit(0)) <= 0), F.lit("empty items"))
        .when((kind == "reasoning_chain") & (F.coalesce(F.size(F.col("steps")), F.lit(0)) <= 0),
              F.lit("empty reasoning_steps"))
    )
    return out.withColumn("invalid_reason", reason)


def invalid_extractions(df: DataFrame) -> DataFrame:
    """Rejects table: typed extractions that fail a validator, with the reason."""
    t = typed_answer(df)
    return t.filter(F.col("invalid_reason").isNotNull())


def render_prompts(grid: DataFrame, question_col: str = "text", approach_col: str = "approach") -> DataFrame:
    """Prompt of each (sample, approach): the approach template with the question
    in place of ``{question}``, plus the approach's instruction suffix.

    Templates are a literal map of eight entries (no join); an approach with no
    template renders NULL (see ``unknown_approaches``).
    """
    tmap = F.create_map(*[x for k, v in TEMPLATES.items() for x in (F.lit(k), F.lit(v))])
    smap = F.create_map(*[x for k, v in SUFFIXES.items() for x in (F.lit(k), F.lit(v))])
    a = F.col(approach_col)
    suffix = F.coalesce(smap[F.lower(a)], F.lit(SUFFIXES["none"]))
    tmpl = tmap[a]
    return grid.withColumn("prompt", F.concat(F.replace(tmpl, F.lit("{question}"), F.col(question_col)), suffix))


def unknown_approaches(requested: DataFrame, approach_col: str = "approach") -> DataFrame:
    """Requested approach names that have no template (rejected before any work)."""
    spark = requested.sparkSession
    known = spark.createDataFrame([(k,) for k in TEMPLATES], "name string")
    return requested.join(F.broadcast(known), requested[approach_col] == known["name"], "left_anti")
