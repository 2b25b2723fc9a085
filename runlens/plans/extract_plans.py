"""Registered queries for answer extraction and scoring (2.10) and the UDF-free
parts of the run stage (prompts, unknown approaches)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.prompts import SUFFIXES, TEMPLATES
from ..functions.text import last_nonblank_line
from .registry import query

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


LAST_LINE = (
    "list_filter(list_transform(string_split({x}, chr(10)), lambda s: "
    + strip("s")
    + "), lambda s: s <> '')[-1]"
)


def last_line(x: str) -> str:
    return LAST_LINE.format(x=x)


def _sql_patterns() -> list[str]:
    return [p.replace("'", "''") for p in X.ANSWER_PATTERNS]


FIRST_MATCH = "coalesce(" + ", ".join(
    f"regexp_extract_all(raw_output, '(?im){p}', 1)[-1]" for p in _sql_patterns()
) + ")"

EXTRACT_CTE = f"""
WITH x AS (
  SELECT id, approach_name, expected_answer, raw_output,
         {strip(FIRST_MATCH)} AS m, {last_line('raw_output')} AS l
  FROM responses_v),
e AS (
  SELECT *,
    CASE WHEN m IS NOT NULL AND m <> '' THEN m WHEN l IS NOT NULL THEN l
         ELSE concat(substr({strip('raw_output')}, 1, 100), '...') END AS final_answer,
    CASE WHEN m IS NOT NULL AND m <> '' THEN 0.5 WHEN l IS NOT NULL THEN 0.2 ELSE 0.1 END AS confidence
  FROM x)
"""


@query("extract_answer", ["responses_v"], section="2.10", oracle=EXTRACT_CTE + """
SELECT id, final_answer, CAST(confidence AS DOUBLE) AS confidence, 'regex' AS extraction_method FROM e
""")
def _q(fx):
    return X.extract_answer(fx.responses_v).select("id", "final_answer", "confidence", "extraction_method")


@query("last_line_answer", ["responses_v"], section="2.10", oracle=f"""
SELECT id, coalesce({last_line('raw_output')}, substr(raw_output, 1, 100)) AS answer FROM responses_v
""")
def _q(fx):
    return fx.responses_v.select("id", X.last_line_answer("raw_output").alias("answer"))


def _clean_sql(x: str) -> str:
    """Sequential prefix loop written as nested CASEs over a stripped value."""
    v = strip(x)
    for p in X.ANSWER_PREFIXES:
        cond = f"starts_with(lower({v}), '{p}')"
        v = f"(CASE WHEN {cond} THEN {strip(f'substr({v}, {len(p) + 1})')} ELSE {v} END)"
    return v


CLEAN_SQL = f"""
WITH s AS (SELECT id, l, {_clean_sql('l')} AS v FROM (SELECT id, {last_line('raw_output')} AS l FROM responses_v)),
t AS (SELECT id, l, CASE WHEN len(string_split_regex(trim(v), '\\s+')) = 1 AND v <> '' AND ends_with(v, '.')
                         THEN substr(v, 1, length(v) - 1) ELSE v END AS v FROM s)
SELECT id, CASE WHEN l IS NULL OR l = '' THEN NULL ELSE {strip('v')} END AS clean FROM t
"""


@query("clean_answer", ["responses_v"], section="2.10", oracle=CLEAN_SQL)
def _q(fx):
    r = fx.responses_v.withColumn("l", last_nonblank_line("raw_output"))
    return r.select("id", X.clean_answer("l").alias("clean"))


@query("answer_or_text", ["responses_v"], section="2.10", oracle=f"""
SELECT id, CASE WHEN {strip(FIRST_MATCH)} <> '' THEN {FIRST_MATCH} ELSE raw_output END AS actual FROM responses_v
""")
def _q(fx):
    r = fx.responses_v
    return r.select("id", X.answer_or_text(X.first_pattern_last_match("raw_output"), F.col("raw_output")).alias("actual"))


@query("is_correct_strict", ["responses_v"], section="2.10", oracle=EXTRACT_CTE + f"""
SELECT id, final_answer, expected_answer,
  coalesce(final_answer IS NOT NULL AND final_answer <> '' AND expected_answer IS NOT NULL AND expected_answer <> ''
           AND lower({strip('final_answer')}) = lower({strip('expected_answer')}), FALSE) AS is_correct
FROM e
""")
def _q(fx):
    e = X.extract_answer(fx.responses_v)
    return e.select("id", "final_answer", "expected_answer",
                    X.is_correct_strict("final_answer", "expected_answer").alias("is_correct"))


@query("is_correct_fallback", ["responses_v"], section="2.10", oracle=f"""
WITH b AS (SELECT id, expected_answer, raw_output, {FIRST_MATCH} AS m FROM responses_v)
SELECT id, coalesce(lower({strip("coalesce(expected_answer, '')")}) <> ''
   AND lower({strip("coalesce(expected_answer, '')")}) =
       lower({strip(f"CASE WHEN {strip('m')} <> '' THEN m ELSE raw_output END")}), FALSE) AS is_correct
FROM b
""")
def _q(fx):
    r = fx.responses_v.withColumn("m", X.first_pattern_last_match("raw_output"))
    return r.select("id", X.is_correct_fallback("m", "raw_output", "expected_answer").alias("is_correct"))


def _multi_sql(x: str) -> str:
    pats = " OR ".join(f"regexp_matches({x}, '(?is){p}')" for p in [q.replace("'", "''") for q in X.MULTI_CALL_PATTERNS])
    steps = " + ".join(f"CAST(contains(lower({x}), '{s}') AS INT)" for s in X.STEP_INDICATORS)
    return f"coalesce(({pats}) OR ({steps}) >= 2, FALSE)"


@query("detect_multi_call", ["responses_v"], section="2.10", oracle=f"""
SELECT id, {_multi_sql('raw_output')} AS multi_call FROM responses_v
UNION ALL
SELECT 1000000000 + item_id, {_multi_sql('text')} FROM benchmark
""")
def _q(fx):
    a = fx.responses_v.select("id", X.detect_multi_call("raw_output").alias("multi_call"))
    b = fx.benchmark.select((F.lit(1000000000) + F.col("item_id")).alias("id"), X.detect_multi_call("text").alias("multi_call"))
    return a.unionByName(b)


def _typed_input(fx):
    """Structured extractions derived from the responses: the kind cycles over
    the six kinds, the values come from the response text."""
    r = X.extract_answer(fx.responses_v)
    kinds = F.array(*[F.lit(k) for k in X.KINDS[:6]])
    return r.select(
        "id",
        F.get(kinds, (F.col("id") % 6).cast("int")).alias("kind"),
        "final_answer",
        ((F.col("id") % 13).cast("double") / 10.0).alias("confidence"),
        F.col("final_answer").alias("option"),
        F.col("final_answer").alias("number"),
        F.when(F.col("id") % 4 == 0, F.lit("  ")).otherwise(F.col("approach_name")).alias("answer_type"),
        F.split("raw_output", "\n").alias("items"),
        F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.split("raw_output", "\n")).alias("steps"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 2 == 0).alias("yes_no"),
        F.when(F.col("id") % 3 > 0, F.lit("kg")).alias("unit"),
        F.when(F.col("id") % 4 > 0, F.split("raw_output", "\n")).alias("key_points"),
    )


TYPED_CTE = EXTRACT_CTE + """,
ti AS (
  SELECT id, list_value('multiple_choice', 'numerical', 'textual', 'yes_no', 'list', 'reasoning_chain')[id % 6 + 1] AS kind,
         final_answer, CAST(id % 13 AS DOUBLE) / 10.0 AS confidence, final_answer AS option, final_answer AS number,
         CASE WHEN id % 4 = 0 THEN '  ' ELSE approach_name END AS answer_type,
         string_split(raw_output, chr(10)) AS items,
         CASE WHEN id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(raw_output, chr(10)) END AS steps,
         CASE WHEN id % 7 > 0 THEN id % 2 = 0 END AS yes_no, CASE WHEN id % 3 > 0 THEN 'kg' END AS unit,
         CASE WHEN id % 4 > 0 THEN string_split(raw_output, chr(10)) END AS key_points
  FROM e),
tc AS (
  SELECT *, """ + strip("final_answer") + """ AS answer_clean,
    CASE WHEN kind = 'multiple_choice' THEN
      CASE WHEN regexp_full_match(upper(""" + strip("option") + """), '\\p{L}')
           THEN upper(""" + strip("option") + """) ELSE """ + strip("option") + """ END END AS option_clean,
    CASE WHEN kind = 'numerical' THEN TRY_CAST(""" + strip("number") + """ AS DOUBLE) END AS number_value,
    CASE WHEN kind = 'textual' THEN lower(""" + strip("answer_type") + """) END AS answer_type_clean,
    CASE WHEN kind = 'list' THEN list_filter(list_transform(items, lambda s: """ + strip("s") + """), lambda s: s <> '') END AS items_clean,
    CASE WHEN kind = 'list' THEN nullif(len(list_filter(list_transform(items, lambda s: """ + strip("s") + """), lambda s: s <> '')), 0) END AS item_count,
    CASE WHEN kind = 'reasoning_chain' THEN list_filter(list_transform(steps, lambda s: """ + strip("s") + """), lambda s: s <> '') END AS steps_clean,
    CASE WHEN kind = 'yes_no' THEN yes_no END AS yes_no_value, CASE WHEN kind = 'numerical' THEN unit END AS number_unit,
    CASE WHEN kind = 'textual' THEN coalesce(key_points, CAST([] AS VARCHAR[])) END AS points
  FROM ti),
tr AS (
  SELECT *, CASE
    WHEN coalesce(answer_clean, '') = '' THEN 'empty final_answer'
    WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'confidence out of range'
    WHEN kind = 'multiple_choice' AND coalesce(""" + strip("option") + """, '') = '' THEN 'empty selected_option'
    WHEN kind = 'numerical' AND number_value IS NULL THEN 'invalid numerical_value'
    WHEN kind = 'textual' AND coalesce(answer_type_clean, '') = '' THEN 'empty answer_type'
    WHEN kind = 'yes_no' AND yes_no IS NULL THEN 'missing yes_no_answer'
    WHEN kind = 'list' AND coalesce(len(items), 0) <= 0 THEN 'empty items'
    WHEN kind = 'reasoning_chain' AND coalesce(len(steps), 0) <= 0 THEN 'empty reasoning_steps'
  END AS invalid_reason FROM tc)
"""

TYPED_COLS = ("id, kind, answer_clean, option_clean, number_value, answer_type_clean, items_clean, item_count, "
              "steps_clean, yes_no_value, number_unit, points, invalid_reason")


@query("typed_answer", ["responses_v"], section="2.10", oracle=TYPED_CTE + f"SELECT {TYPED_COLS} FROM tr")
def _q(fx):
    return X.typed_answer(_typed_input(fx)).select(*[c.strip() for c in TYPED_COLS.split(",")])


@query("invalid_extractions", ["responses_v"], section="2.10",
       oracle=TYPED_CTE + "SELECT id, kind, invalid_reason FROM tr WHERE invalid_reason IS NOT NULL")
def _q(fx):
    return X.invalid_extractions(_typed_input(fx)).select("id", "kind", "invalid_reason")


@query("primary_extraction", [], section="2.10", oracle="""
WITH ex AS (SELECT conv_id AS response_id, turn AS position, text AS final_answer,
                   CAST(length(text) % 11 AS DOUBLE) / 10.0 AS confidence FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY confidence DESC, position) AS rk FROM ex)
SELECT r.response_id, r.position AS primary_position, r.final_answer AS primary_answer,
       r.confidence AS primary_confidence, a.combined_confidence, a.total_extractions
FROM r JOIN (SELECT response_id, avg(confidence) AS combined_confidence, count(*) AS total_extractions
             FROM ex GROUP BY response_id) a ON a.response_id = r.response_id
WHERE r.rk = 1
""")
def _q(fx):
    ex = fx.conversations.select(
        F.col("conv_id").alias("response_id"),
        F.col("turn").alias("position"),
        F.col("text").alias("final_answer"),
        ((F.length("text") % 11).cast("double") / 10.0).alias("confidence"),
    )
    return X.primary_extraction(ex)


@query("accept_extraction", ["responses_v"], section="2.10", oracle=EXTRACT_CTE + f"""
SELECT id,
  CASE WHEN CAST(id % 10 AS DOUBLE) / 10.0 >= 0.7 THEN l ELSE final_answer END AS final_answer,
  CASE WHEN CAST(id % 10 AS DOUBLE) / 10.0 >= 0.7 THEN CAST(id % 10 AS DOUBLE) / 10.0 ELSE confidence END AS confidence,
  CASE WHEN CAST(id % 10 AS DOUBLE) / 10.0 >= 0.7 THEN 'instructor' ELSE 'regex' END AS parsing_method
FROM e
""")
def _q(fx):
    e = X.extract_answer(fx.responses_v).withColumn("l", last_nonblank_line("raw_output"))
    s_conf = (F.col("id") % 10).cast("double") / 10.0
    a = X.accept_extraction(F.col("l"), s_conf, F.col("final_answer"), F.col("confidence"))
    return e.select("id", a.alias("a")).select("id", "a.*")


@query("estimate_cost", ["runs_v"], section="2.10", oracle="""
SELECT id, provider, total_tokens,
  round(CAST(total_tokens AS DOUBLE) / 1000.0 *
        CASE lower(provider) WHEN 'anthropic' THEN 0.008 WHEN 'cohere' THEN 0.002 WHEN 'openrouter' THEN 0.0002
             ELSE 0.001 END, 6) AS cost
FROM runs_v
""")
def _q(fx):
    return fx.runs_v.select("id", "provider", "total_tokens", X.estimate_cost("total_tokens", "provider").alias("cost"))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TEMPLATE_VALUES = ", ".join(
    f"({_sql_str(k)}, {_sql_str(v)}, {_sql_str(SUFFIXES.get(k.lower(), SUFFIXES['none']))})" for k, v in TEMPLATES.items()
)


@query("render_prompts", [], section="2.10", oracle=f"""
WITH t(approach, template, suffix) AS (VALUES {_TEMPLATE_VALUES})
SELECT b.item_id, t.approach, concat(replace(t.template, '{{question}}', b.text), t.suffix) AS prompt
FROM benchmark b CROSS JOIN t
""")
def _q(fx):
    from ..operators.runs import sample_approach_grid

    grid = sample_approach_grid(fx.benchmark, list(TEMPLATES))
    return X.render_prompts(grid).select("item_id", "approach", "prompt")


@query("unknown_approaches", ["runs_v"], section="2.15", oracle=f"""
WITH req AS (SELECT DISTINCT approach_name AS approach FROM runs_v UNION SELECT DISTINCT event_type FROM events)
SELECT approach FROM req WHERE approach NOT IN ({", ".join(_sql_str(k) for k in TEMPLATES)})
""")
def _q(fx):
    req = fx.runs_v.select(F.col("approach_name").alias("approach")).union(
        fx.events.select(F.col("event_type").alias("approach"))).distinct()
    return X.unknown_approaches(req)


@query("rollup_steps", [], section="2.4", oracle="""
SELECT conv_id AS run_id, CAST(sum(length(text) // 4) AS BIGINT) AS prompt_tokens,
       CAST(sum(length(text) // 3) AS BIGINT) AS completion_tokens,
       CAST(sum(length(text) // 4 + length(text) // 3) AS BIGINT) AS total_tokens,
       sum(CAST(length(text) AS DOUBLE) / 100.0) AS generation_time, count(*) AS step_count,
       count(*) > 1 AS refined, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def _q(fx):
    from ..operators.runs import rollup_steps

    steps = fx.conversations.select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("step"),
        "text",
        F.floor(F.length("text") / 4).cast("long").alias("prompt_tokens"),
        F.floor(F.length("text") / 3).cast("long").alias("completion_tokens"),
        (F.floor(F.length("text") / 4) + F.floor(F.length("text") / 3)).cast("long").alias("total_tokens"),
        (F.length("text").cast("double") / 100.0).alias("generation_time"),
    )
    return rollup_steps(steps)



def demo_model(prompt: str) -> str:
    """A deterministic stand-in for a model call: fails on some prompts."""
    if len(prompt) % 7 == 0:
        raise RuntimeError("model unavailable")
    return str(len(prompt) % 5)


@query("score_table", [], section="2.15", oracle=f"""
WITH t(approach, template, suffix) AS (VALUES {_TEMPLATE_VALUES}),
p AS (SELECT b.item_id, t.approach, concat(replace(t.template, '{{question}}', b.text), t.suffix) AS prompt
      FROM benchmark b CROSS JOIN t)
SELECT item_id, approach,
       CASE WHEN length(prompt) % 7 = 0 THEN NULL ELSE CAST(length(prompt) % 5 AS VARCHAR) END AS answer,
       CASE WHEN length(prompt) % 7 = 0 THEN 'RuntimeError: model unavailable' END AS error,
       TRUE AS timed
FROM p
""")
def _q(fx):
    from ..operators.runs import sample_approach_grid
    from ..operators.score import score_table

    grid = X.render_prompts(sample_approach_grid(fx.benchmark, list(TEMPLATES))).select("item_id", "approach", "prompt")
    scored = score_table(grid, demo_model, keep=["item_id", "approach"])
    return scored.select("item_id", "approach", "answer", "error", (F.col("elapsed") >= 0).alias("timed"))
