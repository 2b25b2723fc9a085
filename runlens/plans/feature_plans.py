"""Registered queries for the text features (2.9).

The Spark side calls the column functions of ``runlens.functions.features``;
the oracle side is a DuckDB expression written per feature shape from the same
fixed pattern tables (RE2 has no ``d``/``U`` flags; the fixture text is ASCII,
where those flags change nothing).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FT
from .registry import query

TEXTS_CTE = """
WITH ft AS (
  SELECT id, raw_output AS text FROM responses_v
  UNION ALL SELECT 1000000000 + item_id, text FROM benchmark)
"""


def _texts(fx):
    a = fx.responses_v.select("id", F.col("raw_output").alias("text"))
    b = fx.benchmark.select((F.lit(1000000000) + F.col("item_id")).alias("id"), "text")
    return a.unionByName(b)


# ----------------------------------------------------------------------------- SQL helpers

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _re(p: str, flags: str = "") -> str:
    p = p.replace("\\'", "'").replace("'", "''")
    return f"'(?{flags}){p}'" if flags else f"'{p}'"


def s_count(t: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({t}, {_re(p, flags)}))" for p in patterns) + ")"


def s_any(t: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, {_re(p, flags)})" for p in patterns) + ")"


def s_any_lower(t: str, patterns: list[str]) -> str:
    return s_any(f"lower({t})", patterns)


def s_kinds(t: str, patterns: list[str], flags: str = "i") -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({t}, {_re(p, flags)}) AS INT)" for p in patterns) + ")"


def s_words(t: str) -> str:
    st = STRIP.format(x=t)
    return f"(CASE WHEN {st} = '' THEN 0 ELSE len(string_split_regex({st}, '\\s+')) END)"


def s_quality(hits: str, t: str, key: str, bonus: str = "0.0") -> str:
    w, length = FT.QUALITY[key]
    return (f"round(least(CAST({hits} AS DOUBLE) * CAST({w} AS DOUBLE) * least({s_words(t)} / CAST({length} AS DOUBLE), 1.0)"
            f" + {bonus}, 1.0), 2)")


def s_substr_count(t: str, s: str) -> str:
    s2 = s.replace("'", "''")
    return f"((length({t}) - length(replace({t}, '{s2}', ''))) // {len(s)})"


def s_contains_words(t: str, words: list[str]) -> str:
    items = ", ".join(f"CASE WHEN contains(lower({t}), '{w}') THEN '{w}' END" for w in words)
    return f"list_sort(list_filter(list_value({items}), lambda x: x IS NOT NULL))"


T = "text"
REF_STEP_REGEXES = [r"\b" + s + r"\b.*(?:response|answer|attempt)" for s in FT.REF_STEP_SECTIONS]

SQL = {
    "feat_base_steps": "(" + " + ".join(s_substr_count(T, s) for s in FT.BASE_STEP_SUBSTRINGS) + ")",
    "feat_cot_steps": f"greatest({s_count(T, FT.COT_STEP_PATTERNS, 'i')}, 1)",
    "feat_cot_quality": s_quality(s_count(T, FT.COT_QUALITY_PATTERNS, "i"), T, "cot"),
    "feat_cot_numbered": f"{s_count(T, [FT.COT_NUMBERED])} >= 2",
    "feat_cot_connectors": "(" + " OR ".join(f"contains(lower({T}), '{c}')" for c in FT.COT_CONNECTORS) + ")",
    "feat_pot_code_blocks": s_count(T, FT.POT_CODE_PATTERNS, "ims"),
    "feat_pot_quality": s_quality(s_count(T, FT.POT_QUALITY_PATTERNS, "i"), T, "pot"),
    "feat_pot_steps": f"greatest({s_count(T, FT.POT_STEP_PATTERNS, 'i')} + {s_count(T, [FT.POT_ASSIGNMENT], 'm')}, 1)",
    "feat_pot_variables": s_any(T, FT.POT_VARIABLE_PATTERNS, "i"),
    "feat_pot_functions": s_any(T, FT.POT_FUNCTION_PATTERNS, "i"),
    "feat_pot_control": s_any(T, FT.POT_CONTROL_PATTERNS, "i"),
    "feat_rap_stages": f"greatest({s_kinds(T, FT.RAP_STAGE_PATTERNS)}, least({s_count(T, [FT.RAP_NUMBERED])}, 6))",
    "feat_rap_quality": s_quality(s_count(T, FT.RAP_QUALITY_PATTERNS, "i"), T, "rap"),
    "feat_rap_goal": s_any_lower(T, FT.RAP_GOAL_PATTERNS),
    "feat_rap_actions": s_any_lower(T, FT.RAP_ACTION_PATTERNS),
    "feat_rap_risk": s_any_lower(T, FT.RAP_RISK_PATTERNS),
    "feat_rap_execution": s_any_lower(T, FT.RAP_EXECUTION_PATTERNS),
    "feat_tot_branches": (f"greatest({s_count(T, FT.TOT_BRANCH_PATTERNS, 'i')}, {s_count(T, [FT.TOT_LETTERED])}, "
                          f"{s_count(T, [FT.TOT_NUMBERED])}, 1)"),
    "feat_tot_depth": f"least({s_count(T, FT.TOT_DEPTH_PATTERNS, 'i')}, 4) + 1",
    "feat_tot_evaluations": s_count(T, FT.TOT_EVALUATION_PATTERNS, "i"),
    "feat_tot_quality": s_quality(s_count(T, FT.TOT_QUALITY_PATTERNS, "i"), T, "tot"),
    "feat_tot_decomposition": s_any_lower(T, FT.TOT_DECOMPOSITION_PATTERNS),
    "feat_tot_branches_flag": s_any_lower(T, FT.TOT_BRANCH_FLAG_PATTERNS),
    "feat_tot_exploration": s_any_lower(T, FT.TOT_EXPLORATION_PATTERNS),
    "feat_tot_evaluation": s_any_lower(T, FT.TOT_PATH_EVALUATION_PATTERNS),
    "feat_tot_selection": s_any_lower(T, FT.TOT_SELECTION_PATTERNS),
    "feat_tot_synthesis": s_any_lower(T, FT.TOT_SYNTHESIS_PATTERNS),
    "feat_sot_sections": ("greatest(len(list_filter(string_split(text, chr(10)), lambda l: "
                          + s_any("l", FT.SOT_SECTION_PATTERNS, "i") + ")), 1)"),
    "feat_sot_levels": (
        "greatest(len(list_distinct(flatten(list_transform(string_split(text, chr(10)), lambda l: list_value("
        "CASE WHEN regexp_replace(l, '^\\s+', '') <> '' AND length(l) - length(regexp_replace(l, '^\\s+', '')) > 0 "
        "THEN (length(l) - length(regexp_replace(l, '^\\s+', ''))) // 2 END, "
        "CASE WHEN regexp_replace(l, '^\\s+', '') <> '' AND (regexp_matches(regexp_replace(l, '^\\s+', ''), "
        + _re(FT.SOT_NUMBERED_HIERARCHY) + ") OR regexp_matches(regexp_replace(l, '^\\s+', ''), "
        + _re(FT.SOT_LETTERED) + ")) THEN 2 END))))), 1)"
    ),
    "feat_sot_quality": s_quality(s_count(T, FT.SOT_QUALITY_PATTERNS, "i"), T, "sot"),
    "feat_sot_outline": s_any_lower(T, FT.SOT_OUTLINE_PATTERNS),
    "feat_sot_expansion": s_any_lower(T, FT.SOT_EXPANSION_PATTERNS),
    "feat_sot_progressive": s_any_lower(T, FT.SOT_PROGRESSIVE_PATTERNS),
    "feat_sot_integration": s_any_lower(T, FT.SOT_INTEGRATION_PATTERNS),
    "feat_sot_refinement": s_any_lower(T, FT.SOT_REFINEMENT_PATTERNS),
    "feat_cov_questions": f"least({s_count(T, FT.COV_QUESTION_PATTERNS, 'i')}, 10)",
    "feat_cov_quality": s_quality(s_count(T, FT.COV_QUALITY_PATTERNS, "i"), T, "cov"),
    "feat_cov_initial": s_any_lower(T, FT.COV_INITIAL_PATTERNS),
    "feat_cov_questions_flag": s_any_lower(T, FT.COV_QUESTION_FLAG_PATTERNS),
    "feat_cov_assessment": s_any_lower(T, FT.COV_ASSESSMENT_PATTERNS),
    "feat_cov_refined": s_any_lower(T, FT.COV_REFINED_PATTERNS),
    "feat_ref_quality": s_quality(
        s_count(T, FT.REF_QUALITY_PATTERNS, "i"), T, "ref",
        f"CASE WHEN {s_kinds(T, FT.REF_STRUCTURE_MARKERS)} >= 2 THEN 0.2 ELSE 0.0 END"),
    "feat_ref_steps": (f"greatest({s_kinds(T, REF_STEP_REGEXES)}"
                       f" + {s_count(T, FT.REF_ACTION_PATTERNS, 'i')} // 2, 2)"),
    "feat_ref_sections": ("list_filter(list_value(" + ", ".join(
        f"CASE WHEN regexp_matches(text, {_re(p, 'i')}) THEN '{n}' END" for n, p in FT.REF_SECTIONS)
        + "), lambda x: x IS NOT NULL)"),
    "feat_ref_issues": s_contains_words(T, FT.REF_ISSUE_WORDS),
    "feat_ref_improvements": s_contains_words(T, FT.REF_IMPROVEMENT_WORDS),
    "feat_needs_refinement": (
        "coalesce(CAST((" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in FT.REFINEMENT_ISSUE_WORDS)
        + f") AS DOUBLE) / greatest({s_words(T)}, 1) > (1.0::DOUBLE - 0.7::DOUBLE), FALSE)"),
}


def _register(name: str, fn, sql: str):
    @query(name, ["responses_v"], section="2.9", oracle=TEXTS_CTE + f"SELECT id, {sql} AS {name} FROM ft")
    def _q(fx):
        return _texts(fx).select("id", fn(F.col("text")).alias(name))


for _name, _fn in FT.ALL_FEATURES.items():
    if _name in SQL:
        _register(_name, _fn, SQL[_name])


@query("feat_ref_structure", ["responses_v"], section="2.9", oracle=TEXTS_CTE + f"""
SELECT id, regexp_matches(text, {_re(FT.REF_INITIAL, 'i')}) AS has_initial,
       regexp_matches(text, {_re(FT.REF_REFLECTION, 'i')}) AS has_reflection,
       regexp_matches(text, {_re(FT.REF_REFINED, 'i')}) AS has_refined,
       {s_count(T, FT.REF_IMPROVEMENT_PATTERNS, 'i')} AS improvement_count,
       {s_count(T, FT.REF_CORRECTION_PATTERNS, 'i')} AS correction_count
FROM ft
""")
def _q(fx):
    return _texts(fx).select("id", FT.feat_ref_structure(F.col("text")).alias("s")).select("id", "s.*")


@query("trace_steps", ["responses_v"], section="2.9", oracle=TEXTS_CTE + """
, src AS (
  SELECT id, text, 'ChainOfThought' AS approach,
         CASE WHEN id % 3 = 1 THEN """ + s_count(T, FT.COT_STEP_PATTERNS, "i") + """ END AS reasoning_steps,
         CASE WHEN id % 7 = 0 THEN MAP {'step_count': '3', 'step_1': 'plan', 'step2': split_part(text, chr(10), 1)} END AS ms
  FROM ft),
multi AS (
  SELECT id, s AS step,
         CASE WHEN map_contains(ms, concat('step_', s)) THEN ms[concat('step_', s)]
              ELSE coalesce(ms[concat('step', s)], '') END AS content
  FROM src, range(1, CAST(ms['step_count'] AS INT) + 1) r(s)
  WHERE ms IS NOT NULL AND (map_contains(ms, concat('step_', s)) OR map_contains(ms, concat('step', s)))),
has_multi AS (SELECT DISTINCT id FROM multi),
generic AS (
  SELECT src.id, s AS step, concat('Reasoning step ', CAST(s AS VARCHAR)) AS content
  FROM src, range(1, CAST(coalesce(reasoning_steps, 1) AS INT) + 1) r(s)
  WHERE coalesce(reasoning_steps, 1) > 1 AND src.id NOT IN (SELECT id FROM has_multi)),
single AS (
  SELECT id, 1 AS step, CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '...') ELSE text END AS content
  FROM src WHERE coalesce(reasoning_steps, 1) <= 1 AND id NOT IN (SELECT id FROM has_multi)),
allr AS (SELECT * FROM multi UNION ALL SELECT * FROM generic UNION ALL SELECT * FROM single)
SELECT a.id, s.text, s.approach, s.reasoning_steps, CAST(a.step AS INT) AS step, 'reasoning' AS type, a.content
FROM allr a JOIN src s ON a.id = s.id
""")
def _q(fx):
    t = _texts(fx)
    src = t.select(
        "id", "text", F.lit("ChainOfThought").alias("approach"),
        F.when(F.col("id") % 3 == 1, FT.count_all(F.col("text"), FT.COT_STEP_PATTERNS, "i")).cast("long").alias(
            "reasoning_steps"),
        F.when(F.col("id") % 7 == 0, F.create_map(
            F.lit("step_count"), F.lit("3"), F.lit("step_1"), F.lit("plan"),
            F.lit("step2"), F.split(F.col("text"), "\n").getItem(0))).alias("multi_step"),
    )
    return FT.trace_steps(src)
