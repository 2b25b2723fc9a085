"""Text features of responses (2.9) as built-in column expressions.

Every feature is a column function of the response text, built from pattern
tables: a *count* is a sum of ``regexp_count``; a *flag* is an OR of ``rlike``;
a *quality* score is ``round(least(hits * w * least(words / L, 1), 1), 2)``.
``features_for(df, approach)`` adds all features of one approach in a single
projection, so one scan computes them all; nothing runs Python per row.

Patterns are compiled by ``text.py_regex`` so Java matches what Python's
``re`` matches (Unicode classes and word edges, ``\\n`` as the only line end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import PY_WS, count_substr, py_regex, word_count

# =============================================================================
# fixed values: indicator patterns of the eight approaches, as published
# =============================================================================

BASE_STEP_SUBSTRINGS = [
    "Step ", "step ", "First,", "Second,", "Third,", "Fourth,", "Fifth,",
    "1.", "2.", "3.", "4.", "5.", "6.", "7.", "8.", "9.", "10.",
    "Therefore,", "Thus,", "Hence,", "Finally,",
]

# --- chain of thought --------------------------------------------------------
COT_STEP_PATTERNS = [
    r"\b(?:Step|step)\s+\d+",
    r"\d+\.\s+",
    r"\b(?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth)",
    r"\b(?:Initially|Then|Next|After|Finally|Therefore|Thus|Hence)\b",
    r"\b(?:Let me|Let\'s|I need to|I will|I can)\b",
]
COT_QUALITY_PATTERNS = [
    r"\b(?:because|since|therefore|thus|hence|so|consequently)\b",
    r"\b(?:analyzing|considering|examining|evaluating)\b",
    r"\b(?:this means|this shows|this indicates|this suggests)\b",
]
COT_NUMBERED = r"\d+\.\s+"
COT_CONNECTORS = [
    "therefore", "thus", "hence", "because", "since", "consequently",
    "as a result", "this means", "this shows",
]

# --- program of thought ------------------------------------------------------
POT_CODE_PATTERNS = [
    r"```[\w]*\n.*?\n```",
    r"`[^`\n]+`",
    r"^\s*\w+\s*=",
    r"def\s+\w+\(",
    r"for\s+\w+\s+in\s+",
    r"if\s+.*:",
]
POT_QUALITY_PATTERNS = [
    r"\b(?:function|def|class|import|from)\b",
    r"\b(?:algorithm|iterate|calculate|compute|process)\b",
    r"\b(?:variable|array|list|loop|condition|function)\b",
    r"\b(?:this code|the function|this calculates|this returns)\b",
]
POT_STEP_PATTERNS = [
    r"\b(?:Step|step)\s+\d+",
    r"\d+\.\s+",
    r"```[\w]*\n",
    r"\b(?:First|Then|Next|Finally)\b",
    r"\b(?:Let\'s|Now|We can|To do this)\b",
]
POT_ASSIGNMENT = r"^\s*\w+\s*="
POT_VARIABLE_PATTERNS = [r"\b\w+\s*=\s*", r"\b(?:variable|var)\b"]
POT_FUNCTION_PATTERNS = [r"\bdef\s+\w+\(", r"\w+\(", r"\b(?:function|method)\b"]
POT_CONTROL_PATTERNS = [r"\b(?:if|else|elif|for|while|loop)\b", r"\b(?:iterate|condition|check)\b"]

# --- reasoning as planning ---------------------------------------------------
RAP_STAGE_PATTERNS = [
    r"\b(?:Goal|goal)\s+(?:Analysis|analysis|Definition|definition)",
    r"\b(?:Planning|planning)\s+(?:Phase|phase|Stage|stage)",
    r"\b(?:Action|action)\s+(?:Sequence|sequence|Plan|plan|Steps|steps)",
    r"\b(?:Risk|risk)\s+(?:Assessment|assessment|Analysis|analysis)",
    r"\b(?:Execution|execution)\s+(?:Strategy|strategy|Plan|plan)",
    r"\b(?:Milestone|milestone|Sub-goal|sub-goal|Objective|objective)",
    r"\b(?:Implementation|implementation|Deploy|deploy)",
]
RAP_NUMBERED = r"\d+\.\s+"
RAP_MAX_NUMBERED = 6
RAP_QUALITY_PATTERNS = [
    r"\b(?:strategy|strategic|plan|planning|goal|objective|milestone|roadmap)\b",
    r"\b(?:implement|execute|deploy|achieve|accomplish|deliver)\b",
    r"\b(?:depends on|requires|prerequisite|before|after|once|when)\b",
    r"\b(?:risk|challenge|obstacle|problem|difficulty|consider|potential)\b",
]
RAP_GOAL_PATTERNS = [
    r"\b(?:goal|objective|aim|target|purpose)\b",
    r"\b(?:what.*achieve|what.*accomplish|what.*need)\b",
    r"\b(?:define|identify|clarify).*(?:goal|objective)\b",
]
RAP_ACTION_PATTERNS = [
    r"\b(?:step|action|task|activity)\s+\d+",
    r"\b(?:first|second|third|next|then|finally)\b",
    r"\b(?:sequence|order|priority|timeline)\b",
]
RAP_RISK_PATTERNS = [
    r"\b(?:risk|challenge|obstacle|problem|difficulty)\b",
    r"\b(?:potential.*issue|might.*fail|could.*go wrong)\b",
    r"\b(?:mitigation|contingency|backup|alternative)\b",
]
RAP_EXECUTION_PATTERNS = [
    r"\b(?:implement|execute|deploy|carry out|put into action)\b",
    r"\b(?:strategy|approach|method|technique)\b",
    r"\b(?:how to|way to|process of|steps to)\b",
]

# --- tree of thought ---------------------------------------------------------
TOT_BRANCH_PATTERNS = [
    r"(?:approach|path|branch|route|method|strategy)\s+\d+",
    r"(?:alternative|option|possibility|way)\s+\d+",
    r"(?:first|second|third|fourth|fifth|sixth)\s+(?:approach|path|method)",
    r"(?:another|different|alternative)\s+(?:approach|path|way)",
]
TOT_LETTERED = r"(?:^|\n)\s*[A-D]\.\s+"
TOT_NUMBERED = r"(?:^|\n)\s*\d+\.\s+"
TOT_DEPTH_PATTERNS = [
    r"(?:detailed|in-depth|thorough|comprehensive)\s+(?:exploration|analysis)",
    r"(?:exploring|examining|investigating).*(?:detail|depth)",
    r"(?:pros and cons|advantages and disadvantages|strengths and weaknesses)",
    r"(?:step by step|systematically|methodically)",
]
TOT_EVALUATION_PATTERNS = [
    r"(?:evaluate|evaluation|assess|assessment|compare|comparison)",
    r"(?:pros|cons|advantages|disadvantages|benefits|drawbacks)",
    r"(?:strengths|weaknesses|better|worse|superior|inferior)",
    r"(?:most promising|best|optimal|preferred|chosen)",
]
TOT_QUALITY_PATTERNS = [
    r"\b(?:branch|branches|path|paths|alternative|alternatives|option|options)\b",
    r"\b(?:explore|exploration|investigate|examination|analysis|detailed)\b",
    r"\b(?:evaluate|assessment|compare|pros|cons|strengths|weaknesses)\b",
    r"\b(?:select|choose|best|optimal|preferred|promising|synthesis)\b",
]
TOT_DECOMPOSITION_PATTERNS = [
    r"\b(?:decomposition|decompose|break down|components|elements)\b",
    r"\b(?:key aspects|main parts|core issues|fundamental elements)\b",
    r"\b(?:divide|separate|analyze|examine).*(?:problem|question|issue)\b",
]
TOT_BRANCH_FLAG_PATTERNS = [
    r"\b(?:branch|branches|path|paths|approach|approaches)\b",
    r"\b(?:alternative|alternatives|option|options|method|methods)\b",
    r"(?:different|multiple|various).*(?:way|approach|path|method)",
]
TOT_EXPLORATION_PATTERNS = [
    r"\b(?:explore|exploration|investigate|examination|develop|developing)\b",
    r"\b(?:in detail|thoroughly|comprehensively|systematically)\b",
    r"(?:each|every).*(?:branch|path|approach|alternative)",
]
TOT_PATH_EVALUATION_PATTERNS = [
    r"\b(?:evaluate|evaluation|assess|assessment|compare|comparison)\b",
    r"\b(?:pros|cons|advantages|disadvantages|strengths|weaknesses)\b",
    r"\b(?:better|worse|superior|inferior|effective|ineffective)\b",
]
TOT_SELECTION_PATTERNS = [
    r"\b(?:select|selection|choose|chosen|pick|preferred)\b",
    r"\b(?:best|optimal|most promising|ideal|recommended)\b",
    r"\b(?:decision|decide|conclude|final choice)\b",
]
TOT_SYNTHESIS_PATTERNS = [
    r"\b(?:synthesis|synthesize|combine|integration|integrate)\b",
    r"\b(?:bringing together|putting together|merge|unify)\b",
    r"\b(?:insights|learnings|best elements|optimal solution)\b",
]

# --- skeleton of thought -----------------------------------------------------
SOT_SECTION_PATTERNS = [
    r"^\s*\d+\.\s+",
    r"^\s*[A-Z]\.\s+",
    r"^\s*[ivx]+\.\s+",
    r"^\s*[-*+]\s+",
    r"(?:Section|section|Part|part)\s+\d+",
]
SOT_NUMBERED_HIERARCHY = r"(\d+)\.(\d+)"
SOT_LETTERED = r"^\s*[a-z]\)"
SOT_QUALITY_PATTERNS = [
    r"\b(?:outline|structure|framework|hierarchy|organization|systematic)\b",
    r"\b(?:expand|expansion|detail|elaborate|develop|build)\b",
    r"\b(?:integrate|integration|connect|combine|synthesis|cohesive)\b",
    r"\b(?:section|subsection|component|element|level|tier)\b",
]
SOT_OUTLINE_PATTERNS = [
    r"\b(?:skeleton|outline|framework|structure)\b",
    r"\b(?:high-level|overview|main points)\b",
    r"\d+\.\s+\w+.*\n.*\d+\.\s+\w+",
]
SOT_EXPANSION_PATTERNS = [
    r"\b(?:expand|expansion|detail|elaborate|develop)\b",
    r"\b(?:section|part).*(?:expanded|detailed|elaborated)\b",
    r"(?:going into|diving into|exploring|examining).*(?:detail|depth)",
]
SOT_PROGRESSIVE_PATTERNS = [
    r"\b(?:progressive|progressively|build|building|develop|developing)\b",
    r"\b(?:step by step|systematically|methodically)\b",
    r"\b(?:building upon|based on|following from)\b",
]
SOT_INTEGRATION_PATTERNS = [
    r"\b(?:integrate|integration|connect|combine|synthesis)\b",
    r"\b(?:bringing together|putting together|cohesive|unified)\b",
    r"\b(?:overall|holistic|comprehensive|complete picture)\b",
]
SOT_REFINEMENT_PATTERNS = [
    r"\b(?:refine|refinement|polish|improve|enhance)\b",
    r"\b(?:final|finalize|conclude|conclusion)\b",
    r"\b(?:comprehensive|complete|thorough)\b",
]

# --- chain of verification ---------------------------------------------------
COV_QUESTION_PATTERNS = [
    r"\?\s*(?:\n|$)",
    r"(?:Question|question)\s+\d+",
    r"(?:Verify|verify|Check|check).*\?",
    r"(?:Is|Are|Does|Did|Can|Will|Would|Should).*\?",
]
COV_MAX_QUESTIONS = 10
COV_QUALITY_PATTERNS = [
    r"\b(?:verify|verification|check|validate|confirm|assess|evaluate)\b",
    r"\b(?:accurate|accuracy|correct|incorrect|reliable|valid|invalid)\b",
    r"\b(?:question|doubt|assumption|evidence|support|justify)\b",
    r"\b(?:refine|refined|improve|improved|better|correction|revise)\b",
]
COV_INITIAL_PATTERNS = [
    r"\b(?:initial|initial response|first answer|initial answer)\b",
    r"\b(?:initially|at first|to begin with)\b",
]
# the third pattern has capitals but runs on lowered text, so it never matches
COV_QUESTION_FLAG_PATTERNS = [
    r"\b(?:verification questions?|verify|check)\b.*\?",
    r"\b(?:question|questions?)\b.*(?:verify|check|validate)",
    r"(?:Is|Are|Does|Did|Can|Will|Would|Should).*(?:accurate|correct|valid)\?",
]
COV_ASSESSMENT_PATTERNS = [
    r"\b(?:accuracy|accurate|assessment|evaluate|evaluation)\b",
    r"\b(?:reliable|reliability|valid|validity|confidence)\b",
    r"\b(?:correct|incorrect|right|wrong|error)\b",
]
COV_REFINED_PATTERNS = [
    r"\b(?:refined|final|final answer|conclusion)\b",
    r"\b(?:improved|better|corrected|revised)\b",
    r"\b(?:after verification|based on verification)\b",
]

# --- reflection --------------------------------------------------------------
REF_INITIAL = r"\*\*Initial Response\*\*|Initial Response:|First attempt:|My initial answer"
REF_REFLECTION = r"\*\*Reflection\*\*|Reflection:|Let me reflect|Upon reflection"
REF_REFINED = r"\*\*Refined Response\*\*|Refined Response:|Improved answer:|Better response"
REF_IMPROVEMENT_PATTERNS = [
    r"\b(?:improve|better|enhance|refine|correct)\b",
    r"\b(?:mistake|error|oversight|miss)\b",
    r"\b(?:should consider|need to|ought to)\b",
]
REF_CORRECTION_PATTERNS = [
    r"\b(?:actually|however|but|wait|no)\b",
    r"\b(?:let me reconsider|on second thought|I realize)\b",
    r"\b(?:correction|revise|adjust)\b",
]
REF_QUALITY_PATTERNS = [
    r"\b(?:my response|my answer|I said|I stated|I assumed)\b",
    r"\b(?:analyze|examine|evaluate|consider|assess)\b",
    r"\b(?:improve|enhance|better|refine|correct)\b",
    r"\b(?:thinking|reasoning|logic|approach|method)\b",
]
REF_STRUCTURE_MARKERS = [
    r"\*\*(?:Initial|Reflection|Refined)",
    r"(?:Initial|Reflection|Refined)\s*:",
    r"Step\s+\d+",
]
REF_STRUCTURE_BONUS = 0.2
REF_STEP_SECTIONS = ["initial", "reflection", "refined", "improved", "better"]
REF_ACTION_PATTERNS = [
    r"\b(?:reflect|consider|reconsider|evaluate|examine)\b",
    r"\b(?:improve|enhance|refine|correct|adjust)\b",
    r"\b(?:realize|notice|see|understand)\b",
]
REF_SECTIONS = [
    ("initial_response", r"\*\*Initial Response\*\*|Initial Response:"),
    ("reflection", r"\*\*Reflection\*\*|Reflection:"),
    ("refined_response", r"\*\*Refined Response\*\*|Refined Response:"),
    ("analysis", r"\*\*Analysis\*\*|Analysis:"),
    ("improvement", r"\*\*Improvement\*\*|Improvement:"),
]
REF_ISSUE_WORDS = [
    "error", "mistake", "oversight", "missing", "incomplete", "wrong",
    "incorrect", "overlook", "forget", "assume",
]
REF_IMPROVEMENT_WORDS = [
    "better", "improve", "enhance", "refine", "clarify", "add", "include",
    "consider", "address", "correct",
]
REFINEMENT_ISSUE_WORDS = [
    "error", "mistake", "wrong", "incorrect", "incomplete", "missing", "overlook",
    "problem", "issue", "flaw", "should", "could", "might", "better", "improve",
]
REFLECTION_THRESHOLD = 0.7

# --- quality score parameters: (weight per hit, words for full length) ------
QUALITY = {
    "cot": (0.1, 100),
    "pot": (0.08, 150),
    "rap": (0.08, 150),
    "tot": (0.06, 200),
    "sot": (0.08, 150),
    "cov": (0.06, 200),
    "ref": (0.05, 200),
}

# =============================================================================
# building blocks
# =============================================================================


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(pattern: str, flags: str = "") -> str:
    """Java regex with Python's ``re`` semantics (classes, word edges, line ends)."""
    return py_regex(pattern, flags)


def count_all(text, patterns: list[str], flags: str = "") -> Column:
    """Sum of non-overlapping match counts (``len(re.findall)``) of each pattern."""
    t = _c(text)
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(t, F.lit(rx(p, flags)))
    return total.cast("long")


def any_match(text, patterns: list[str], flags: str = "") -> Column:
    """True when any pattern is found (``re.search``)."""
    t = _c(text)
    out = F.lit(False)
    for p in patterns:
        out = out | t.rlike(rx(p, flags))
    return F.coalesce(out, F.lit(False))


def any_match_lower(text, patterns: list[str]) -> Column:
    """``any(re.search(p, text.lower()))``: patterns run case-sensitively on
    the lower-cased text."""
    return any_match(F.lower(_c(text)), patterns, "")


def kinds_found(text, patterns: list[str], flags: str = "i") -> Column:
    """Number of patterns with at least one match."""
    t = _c(text)
    return sum((t.rlike(rx(p, flags)).cast("int") for p in patterns), F.lit(0)).cast("long")


def quality(hits: Column, text, key: str, bonus: Column | None = None) -> Column:
    """round(least(hits * w * least(words / L, 1) [+ bonus], 1), 2)."""
    w, length = QUALITY[key]
    words = word_count(_c(text)).cast("double")
    score = (hits.cast("double") * F.lit(w)) * F.least(words / F.lit(float(length)), F.lit(1.0))
    if bonus is not None:
        score = score + bonus
    return F.round(F.least(score, F.lit(1.0)), 2)


def contains_words(text, words: list[str], sort: bool = True) -> Column:
    """Array of the words contained in the lower-cased text (sorted)."""
    low = F.lower(_c(text))
    arr = F.filter(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    return F.array_sort(arr) if sort else arr


# =============================================================================
# features
# =============================================================================


def feat_base_steps(text) -> Column:
    t = _c(text)
    total = F.lit(0)
    for s in BASE_STEP_SUBSTRINGS:
        total = total + count_substr(t, s)
    return total.cast("long")


def feat_cot_steps(text) -> Column:
    return F.greatest(count_all(text, COT_STEP_PATTERNS, "i"), F.lit(1))


def feat_cot_quality(text) -> Column:
    return quality(count_all(text, COT_QUALITY_PATTERNS, "i"), text, "cot")


def feat_cot_numbered(text) -> Column:
    return count_all(text, [COT_NUMBERED]) >= 2


def feat_cot_connectors(text) -> Column:
    low = F.lower(_c(text))
    out = F.lit(False)
    for s in COT_CONNECTORS:
        out = out | low.contains(s)
    return F.coalesce(out, F.lit(False))


def feat_pot_code_blocks(text) -> Column:
    return count_all(text, POT_CODE_PATTERNS, "ims")


def feat_pot_quality(text) -> Column:
    return quality(count_all(text, POT_QUALITY_PATTERNS, "i"), text, "pot")


def feat_pot_steps(text) -> Column:
    total = count_all(text, POT_STEP_PATTERNS, "i") + count_all(text, [POT_ASSIGNMENT], "m")
    return F.greatest(total, F.lit(1))


def feat_pot_variables(text) -> Column:
    return any_match(text, POT_VARIABLE_PATTERNS, "i")


def feat_pot_functions(text) -> Column:
    return any_match(text, POT_FUNCTION_PATTERNS, "i")


def feat_pot_control(text) -> Column:
    return any_match(text, POT_CONTROL_PATTERNS, "i")


def feat_rap_stages(text) -> Column:
    numbered = count_all(text, [RAP_NUMBERED])
    return F.greatest(kinds_found(text, RAP_STAGE_PATTERNS, "i"), F.least(numbered, F.lit(RAP_MAX_NUMBERED)))


def feat_rap_quality(text) -> Column:
    return quality(count_all(text, RAP_QUALITY_PATTERNS, "i"), text, "rap")


def feat_rap_goal(text) -> Column:
    return any_match_lower(text, RAP_GOAL_PATTERNS)


def feat_rap_actions(text) -> Column:
    return any_match_lower(text, RAP_ACTION_PATTERNS)


def feat_rap_risk(text) -> Column:
    return any_match_lower(text, RAP_RISK_PATTERNS)


def feat_rap_execution(text) -> Column:
    return any_match_lower(text, RAP_EXECUTION_PATTERNS)


def feat_tot_branches(text) -> Column:
    named = count_all(text, TOT_BRANCH_PATTERNS, "i")
    return F.greatest(named, count_all(text, [TOT_LETTERED]), count_all(text, [TOT_NUMBERED]), F.lit(1))


def feat_tot_depth(text) -> Column:
    return (F.least(count_all(text, TOT_DEPTH_PATTERNS, "i"), F.lit(4)) + 1).cast("long")


def feat_tot_evaluations(text) -> Column:
    return count_all(text, TOT_EVALUATION_PATTERNS, "i")


def feat_tot_quality(text) -> Column:
    return quality(count_all(text, TOT_QUALITY_PATTERNS, "i"), text, "tot")


def feat_tot_decomposition(text) -> Column:
    return any_match_lower(text, TOT_DECOMPOSITION_PATTERNS)


def feat_tot_branches_flag(text) -> Column:
    return any_match_lower(text, TOT_BRANCH_FLAG_PATTERNS)


def feat_tot_exploration(text) -> Column:
    return any_match_lower(text, TOT_EXPLORATION_PATTERNS)


def feat_tot_evaluation(text) -> Column:
    return any_match_lower(text, TOT_PATH_EVALUATION_PATTERNS)


def feat_tot_selection(text) -> Column:
    return any_match_lower(text, TOT_SELECTION_PATTERNS)


def feat_tot_synthesis(text) -> Column:
    return any_match_lower(text, TOT_SYNTHESIS_PATTERNS)


def feat_sot_sections(text) -> Column:
    """Lines matching any section pattern (each line once), at least 1."""
    alt = "|".join(f"(?:{p})" for p in SOT_SECTION_PATTERNS)
    lines = F.split(_c(text), "\n")
    n = F.size(F.filter(lines, lambda l: l.rlike(rx(alt, "i"))))
    return F.greatest(n, F.lit(1)).cast("long")


_PY_WS_LEAD = f"^{PY_WS}+"


def feat_sot_levels(text) -> Column:
    """Distinct indentation levels (indent // 2 of indented lines) plus level 2
    for ``1.1``-style or ``a)``-style lines; at least 1."""
    lines = F.split(_c(text), "\n")

    def levels(l):
        stripped = F.regexp_replace(l, _PY_WS_LEAD, "")
        indent = F.length(l) - F.length(stripped)
        two = stripped.rlike(rx(SOT_NUMBERED_HIERARCHY)) | stripped.rlike(rx(SOT_LETTERED))
        keep = stripped != ""
        return F.array(
            F.when(keep & (indent > 0), F.floor(indent / 2).cast("int")),
            F.when(keep & two, F.lit(2)),
        )

    found = F.array_distinct(F.filter(F.flatten(F.transform(lines, levels)), lambda x: x.isNotNull()))
    return F.greatest(F.size(found), F.lit(1)).cast("long")


def feat_sot_quality(text) -> Column:
    return quality(count_all(text, SOT_QUALITY_PATTERNS, "i"), text, "sot")


def feat_sot_outline(text) -> Column:
    return any_match_lower(text, SOT_OUTLINE_PATTERNS)


def feat_sot_expansion(text) -> Column:
    return any_match_lower(text, SOT_EXPANSION_PATTERNS)


def feat_sot_progressive(text) -> Column:
    return any_match_lower(text, SOT_PROGRESSIVE_PATTERNS)


def feat_sot_integration(text) -> Column:
    return any_match_lower(text, SOT_INTEGRATION_PATTERNS)


def feat_sot_refinement(text) -> Column:
    return any_match_lower(text, SOT_REFINEMENT_PATTERNS)


def feat_cov_questions(text) -> Column:
    return F.least(count_all(text, COV_QUESTION_PATTERNS, "i"), F.lit(COV_MAX_QUESTIONS)).cast("long")


def feat_cov_quality(text) -> Column:
    return quality(count_all(text, COV_QUALITY_PATTERNS, "i"), text, "cov")


def feat_cov_initial(text) -> Column:
    return any_match_lower(text, COV_INITIAL_PATTERNS)


def feat_cov_questions_flag(text) -> Column:
    return any_match_lower(text, COV_QUESTION_FLAG_PATTERNS)


def feat_cov_assessment(text) -> Column:
    return any_match_lower(text, COV_ASSESSMENT_PATTERNS)


def feat_cov_refined(text) -> Column:
    return any_match_lower(text, COV_REFINED_PATTERNS)


def feat_ref_structure(text) -> Column:
    """struct(has_initial, has_reflection, has_refined, improvement_count,
    correction_count): case-insensitive on the original text."""
    t = _c(text)
    return F.struct(
        t.rlike(rx(REF_INITIAL, "i")).alias("has_initial"),
        t.rlike(rx(REF_REFLECTION, "i")).alias("has_reflection"),
        t.rlike(rx(REF_REFINED, "i")).alias("has_refined"),
        count_all(t, REF_IMPROVEMENT_PATTERNS, "i").alias("improvement_count"),
        count_all(t, REF_CORRECTION_PATTERNS, "i").alias("correction_count"),
    )


def has_structured_reflection(text) -> Column:
    return kinds_found(text, REF_STRUCTURE_MARKERS, "i") >= 2


def feat_ref_quality(text) -> Column:
    bonus = F.when(has_structured_reflection(text), F.lit(REF_STRUCTURE_BONUS)).otherwise(F.lit(0.0))
    return quality(count_all(text, REF_QUALITY_PATTERNS, "i"), text, "ref", bonus)


def feat_ref_steps(text) -> Column:
    sections = kinds_found(text, [rf"\b{s}\b.*(?:response|answer|attempt)" for s in REF_STEP_SECTIONS], "i")
    actions = count_all(text, REF_ACTION_PATTERNS, "i")
    return F.greatest(sections + F.floor(actions / 2).cast("long"), F.lit(2)).cast("long")


def feat_ref_sections(text) -> Column:
    t = _c(text)
    arr = F.array(*[F.when(t.rlike(rx(p, "i")), F.lit(name)) for name, p in REF_SECTIONS])
    return F.filter(arr, lambda x: x.isNotNull())


def feat_ref_issues(text) -> Column:
    return contains_words(text, REF_ISSUE_WORDS)


def feat_ref_improvements(text) -> Column:
    return contains_words(text, REF_IMPROVEMENT_WORDS)


def feat_needs_refinement(text, threshold: float = REFLECTION_THRESHOLD) -> Column:
    low = F.lower(_c(text))
    issues = sum((low.contains(w).cast("int") for w in REFINEMENT_ISSUE_WORDS), F.lit(0))
    density = issues.cast("double") / F.greatest(word_count(text), F.lit(1)).cast("double")
    return F.coalesce(density > (F.lit(1.0) - F.lit(threshold)), F.lit(False))


# feature name -> column function, grouped by approach
FEATURES: dict[str, dict[str, object]] = {
    "base": {"feat_base_steps": feat_base_steps},
    "ChainOfThought": {
        "feat_cot_steps": feat_cot_steps,
        "feat_cot_quality": feat_cot_quality,
        "feat_cot_numbered": feat_cot_numbered,
        "feat_cot_connectors": feat_cot_connectors,
    },
    "ProgramOfThought": {
        "feat_pot_code_blocks": feat_pot_code_blocks,
        "feat_pot_quality": feat_pot_quality,
        "feat_pot_steps": feat_pot_steps,
        "feat_pot_variables": feat_pot_variables,
        "feat_pot_functions": feat_pot_functions,
        "feat_pot_control": feat_pot_control,
    },
    "AsPlanning": {
        "feat_rap_stages": feat_rap_stages,
        "feat_rap_quality": feat_rap_quality,
        "feat_rap_goal": feat_rap_goal,
        "feat_rap_actions": feat_rap_actions,
        "feat_rap_risk": feat_rap_risk,
        "feat_rap_execution": feat_rap_execution,
    },
    "TreeOfThought": {
        "feat_tot_branches": feat_tot_branches,
        "feat_tot_depth": feat_tot_depth,
        "feat_tot_evaluations": feat_tot_evaluations,
        "feat_tot_quality": feat_tot_quality,
        "feat_tot_decomposition": feat_tot_decomposition,
        "feat_tot_branches_flag": feat_tot_branches_flag,
        "feat_tot_exploration": feat_tot_exploration,
        "feat_tot_evaluation": feat_tot_evaluation,
        "feat_tot_selection": feat_tot_selection,
        "feat_tot_synthesis": feat_tot_synthesis,
    },
    "SkeletonOfThought": {
        "feat_sot_sections": feat_sot_sections,
        "feat_sot_levels": feat_sot_levels,
        "feat_sot_quality": feat_sot_quality,
        "feat_sot_outline": feat_sot_outline,
        "feat_sot_expansion": feat_sot_expansion,
        "feat_sot_progressive": feat_sot_progressive,
        "feat_sot_integration": feat_sot_integration,
        "feat_sot_refinement": feat_sot_refinement,
    },
    "ChainOfVerification": {
        "feat_cov_questions": feat_cov_questions,
        "feat_cov_quality": feat_cov_quality,
        "feat_cov_initial": feat_cov_initial,
        "feat_cov_questions_flag": feat_cov_questions_flag,
        "feat_cov_assessment": feat_cov_assessment,
        "feat_cov_refined": feat_cov_refined,
    },
    "Reflection": {
        "feat_ref_structure": feat_ref_structure,
        "feat_ref_quality": feat_ref_quality,
        "feat_ref_steps": feat_ref_steps,
        "feat_ref_sections": feat_ref_sections,
        "feat_ref_issues": feat_ref_issues,
        "feat_ref_improvements": feat_ref_improvements,
        "feat_needs_refinement": feat_needs_refinement,
    },
}

ALL_FEATURES = {name: fn for group in FEATURES.values() for name, fn in group.items()}


def features_for(df: DataFrame, approach: str | None = None, text_col: str = "raw_output") -> DataFrame:
    """Add the feature columns of one approach (all approaches when None) in one
    projection: a single scan computes every requested feature."""
    groups = [FEATURES["base"]] + ([FEATURES[approach]] if approach in FEATURES else
                                   [g for k, g in FEATURES.items() if k != "base"] if approach is None else [])
    cols = [fn(F.col(text_col)).alias(name) for g in groups for name, fn in g.items()]
    return df.select("*", *cols)


def trace_steps(df: DataFrame, text_col: str = "text", approach_col: str = "approach",
                steps_col: str = "reasoning_steps", multi_col: str = "multi_step") -> DataFrame:
    """One row per reasoning step: from the multi-step details (``step_count``
    and ``step_<i>`` / ``step<i>`` entries), else ``reasoning_steps`` generic
    rows when more than one, else one row with the text cut to 100 chars."""
    m = F.col(multi_col)
    n_multi = F.coalesce(m["step_count"].cast("int"), F.lit(1))
    seq = F.when(m.isNotNull() & (n_multi >= 1), F.sequence(F.lit(1), n_multi)).otherwise(F.array().cast("array<int>"))

    def multi_step(i):
        k1 = F.concat(F.lit("step_"), i.cast("string"))
        k2 = F.concat(F.lit("step"), i.cast("string"))
        present = F.array_contains(F.map_keys(m), k1) | F.array_contains(F.map_keys(m), k2)
        content = F.when(F.array_contains(F.map_keys(m), k1), m[k1]).otherwise(F.coalesce(m[k2], F.lit("")))
        return F.when(present, F.struct(i.alias("step"), content.alias("content")))

    from_multi = F.filter(F.transform(seq, multi_step), lambda x: x.isNotNull())
    rs = F.coalesce(F.col(steps_col).cast("int"), F.lit(1))
    generic = F.transform(
        F.sequence(F.lit(1), F.greatest(rs, F.lit(1))),
        lambda i: F.struct(i.alias("step"), F.concat(F.lit("Reasoning step "), i.cast("string")).alias("content")),
    )
    t = F.col(text_col)
    single = F.array(F.struct(F.lit(1).alias("step"),
                              F.when(F.length(t) > 100, F.concat(F.substring(t, 1, 100), F.lit("..."))).otherwise(t).alias("content")))
    steps = F.when(F.size(from_multi) > 0, from_multi).when(rs > 1, generic).otherwise(single)
    keep = [c for c in df.columns if c not in (multi_col,)]
    return df.select(*keep, F.inline(steps)).select(
        *keep, "step", F.lit("reasoning").alias("type"), "content"
    ).withColumnRenamed(approach_col, "approach")
