"""Text features against Python ``re`` on Unicode prose (documents)."""

import re

from pyspark.sql import functions as F

from runlens.functions import features as FT

from .conftest import SF_CHECK


def count(patterns, text, flags=0):
    return sum(len(re.findall(p, text, flags)) for p in patterns)


def py_cot_steps(t):
    n = count(FT.COT_STEP_PATTERNS, t, re.IGNORECASE)
    return max(1, n) if n > 0 else 1


def py_tot_branches(t):
    b = count(FT.TOT_BRANCH_PATTERNS, t, re.IGNORECASE)
    return max(b, len(re.findall(FT.TOT_LETTERED, t)), len(re.findall(FT.TOT_NUMBERED, t)), 1)


def py_quality(patterns, t, w, length):
    hits = count(patterns, t, re.IGNORECASE)
    return min((hits * w) * min(len(t.split()) / length, 1.0), 1.0)


def py_sot_levels(t):
    levels = set()
    for line in t.split("\n"):
        s = line.lstrip()
        if not s:
            continue
        ind = len(line) - len(s)
        if ind > 0:
            levels.add(ind // 2)
        if re.search(FT.SOT_NUMBERED_HIERARCHY, s) or re.search(FT.SOT_LETTERED, s):
            levels.add(2)
    return max(len(levels), 1)


def py_rap_goal(t):
    return any(re.search(p, t.lower()) for p in FT.RAP_GOAL_PATTERNS)


def test_features_match_python_re(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select(
        "doc_id", F.col("text").alias("t"))
    t = F.col("t")
    rows = docs.select(
        "t",
        FT.feat_cot_steps(t).alias("cot_steps"),
        FT.feat_tot_branches(t).alias("tot_branches"),
        FT.feat_sot_levels(t).alias("sot_levels"),
        FT.feat_rap_goal(t).alias("rap_goal"),
        FT.feat_tot_quality(t).alias("tot_quality"),
    ).collect()
    assert len(rows) > 100
    for r in rows:
        assert r.cot_steps == py_cot_steps(r.t)
        assert r.tot_branches == py_tot_branches(r.t)
        assert r.sot_levels == py_sot_levels(r.t)
        assert r.rap_goal == py_rap_goal(r.t)
        q = py_quality(FT.TOT_QUALITY_PATTERNS, r.t, 0.06, 200)
        assert abs(r.tot_quality - q) <= 0.005 + 1e-9


def test_word_count_uses_python_whitespace(spark):
    from runlens.functions.text import word_count

    texts = ["a b", " a b　c ", "", "\x1c x \x1f", "one"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r.n for r in df.select(word_count("t").alias("n")).collect()]
    assert got == [len(x.split()) for x in texts]


def test_features_for_adds_all_columns_in_one_projection(spark):
    df = spark.createDataFrame([(1, "Step 1. Let me think.\nTherefore, 2.")], "id int, raw_output string")
    out = FT.features_for(df, "ChainOfThought")
    assert set(FT.FEATURES["ChainOfThought"]) <= set(out.columns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
