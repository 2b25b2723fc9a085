"""Property tests: random texts through Spark and through Python's ``re``.

Each hypothesis example is a batch of texts evaluated in one Spark job."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.functions import extract as X
from runlens.functions import features as FT
from runlens.functions.text import pystrip, word_count

from .test_extract import py_clean, py_extract

WORDS = ["Answer:", "Final answer:", "the answer is", "(B)", "[C]", "yes", "No", "A.", "1.", "Step 2", "therefore",
         "so,", "Let's", "because", "é", "ß", "\n", "  ", "\t", "x = 1", "```python", "```", "?", "approach 2",
         "A)", "maybe", "café", "naïve", " ", " "]

texts = st.lists(
    st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=6)), max_size=25).map(" ".join),
    min_size=30, max_size=60,
)

SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)


@SETTINGS
@given(texts)
def test_extract_matches_python(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "id int, raw_output string")
    rows = X.extract_answer(df).collect()
    for r in rows:
        assert (r.final_answer, r.confidence) == py_extract(r.raw_output), r.raw_output


@SETTINGS
@given(texts)
def test_clean_strip_words_match_python(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    rows = df.select("t", X.clean_answer("t").alias("c"), pystrip("t").alias("s"), word_count("t").alias("w")).collect()
    for r in rows:
        assert r.c == py_clean(r.t), repr(r.t)
        assert r.s == r.t.strip()
        assert r.w == len(r.t.split())


@SETTINGS
@given(texts)
def test_feature_counts_match_python(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    t = F.col("t")
    rows = df.select("t", FT.feat_cot_steps(t).alias("a"), FT.feat_pot_code_blocks(t).alias("b"),
                     FT.feat_cov_questions(t).alias("c"), FT.feat_sot_sections(t).alias("d")).collect()
    for r in rows:
        n = sum(len(re.findall(p, r.t, re.IGNORECASE)) for p in FT.COT_STEP_PATTERNS)
        assert r.a == (max(1, n) if n > 0 else 1)
        assert r.b == sum(len(re.findall(p, r.t, re.MULTILINE | re.DOTALL | re.IGNORECASE)) for p in FT.POT_CODE_PATTERNS)
        assert r.c == min(sum(len(re.findall(p, r.t, re.IGNORECASE)) for p in FT.COV_QUESTION_PATTERNS), 10)
        lines = sum(1 for ln in r.t.split("\n") if any(re.search(p, ln, re.IGNORECASE) for p in FT.SOT_SECTION_PATTERNS))
        assert r.d == max(lines, 1)
