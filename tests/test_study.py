"""Study statistics: Student-t tail against tabled values and a hand t-test."""

import math

import pytest
from pyspark.sql import functions as F

from runlens.operators import study as S

from .student_t import t_two_sided_p


@pytest.mark.parametrize("t,df,p", [
    (2.228, 10, 0.05), (12.706, 1, 0.05), (2.086, 20, 0.05), (1.96, 100000, 0.05), (0.0, 5, 1.0),
    (2.977, 14, 0.01), (4.032, 5, 0.01), (1.0, 2, 0.42265),
])
def test_t_tail_tabled(spark, t, df, p):
    got = spark.createDataFrame([(t, df)], "t double, df long").select(S.t_pvalue("t", "df").alias("p")).first().p
    assert abs(got - p) < 5e-4
    assert abs(got - float(t_two_sided_p([t], [df])[0])) < 1e-9


def test_t_tail_far_out_and_huge_df(spark):
    """Relative error against closed forms: df 1 and 2 exactly, the normal tail at df 1e9, tiny p at df 100."""
    rows = [(t, df) for t in (1e-9, 0.01, 0.5, 1.7, 1.8, 2.5, 6.0, 40.0, 1e4) for df in (1, 2, 1_000_000_000)]
    got = spark.createDataFrame(rows, "t double, df long").select("t", "df", S.t_pvalue("t", "df").alias("p")).collect()
    for r in got:
        if r.df == 1:
            want = 2 / math.pi * math.atan2(1, r.t)
        elif r.df == 2:
            root = math.sqrt(2 + r.t * r.t)
            want = 2 / (root * (root + r.t))
        elif r.t < 6:
            want = math.erfc(r.t / math.sqrt(2))
        else:
            continue
        assert abs(r.p - want) <= 5e-8 * want if r.df > 2 else abs(r.p - want) <= 1e-9 * want, r
    tiny = spark.createDataFrame([(40.0, 100), (-40.0, 100), (40.0, 1_000_000_000), (None, 5), (1.0, 0)], "t double, df long")
    p = [r.p for r in tiny.select(S.t_pvalue("t", "df").alias("p")).collect()]
    assert p[0] == p[1] and 2.4e-63 < p[0] < 2.6e-63
    assert 0 <= p[2] < 1e-300 and p[3] is None and p[4] is None


def _am(spark, rows):
    return spark.createDataFrame(rows, "experiment_id string, approach string, sample_count long, correct_samples long, "
                                       "avg_response_time double, avg_tokens_used double")


def test_ttest_by_hand(spark):
    rows = []
    base = [5, 6, 7, 6]
    other = [8, 9, 7, 9]
    for i, (b, o) in enumerate(zip(base, other)):
        rows.append((f"e{i}", "None", 10, b, 1.0, 100.0))
        rows.append((f"e{i}", "CoT", 10, o, 2.0, 200.0))
    out = S.ttest_vs_baseline(_am(spark, rows)).first()
    a = [x / 10 for x in other]
    b = [x / 10 for x in base]
    ma, mb = sum(a) / 4, sum(b) / 4
    va = sum((x - ma) ** 2 for x in a) / 3
    vb = sum((x - mb) ** 2 for x in b) / 3
    t = (ma - mb) / math.sqrt(((3 * va + 3 * vb) / 6) * (0.5))
    assert abs(out.t_statistic - t) < 1e-12
    assert out.df == 6
    assert out.significant == (out.p_value < 0.05)


def test_ranking_puts_single_row_approaches_last(spark):
    rows = [("e1", "None", 10, 5, 1.0, 100.0), ("e2", "None", 10, 6, 1.0, 100.0), ("e1", "Solo", 10, 10, 0.1, 10.0)]
    r = S.weighted_ranking(_am(spark, rows)).orderBy("rank").collect()
    assert [x.approach for x in r] == ["None", "Solo"]
    assert r[1].score is None


def test_recommendations_warnings(spark):
    rows = [("e1", "None", 10, 5, 1.0, 100.0), ("e2", "None", 10, 6, 1.0, 100.0),
            ("e1", "CoT", 10, 6, 2.0, 150.0), ("e2", "CoT", 10, 5, 2.0, 150.0)]
    rec = S.recommendations(_am(spark, rows)).first()
    assert rec.best_for_speed == "None"
    assert any("no significant improvement" in w for w in rec.warnings)
    assert any("Limited experiment data" in w for w in rec.warnings)


def test_scale_performance_score(spark):
    rows = [(10, 0.8, 1.0, 10.0, 10.0, None, 0), (20, 0.8, 2.0, 20.0, 10.0, None, 1),
            (40, 0.7, 4.0, 40.0, 10.0, None, 2), (80, 0.1, 9.0, 0.0, 0.0, "oom", 3)]
    df = spark.createDataFrame(rows, "size long, correctness_rate double, processing_time double, "
                                     "memory_usage_mb double, throughput_samples_per_sec double, error string, _ord long")
    out = S.scale_performance(df).first()
    assert out.n == 3
    assert abs(out.time_correlation - 1.0) < 1e-12
    assert out.throughput_decline == 0.0
    assert abs(out.scalability_score - (1 + 1 + (1 - 0.1)) / 3) < 1e-9
