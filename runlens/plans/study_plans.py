"""Registered queries for the study statistics (2.11) and study picks (2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import study as S
from .registry import query

AM = ["approach_metrics_v"]

RATES = """
r AS (SELECT *, CAST(correct_samples AS DOUBLE) / nullif(CAST(sample_count AS DOUBLE), 0) AS rate
      FROM approach_metrics_v),
re AS (SELECT *, rate / nullif(CAST(avg_tokens_used AS DOUBLE), 0) AS efficiency FROM r)
"""


@query("correctness_stats", AM, section="2.11", oracle="WITH " + RATES + """
SELECT approach, avg(rate) AS mean_correctness, stddev_samp(rate) AS std_correctness,
       min(rate) AS min_correctness, max(rate) AS max_correctness, count(*) AS sample_count
FROM re GROUP BY approach
""")
def _q(fx):
    return S.correctness_stats(fx.approach_metrics_v)


@query("efficiency_stats", AM, section="2.11", oracle="WITH " + RATES + """
SELECT approach, avg(efficiency) AS mean_efficiency, stddev_samp(efficiency) AS std_efficiency,
       avg(CAST(avg_tokens_used AS DOUBLE) / nullif(CAST(correct_samples AS DOUBLE), 0)) AS tokens_per_correct
FROM re GROUP BY approach
""")
def _q(fx):
    return S.efficiency_stats(fx.approach_metrics_v)


def _p_sql(t: str, nu: str) -> str:
    """Student-t two-sided p by the same finite series, coefficients via lgamma."""
    th = f"atan(abs({t}) / sqrt(CAST({nu} AS DOUBLE)))"
    c2 = f"pow(cos({th}), 2)"
    even = (f"sin({th}) * list_sum(list_transform(range(0, CAST({nu} / 2 AS BIGINT)), "
            f"lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow({c2}, k)))")
    odd = (f"CASE WHEN {nu} = 1 THEN 2 * {th} / pi() ELSE (2 / pi()) * ({th} + sin({th}) * cos({th}) * "
           f"list_sum(list_transform(range(0, CAST(({nu} - 1) / 2 AS BIGINT)), "
           f"lambda k: sqrt(pi()) * exp(lgamma(k + 1) - lgamma(k + 1.5)) / 2 * pow({c2}, k)))) END")
    return (f"CASE WHEN {nu} >= 1 AND {t} IS NOT NULL AND NOT isnan({t}) THEN 1 - "
            f"(CASE WHEN CAST({nu} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END) END")


TT_PARTS = """
m AS (SELECT approach, count(rate) AS n, avg(rate) AS mean, var_samp(rate) AS var FROM re GROUP BY approach),
b AS (SELECT n AS nb, mean AS mb, var AS vb FROM m WHERE approach = 'None'),
j AS (SELECT m.*, b.*, CAST(n + nb - 2 AS DOUBLE) AS df,
             ((n - 1) * var + (nb - 1) * vb) / nullif(CAST(n + nb - 2 AS DOUBLE), 0) AS sp2
      FROM m CROSS JOIN b WHERE m.approach <> 'None'),
t AS (SELECT approach, df, (mean - mb) / nullif(sqrt(sp2 * (1.0 / n + 1.0 / nb)), 0) AS t_statistic, n, nb, mean, mb, var, vb, sp2
      FROM j)
"""
TT_CTE = "WITH " + RATES + "," + TT_PARTS


@query("ttest_vs_baseline", AM, section="2.11", oracle=TT_CTE + f"""
SELECT approach, t_statistic, df, p_value, coalesce(p_value < 0.05, FALSE) AS significant
FROM (SELECT *, {_p_sql('t_statistic', 'df')} AS p_value FROM t)
""")
def _q(fx):
    return S.ttest_vs_baseline(fx.approach_metrics_v)


@query("effect_size", AM, section="2.11", oracle=TT_CTE + """
SELECT approach, (mean - mb) / nullif(sqrt(sp2), 0) AS cohens_d,
       mean - 1.96 * sqrt(var / n) AS ci_low, mean + 1.96 * sqrt(var / n) AS ci_high,
       0.05 / count(*) OVER () AS bonferroni_alpha
FROM t
""")
def _q(fx):
    return S.effect_size(fx.approach_metrics_v)


def _r(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query("scaling_behavior", AM, section="2.11", oracle="WITH " + RATES + f"""
SELECT approach,
  {_r('CAST(sample_count AS DOUBLE)', 'rate')} AS correctness_correlation,
  regr_slope(rate, CAST(sample_count AS DOUBLE)) AS correctness_slope,
  {_r('CAST(sample_count AS DOUBLE)', 'avg_response_time')} AS time_correlation,
  regr_slope(avg_response_time, CAST(sample_count AS DOUBLE)) AS time_slope,
  {_r('CAST(sample_count AS DOUBLE)', 'avg_tokens_used')} AS token_correlation,
  regr_slope(avg_tokens_used, CAST(sample_count AS DOUBLE)) AS token_slope
FROM re GROUP BY approach HAVING count(*) >= 2
""")
def _q(fx):
    return S.scaling_behavior(fx.approach_metrics_v)


RANK_PARTS = """
g AS (SELECT approach, avg(rate) AS correctness_score, avg(efficiency) AS efficiency_score,
             1.0 / nullif(avg(avg_response_time), 0) AS speed_score, 1.0 - stddev_samp(rate) AS stability_score,
             count(*) AS experiment_count, avg(rate) AS avg_correctness, avg(avg_response_time) AS avg_response_time,
             avg(avg_tokens_used) AS avg_tokens
      FROM re GROUP BY approach),
s AS (SELECT *, 0.4 * correctness_score + 0.3 * efficiency_score + 0.2 * speed_score + 0.1 * stability_score AS score
      FROM g),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, approach) AS rank FROM s)
"""
RANK_CTE = "WITH " + RATES + "," + RANK_PARTS


@query("weighted_ranking", AM, section="2.11", oracle=RANK_CTE + "SELECT * FROM rk")
def _q(fx):
    return S.weighted_ranking(fx.approach_metrics_v)


@query("rank_approaches", AM, section="2.5", oracle=RANK_CTE + "SELECT approach, score, rank FROM rk")
def _q(fx):
    return S.weighted_ranking(fx.approach_metrics_v).select("approach", "score", "rank")


@query("recommendations", AM, section="2.11", oracle="WITH " + RATES + "," + TT_PARTS + "," + RANK_PARTS + f""",
tt AS (SELECT approach, coalesce(({_p_sql('t_statistic', 'df')}) < 0.05, FALSE) AS significant FROM t),
per AS (SELECT rk.*, tt.significant,
   row_number() OVER (ORDER BY correctness_score DESC NULLS LAST, rk.approach) AS r_acc,
   row_number() OVER (ORDER BY efficiency_score DESC NULLS LAST, rk.approach) AS r_eff,
   row_number() OVER (ORDER BY avg_response_time ASC NULLS LAST, rk.approach) AS r_spd
   FROM rk LEFT JOIN tt ON rk.approach = tt.approach),
a AS (SELECT max(CASE WHEN rank = 1 THEN approach END) AS best_overall,
             max(CASE WHEN rank = 1 THEN score END) AS best_overall_score,
             max(CASE WHEN r_acc = 1 THEN approach END) AS best_for_accuracy,
             max(CASE WHEN r_acc = 1 THEN correctness_score END) AS best_correctness,
             max(CASE WHEN r_eff = 1 THEN approach END) AS best_for_efficiency,
             max(CASE WHEN r_eff = 1 THEN efficiency_score END) AS best_efficiency,
             max(CASE WHEN r_spd = 1 THEN approach END) AS best_for_speed,
             max(CASE WHEN r_spd = 1 THEN avg_response_time END) AS best_avg_time,
             coalesce(string_agg(CASE WHEN significant = FALSE THEN approach END, ', ' ORDER BY approach), '') AS ns
      FROM per),
n AS (SELECT count(*) AS n_rows FROM approach_metrics_v)
SELECT best_overall, best_overall_score, best_for_accuracy, best_correctness, best_for_efficiency, best_efficiency,
       best_for_speed, best_avg_time, best_for_accuracy AS use_high_accuracy_required,
       best_for_efficiency AS use_resource_constrained, best_for_speed AS use_real_time_applications,
       best_overall AS use_general_purpose,
       list_filter(list_value(
         CASE WHEN ns <> '' THEN concat('Approaches with no significant improvement over baseline: ', ns) END,
         CASE WHEN n_rows < 10 THEN 'Limited experiment data - recommendations may not be reliable' END),
         lambda x: x IS NOT NULL) AS warnings
FROM a CROSS JOIN n
""")
def _q(fx):
    return S.recommendations(fx.approach_metrics_v)


CMP_CTE = "WITH " + RATES + """,
b AS (SELECT experiment_id, rate AS baseline_rate, avg_response_time AS bt, avg_tokens_used AS bk
      FROM re WHERE approach = 'None'),
c AS (SELECT re.experiment_id, re.approach, re.rate AS correctness_rate, re.avg_response_time, re.avg_tokens_used,
             b.baseline_rate,
             CASE WHEN b.bt > 0 THEN re.avg_response_time / b.bt ELSE 1.0 END AS time_overhead,
             CASE WHEN b.bk > 0 THEN re.avg_tokens_used / b.bk ELSE 1.0 END AS token_overhead
      FROM re LEFT JOIN b ON re.experiment_id = b.experiment_id),
o AS (SELECT * FROM c WHERE approach <> 'None')
"""


@query("improvement_pct", AM, section="2.11", oracle=CMP_CTE + """
SELECT experiment_id, approach,
  (correctness_rate - baseline_rate) / nullif(baseline_rate, 0) * 100.0 AS improvement_pct,
  CASE WHEN baseline_rate <> 0 THEN 'relative' WHEN correctness_rate > 0 THEN 'improved from zero'
       ELSE 'no improvement' END AS improvement_label
FROM o
""")
def _q(fx):
    return S.improvement_pct(fx.approach_metrics_v)


@query("best_by_correctness", AM, section="2.6", oracle=CMP_CTE + """
SELECT experiment_id, approach, correctness_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY correctness_rate DESC NULLS LAST, approach) AS rk FROM o)
WHERE rk = 1
""")
def _q(fx):
    return S.best_by_correctness(fx.approach_metrics_v)


@query("best_by_efficiency", AM, section="2.6", oracle=CMP_CTE + """
SELECT experiment_id, approach, efficiency_score FROM (
  SELECT *, correctness_rate / nullif(token_overhead, 0) AS efficiency_score,
         row_number() OVER (PARTITION BY experiment_id ORDER BY correctness_rate / nullif(token_overhead, 0) DESC NULLS LAST,
                            approach) AS rk FROM o)
WHERE rk = 1
""")
def _q(fx):
    return S.best_by_efficiency(fx.approach_metrics_v)


@query("fastest_approach", AM, section="2.6", oracle=CMP_CTE + """
SELECT experiment_id, approach, time_overhead FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY time_overhead ASC NULLS LAST, approach) AS rk FROM o)
WHERE rk = 1
""")
def _q(fx):
    return S.fastest_approach(fx.approach_metrics_v)


@query("meets_improvement", AM, section="2.6", oracle=CMP_CTE + """
SELECT experiment_id, approach, (correctness_rate - baseline_rate) / nullif(baseline_rate, 0) * 100.0 AS improvement_pct
FROM o WHERE (correctness_rate - baseline_rate) / nullif(baseline_rate, 0) > 0.25
""")
def _q(fx):
    return S.meets_improvement(fx.approach_metrics_v)


SCALE_CTE = """
WITH sc AS (
  SELECT approach, CAST(substr(experiment_id, 5) AS INT) AS _ord, sample_count AS size,
         CAST(correct_samples AS DOUBLE) / sample_count AS correctness_rate,
         avg_response_time * sample_count AS processing_time,
         avg_tokens_used * sample_count / 1000.0 AS memory_usage_mb,
         sample_count / nullif(avg_response_time * sample_count, 0) AS throughput_samples_per_sec,
         CASE WHEN error_samples * 8 > sample_count THEN 'timeout' END AS error
  FROM approach_metrics_v)
"""


def _scale_rows(fx):
    am = fx.approach_metrics_v
    return am.select(
        "approach",
        F.substring("experiment_id", 5, 10).cast("int").alias("_ord"),
        F.col("sample_count").alias("size"),
        (F.col("correct_samples").cast("double") / F.col("sample_count")).alias("correctness_rate"),
        (F.col("avg_response_time") * F.col("sample_count")).alias("processing_time"),
        (F.col("avg_tokens_used") * F.col("sample_count") / 1000.0).alias("memory_usage_mb"),
        F.try_divide(F.col("sample_count").cast("double"), F.col("avg_response_time") * F.col("sample_count")).alias(
            "throughput_samples_per_sec"),
        F.when(F.col("error_samples") * 8 > F.col("sample_count"), F.lit("timeout")).alias("error"),
    )


@query("scale_performance", AM, section="2.11", oracle=SCALE_CTE + f"""
, g AS (
  SELECT approach, count(*) AS n,
    {_r('CAST(size AS DOUBLE)', 'processing_time')} AS time_correlation,
    regr_slope(processing_time, CAST(size AS DOUBLE)) AS time_slope,
    {_r('CAST(size AS DOUBLE)', 'memory_usage_mb')} AS memory_correlation,
    regr_slope(memory_usage_mb, CAST(size AS DOUBLE)) AS memory_slope,
    arg_min(throughput_samples_per_sec, (size, _ord)) AS tp_first,
    arg_max(throughput_samples_per_sec, (size, _ord)) AS tp_last,
    max(correctness_rate) - min(correctness_rate) AS correctness_stability
  FROM sc WHERE error IS NULL GROUP BY approach HAVING count(*) >= 2),
h AS (SELECT *, CASE WHEN tp_first > 0 THEN (tp_first - tp_last) / tp_first ELSE 0.0 END AS throughput_decline FROM g)
SELECT approach, n, time_correlation, time_slope, abs(time_correlation) > 0.8 AS time_is_linear,
       memory_correlation, memory_slope, abs(memory_correlation) > 0.8 AS memory_is_linear,
       throughput_decline, correctness_stability,
       ((1.0 - least(1.0, abs(1.0 - time_correlation))) + (1.0 - least(1.0, throughput_decline))
        + (1.0 - correctness_stability)) / 3.0 AS scalability_score
FROM h
""")
def _q(fx):
    return S.scale_performance(_scale_rows(fx), ["approach"])


@query("report_rows", AM, section="2.11", oracle=RANK_CTE + """
, cs AS (SELECT approach, stddev_samp(rate) AS std_correctness FROM re GROUP BY approach),
es AS (SELECT approach, avg(efficiency) AS mean_efficiency,
              avg(CAST(avg_tokens_used AS DOUBLE) / nullif(CAST(correct_samples AS DOUBLE), 0)) AS tokens_per_correct
       FROM re GROUP BY approach)
SELECT rk.approach, rank, score AS overall_score, avg_correctness, coalesce(std_correctness, 0.0) AS correctness_std,
       avg_response_time, avg_tokens, coalesce(mean_efficiency, 0.0) AS efficiency,
       coalesce(tokens_per_correct, 0.0) AS tokens_per_correct, experiment_count
FROM rk LEFT JOIN cs ON rk.approach = cs.approach LEFT JOIN es ON rk.approach = es.approach
""")
def _q(fx):
    return S.report_rows(fx.approach_metrics_v)


@query("rubric_score", ["runs_v"], section="2.11", oracle="""
SELECT id, 0.4 * CAST(coalesce(is_correct, FALSE) AS DOUBLE) + 0.3 * parsing_confidence
         + 0.2 * (1.0 / (1.0 + execution_time_ms / 1000.0))
         + 0.1 * CASE WHEN parsing_method IS NULL THEN 0.0 ELSE 1.0 END AS rubric_score
FROM runs_v
""")
def _q(fx):
    r = fx.runs_v.select(
        "id",
        F.coalesce(F.col("is_correct"), F.lit(False)).cast("double").alias("correctness"),
        F.col("parsing_confidence").alias("reasoning_quality"),
        (F.lit(1.0) / (F.lit(1.0) + F.col("execution_time_ms") / 1000.0)).alias("efficiency"),
        F.when(F.col("parsing_method").isNull(), F.lit(0.0)).otherwise(F.lit(1.0)).alias("robustness"),
    )
    return r.select("id", S.rubric_score(r).alias("rubric_score"))
