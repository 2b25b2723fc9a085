"""Study statistics over approach metrics (2.11) and the study top-k picks (2.6).

Input is the approach-metrics table: one row per (experiment, approach) with
sample_count, correct_samples, error_samples, avg_response_time,
avg_tokens_used, total_cost.  All statistics are aggregates grouped by
approach (plus optional ``keys``), so they are distributed group-bys whose
output has one row per approach.  The Student-t tail is a JVM expression.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import combine_rows, stat_r

BASELINE = "None"

# --- fixed values: default ranking weights and rubric weights ---------------
RANKING_WEIGHTS = {"correctness": 0.4, "efficiency": 0.3, "speed": 0.2, "stability": 0.1}
RUBRIC_WEIGHTS = {"correctness": 0.4, "reasoning_quality": 0.3, "efficiency": 0.2, "robustness": 0.1}


def _rate() -> Column:
    return F.try_divide(F.col("correct_samples").cast("double"), F.col("sample_count").cast("double"))


def with_rates(am: DataFrame) -> DataFrame:
    """Adds rate = correct/samples and efficiency = rate/avg tokens."""
    return am.withColumn("rate", _rate()).withColumn(
        "efficiency", F.try_divide(F.col("rate"), F.col("avg_tokens_used").cast("double"))
    )


def correctness_stats(am: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    keys = list(keys)
    return with_rates(am).groupBy(*keys, "approach").agg(
        F.avg("rate").alias("mean_correctness"),
        F.stddev_samp("rate").alias("std_correctness"),
        F.min("rate").alias("min_correctness"),
        F.max("rate").alias("max_correctness"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def efficiency_stats(am: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """mean and sd of rate/tokens; mean of tokens per correct sample.  A zero
    denominator gives NULL (excluded from the mean) where pandas gives inf."""
    keys = list(keys)
    tpc = F.try_divide(F.col("avg_tokens_used").cast("double"), F.col("correct_samples").cast("double"))
    return with_rates(am).groupBy(*keys, "approach").agg(
        F.avg("efficiency").alias("mean_efficiency"),
        F.stddev_samp("efficiency").alias("std_efficiency"),
        F.avg(tpc).alias("tokens_per_correct"),
    )


# ----------------------------------------------------------------------------- Student t tail


def t_pvalue(t, df) -> Column:
    """Two-sided p of Student's t as a JVM expression (no Python) of constant
    size: p = I_x(df/2, 1/2), x = df / (df + t^2).

    The incomplete beta is its continued fraction, ``TAIL_STEPS`` steps
    summed by the ``aggregate`` higher-order function; where it converges
    slowly (t^2 small against df) the complement is used.  With b = 1/2 the
    number of steps needed does not grow with df."""
    t = F.col(t) if isinstance(t, str) else t
    nu = (F.col(df) if isinstance(df, str) else df).cast("double")
    t2 = t * t
    half = F.lit(0.5)
    a = nu * half
    x, y = nu / (nu + t2), t2 / (nu + t2)
    direct = x < (a + 1.0) / (a + 2.5)
    front = F.exp(-a * F.log1p(t2 / nu)) * F.sqrt(y) * _gamma_ratio(a) / np.sqrt(np.pi)
    p_, q_, z_ = (F.when(direct, u).otherwise(v) for u, v in ((a, half), (half, a), (x, y)))
    part = front * _beta_fraction(p_, q_, z_) / p_
    p = F.when(direct, part).otherwise(1.0 - part)
    return F.when((nu >= 1) & t.isNotNull() & ~F.isnan(t), F.when(t2 == 0, F.lit(1.0)).when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(p))


TAIL_STEPS = 300
GAMMA_SHIFT = 32


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): the recurrence lifts a by ``GAMMA_SHIFT``, where the asymptotic series is exact to a double."""
    z = 1.0 / (a + float(GAMMA_SHIFT))
    series = F.lit(0.0)
    # coefficients of the series in 1/z, from the highest power down
    for c in (869 / 4194304, -399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8, 1.0):
        series = series * z + c
    steps = F.sequence(F.lit(0), F.lit(GAMMA_SHIFT - 1))
    down = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * ((a + i) / (a + i + 0.5)))
    return down * series / F.sqrt(z)


def _beta_fraction(p: Column, q: Column, z: Column) -> Column:
    """Continued fraction of I_z(p, q), evaluated from its tail: f <- 1 + d_k / f over the fixed steps."""
    def back(f, m):
        m = m.cast("double")
        even = m * (q - m) * z / ((p + 2 * m - 1.0) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1.0))
        return F.lit(1.0) + even / (F.lit(1.0) + odd / f)

    first = -(p + q) * z / (p + 1.0)
    tail = F.aggregate(F.sequence(F.lit(TAIL_STEPS), F.lit(1), F.lit(-1)), F.lit(1.0), back)
    return 1.0 / (1.0 + first / tail)


def _moments(am: DataFrame, keys: list[str]) -> DataFrame:
    return with_rates(am).groupBy(*keys, "approach").agg(
        F.count("rate").alias("n"), F.avg("rate").alias("mean"), F.var_samp("rate").alias("var")
    )


def _join_baseline(m: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """Each non-baseline approach with the baseline's moments of the same keys,
    attached by a window over the aggregated per-approach rows (a handful per
    group), not by a join."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    is_b = F.col("approach") == baseline

    def pick(c: str) -> Column:
        return F.max(F.when(is_b, F.col(c))).over(w)

    out = m.select("*", pick("n").alias("nb"), pick("mean").alias("mb"), pick("var").alias("vb"),
                   F.max(is_b.cast("int")).over(w).alias("_has_b"))
    return out.filter(~is_b & (F.col("_has_b") == 1)).drop("_has_b")


def ttest_moments(am: DataFrame, keys: Iterable[str] = (), baseline: str = BASELINE) -> DataFrame:
    """t statistic and degrees of freedom of each approach against the
    baseline: two-sample t with pooled variance (approach minus baseline)."""
    keys = list(keys)
    j = _join_baseline(_moments(am, keys), baseline, keys)
    dof = F.col("n") + F.col("nb") - 2
    sp2 = F.try_divide((F.col("n") - 1) * F.col("var") + (F.col("nb") - 1) * F.col("vb"), dof.cast("double"))
    se = F.sqrt(sp2 * (F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("nb")))
    t = F.try_divide(F.col("mean") - F.col("mb"), F.when(se != 0, se))
    return j.select(*keys, "approach", t.alias("t_statistic"), dof.cast("double").alias("df"))


def ttest_vs_baseline(am: DataFrame, keys: Iterable[str] = (), baseline: str = BASELINE) -> DataFrame:
    """t, p and p < 0.05 of each approach against the baseline."""
    tm = ttest_moments(am, keys, baseline)
    p = t_pvalue(F.col("t_statistic"), F.col("df"))
    return tm.withColumn("p_value", p).withColumn(
        "significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    )


def effect_size(am: DataFrame, keys: Iterable[str] = (), baseline: str = BASELINE, z: float = 1.96) -> DataFrame:
    """Cohen's d against the baseline (pooled sd), a 95% interval of the mean
    rate, and the Bonferroni threshold 0.05 / number of comparisons."""
    keys = list(keys)
    j = _join_baseline(_moments(am, keys), baseline, keys)
    sp2 = F.try_divide(
        (F.col("n") - 1) * F.col("var") + (F.col("nb") - 1) * F.col("vb"), (F.col("n") + F.col("nb") - 2).cast("double")
    )
    sp = F.sqrt(sp2)
    half = z * F.sqrt(F.col("var") / F.col("n"))
    k = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else F.count(F.lit(1)).over(Window.partitionBy())
    return j.select(
        *keys,
        "approach",
        F.try_divide(F.col("mean") - F.col("mb"), F.when(sp != 0, sp)).alias("cohens_d"),
        (F.col("mean") - half).alias("ci_low"),
        (F.col("mean") + half).alias("ci_high"),
        (F.lit(0.05) / k).alias("bonferroni_alpha"),
    )


def scaling_behavior(am: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Per approach with >= 2 rows: correlation and slope of rate, time and
    tokens against the sample count."""
    keys = list(keys)
    x = F.col("sample_count").cast("double")
    r = with_rates(am)
    out = r.groupBy(*keys, "approach").agg(
        F.count(F.lit(1)).alias("n"),
        stat_r(x, F.col("rate")).alias("correctness_correlation"),
        F.regr_slope(F.col("rate"), x).alias("correctness_slope"),
        stat_r(x, F.col("avg_response_time")).alias("time_correlation"),
        F.regr_slope(F.col("avg_response_time"), x).alias("time_slope"),
        stat_r(x, F.col("avg_tokens_used")).alias("token_correlation"),
        F.regr_slope(F.col("avg_tokens_used"), x).alias("token_slope"),
    )
    return out.filter(F.col("n") >= 2).drop("n")


def weighted_ranking(am: DataFrame, weights: dict[str, float] | None = None, keys: Iterable[str] = ()) -> DataFrame:
    """0.4 correctness + 0.3 mean(rate/tokens) + 0.2 / mean time + 0.1 (1 - sd of
    rate); highest first.  A one-row approach has no sd, so no score: last."""
    w = {**RANKING_WEIGHTS, **(weights or {})}
    keys = list(keys)
    g = with_rates(am).groupBy(*keys, "approach").agg(
        F.avg("rate").alias("correctness_score"),
        F.avg("efficiency").alias("efficiency_score"),
        F.try_divide(F.lit(1.0), F.avg("avg_response_time")).alias("speed_score"),
        (F.lit(1.0) - F.stddev_samp("rate")).alias("stability_score"),
        F.count(F.lit(1)).alias("experiment_count"),
        F.avg("rate").alias("avg_correctness"),
        F.avg("avg_response_time").alias("avg_response_time"),
        F.avg("avg_tokens_used").alias("avg_tokens"),
    )
    score = (
        w["correctness"] * F.col("correctness_score")
        + w["efficiency"] * F.col("efficiency_score")
        + w["speed"] * F.col("speed_score")
        + w["stability"] * F.col("stability_score")
    )
    g = g.withColumn("score", score)
    rank = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), F.col("approach"))
    )
    return g.withColumn("rank", rank.cast("long"))


def recommendations(am: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """One row: best overall / accuracy / efficiency / speed, the four use
    cases, and the warnings (non-significant approaches, fewer than 10 rows).
    Ties go to the first approach by name.  The inputs here are per-approach
    aggregates (a handful of rows), so the unpartitioned windows are tiny."""
    rank = weighted_ranking(am).select("approach", "score", "correctness_score", "efficiency_score", "avg_response_time")
    tt = ttest_vs_baseline(am, baseline=baseline).select("approach", "significant")
    per = rank.join(tt, "approach", "left")

    def first(metric: str, desc: bool = True) -> Column:
        o = F.col(metric).desc_nulls_last() if desc else F.col(metric).asc_nulls_last()
        return F.row_number().over(Window.orderBy(o, F.col("approach")))

    per = per.select(
        "*",
        first("score").alias("_r_all"),
        first("correctness_score").alias("_r_acc"),
        first("efficiency_score").alias("_r_eff"),
        first("avg_response_time", desc=False).alias("_r_spd"),
    )

    def pick(r: str, c: str) -> Column:
        return F.max(F.when(F.col(r) == 1, F.col(c)))

    agg = per.agg(
        pick("_r_all", "approach").alias("best_overall"),
        pick("_r_all", "score").alias("best_overall_score"),
        pick("_r_acc", "approach").alias("best_for_accuracy"),
        pick("_r_acc", "correctness_score").alias("best_correctness"),
        pick("_r_eff", "approach").alias("best_for_efficiency"),
        pick("_r_eff", "efficiency_score").alias("best_efficiency"),
        pick("_r_spd", "approach").alias("best_for_speed"),
        pick("_r_spd", "avg_response_time").alias("best_avg_time"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("significant") == F.lit(False), F.col("approach")))), ", "
        ).alias("_ns"),
    )
    n_rows = am.agg(F.count(F.lit(1)).alias("n_rows"))
    j = combine_rows(agg, n_rows)
    warn = F.filter(
        F.array(
            F.when(F.col("_ns") != "", F.concat(F.lit("Approaches with no significant improvement over baseline: "), F.col("_ns"))),
            F.when(F.col("n_rows") < 10, F.lit("Limited experiment data - recommendations may not be reliable")),
        ),
        lambda x: x.isNotNull(),
    )
    return j.select(
        "best_overall",
        "best_overall_score",
        "best_for_accuracy",
        "best_correctness",
        "best_for_efficiency",
        "best_efficiency",
        "best_for_speed",
        "best_avg_time",
        F.col("best_for_accuracy").alias("use_high_accuracy_required"),
        F.col("best_for_efficiency").alias("use_resource_constrained"),
        F.col("best_for_speed").alias("use_real_time_applications"),
        F.col("best_overall").alias("use_general_purpose"),
        warn.alias("warnings"),
    )


def approach_comparison(am: DataFrame, keys: Iterable[str] = ("experiment_id",), baseline: str = BASELINE) -> DataFrame:
    """One row per (keys, approach) with correctness rate and the time and token
    overheads against the baseline row of the same keys (1.0 when the baseline
    value is not positive)."""
    keys = list(keys)
    r = with_rates(am).withColumnRenamed("rate", "correctness_rate")
    b = r.filter(F.col("approach") == baseline).select(
        *keys,
        F.col("correctness_rate").alias("baseline_rate"),
        F.col("avg_response_time").alias("_bt"),
        F.col("avg_tokens_used").alias("_bk"),
    )
    j = r.join(b, keys, "left")
    return j.select(
        *keys,
        "approach",
        "correctness_rate",
        "avg_response_time",
        "avg_tokens_used",
        "baseline_rate",
        F.when(F.col("_bt") > 0, F.col("avg_response_time") / F.col("_bt")).otherwise(F.lit(1.0)).alias("time_overhead"),
        F.when(F.col("_bk") > 0, F.col("avg_tokens_used") / F.col("_bk")).otherwise(F.lit(1.0)).alias("token_overhead"),
    )


def improvement_pct(am: DataFrame, keys: Iterable[str] = ("experiment_id",), baseline: str = BASELINE) -> DataFrame:
    """(rate - base) / base x 100; NULL with a label when the base is 0."""
    c = approach_comparison(am, keys, baseline).filter(F.col("approach") != baseline)
    pct = F.try_divide(F.col("correctness_rate") - F.col("baseline_rate"), F.when(F.col("baseline_rate") != 0, F.col("baseline_rate"))) * 100.0
    label = (
        F.when(F.col("baseline_rate") != 0, F.lit("relative"))
        .when(F.col("correctness_rate") > 0, F.lit("improved from zero"))
        .otherwise(F.lit("no improvement"))
    )
    return c.select(*list(keys), "approach", pct.alias("improvement_pct"), label.alias("improvement_label"))


def _top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")


def best_by_correctness(am: DataFrame, keys: Iterable[str] = ("experiment_id",), baseline: str = BASELINE) -> DataFrame:
    keys = list(keys)
    c = approach_comparison(am, keys, baseline).filter(F.col("approach") != baseline)
    return _top1(c, keys, [F.col("correctness_rate").desc_nulls_last(), F.col("approach")]).select(
        *keys, "approach", "correctness_rate"
    )


def best_by_efficiency(am: DataFrame, keys: Iterable[str] = ("experiment_id",), baseline: str = BASELINE) -> DataFrame:
    keys = list(keys)
    c = approach_comparison(am, keys, baseline).filter(F.col("approach") != baseline)
    c = c.withColumn("efficiency_score", F.try_divide(F.col("correctness_rate"), F.col("token_overhead")))
    return _top1(c, keys, [F.col("efficiency_score").desc_nulls_last(), F.col("approach")]).select(
        *keys, "approach", "efficiency_score"
    )


def fastest_approach(am: DataFrame, keys: Iterable[str] = ("experiment_id",), baseline: str = BASELINE) -> DataFrame:
    """Smallest time overhead (baseline excluded) per keys."""
    keys = list(keys)
    c = approach_comparison(am, keys, baseline).filter(F.col("approach") != baseline)
    return _top1(c, keys, [F.col("time_overhead").asc_nulls_last(), F.col("approach")]).select(
        *keys, "approach", "time_overhead"
    )


def fastest_by_mean_time(am: DataFrame) -> DataFrame:
    """Approach with the lowest mean response time over the whole study."""
    g = am.groupBy("approach").agg(F.avg("avg_response_time").alias("avg_time"))
    return g.agg(
        F.min_by("approach", F.struct("avg_time", "approach")).alias("approach"), F.min("avg_time").alias("avg_time")
    )


def meets_improvement(am: DataFrame, keys: Iterable[str] = ("experiment_id",), threshold: float = 0.25,
                      baseline: str = BASELINE) -> DataFrame:
    """Approaches whose relative gain over the baseline exceeds ``threshold``."""
    c = approach_comparison(am, keys, baseline).filter(F.col("approach") != baseline)
    gain = F.try_divide(F.col("correctness_rate") - F.col("baseline_rate"), F.when(F.col("baseline_rate") != 0, F.col("baseline_rate")))
    return c.withColumn("improvement", gain).filter(F.col("improvement") > threshold).select(
        *list(keys), "approach", (F.col("improvement") * 100.0).alias("improvement_pct")
    )


def scale_performance(scale: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Scaling analysis of a scale test (ok rows only, >= 2 of them):
    correlation, slope and linearity (|r| > 0.8) of time and memory against
    size; throughput decline first to last size; correctness range; score =
    mean(1 - min(1, |1 - r_time|), 1 - min(1, decline), 1 - range)."""
    keys = list(keys)
    ok = scale.filter(F.col("error").isNull())
    size = F.col("size").cast("double")
    order = F.struct(F.col("size"), F.col("_ord")) if "_ord" in scale.columns else F.col("size")
    g = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        stat_r(size, F.col("processing_time")).alias("time_correlation"),
        F.regr_slope(F.col("processing_time"), size).alias("time_slope"),
        stat_r(size, F.col("memory_usage_mb")).alias("memory_correlation"),
        F.regr_slope(F.col("memory_usage_mb"), size).alias("memory_slope"),
        F.min_by("throughput_samples_per_sec", order).alias("_tp_first"),
        F.max_by("throughput_samples_per_sec", order).alias("_tp_last"),
        (F.max("correctness_rate") - F.min("correctness_rate")).alias("correctness_stability"),
    )
    g = g.filter(F.col("n") >= 2)
    decline = F.when(F.col("_tp_first") > 0, (F.col("_tp_first") - F.col("_tp_last")) / F.col("_tp_first")).otherwise(F.lit(0.0))
    g = g.withColumn("throughput_decline", decline)
    time_score = F.lit(1.0) - F.least(F.lit(1.0), F.abs(F.lit(1.0) - F.col("time_correlation")))
    mem_score = F.lit(1.0) - F.least(F.lit(1.0), F.col("throughput_decline"))
    corr_score = F.lit(1.0) - F.col("correctness_stability")
    return g.select(
        *keys,
        "n",
        "time_correlation",
        "time_slope",
        (F.abs(F.col("time_correlation")) > 0.8).alias("time_is_linear"),
        "memory_correlation",
        "memory_slope",
        (F.abs(F.col("memory_correlation")) > 0.8).alias("memory_is_linear"),
        "throughput_decline",
        "correctness_stability",
        ((time_score + mem_score + corr_score) / 3.0).alias("scalability_score"),
    )


def scale_per_sample(scale: DataFrame) -> DataFrame:
    """Memory and time per sample of each ok scale row."""
    ok = scale.filter(F.col("error").isNull())
    return ok.select(
        "*",
        F.try_divide(F.col("memory_usage_mb"), F.col("size").cast("double")).alias("memory_per_sample"),
        F.try_divide(F.col("processing_time"), F.col("size").cast("double")).alias("time_per_sample"),
    )


def report_rows(am: DataFrame) -> DataFrame:
    """Ranking joined to correctness and efficiency: one flat row per approach,
    zeros for missing parts."""
    rank = weighted_ranking(am)
    cs = correctness_stats(am).select("approach", "std_correctness")
    es = efficiency_stats(am).select("approach", "mean_efficiency", "tokens_per_correct")
    j = rank.join(cs, "approach", "left").join(es, "approach", "left")
    return j.select(
        "approach",
        "rank",
        F.col("score").alias("overall_score"),
        "avg_correctness",
        F.coalesce("std_correctness", F.lit(0.0)).alias("correctness_std"),
        "avg_response_time",
        "avg_tokens",
        F.coalesce("mean_efficiency", F.lit(0.0)).alias("efficiency"),
        F.coalesce("tokens_per_correct", F.lit(0.0)).alias("tokens_per_correct"),
        "experiment_count",
    )


def rubric_score(df: DataFrame, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the four rubric criteria (columns named after them)."""
    w = {**RUBRIC_WEIGHTS, **(weights or {})}
    return sum((F.lit(v) * F.col(k).cast("double") for k, v in w.items()), F.lit(0.0))
