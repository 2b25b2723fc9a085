"""Plan-level checks of the scale rules."""

from runlens.operators import runs as R
from runlens.operators.common import global_index


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compare_approaches_pre_aggregates_metrics(spark, fx_small):
    df = R.compare_approaches(fx_small.runs_v, fx_small.parsing_metrics_v)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # metrics are reduced per run before the join: no fanning join feeds the aggregate
    assert plan.count("Aggregate") >= 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in _plan(df)


def test_scan_prunes_columns(spark, fx_small):
    df = R.accuracy_by_model(fx_small.runs_v)
    plan = _plan(df)
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan or "props" not in plan


def test_global_index_has_no_single_partition_window(spark, fx_small):
    df = global_index(fx_small.benchmark, ["item_id"], "i")
    plan = _plan(df)
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]
    got = [r.i for r in df.orderBy("item_id").collect()]
    assert got == list(range(len(got)))


def test_running_sums_hot_group_sparse_keys(spark):
    """One group holding most rows, with sparse order keys: the running count
    equals a plain numbering and the group is cut across several slices."""
    from pyspark.sql import functions as F

    from runlens.operators.common import running_sums

    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        (F.col("id") * 1_000_003).alias("k"),  # sparse keys
        (F.col("id") % 5).cast("double").alias("x"),
    )
    vals = {"n_before": F.lit(1).cast("long"), "x_before": F.col("x")}
    sliced = running_sums(df, ["g"], [F.col("k")], vals, num_partitions=8)
    rows = sliced.collect()
    assert len(rows) == n
    by_g = {}
    for r in sorted(rows, key=lambda r: (r.g, r.k)):
        seen = by_g.setdefault(r.g, [0, 0.0])
        assert r.n_before == seen[0]
        assert abs(r.x_before - seen[1]) < 1e-9
        seen[0] += 1
        seen[1] += r.x


def test_size_bound_gates_broadcast(spark, fx_small):
    from runlens.operators.common import maybe_broadcast, size_bound

    assert size_bound(fx_small.experiments_v) < 1_000_000
    plan = maybe_broadcast(fx_small.experiments_v, max_bytes=1)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower()


def test_failure_patterns_limit_counts_fanned_rows(spark):
    """With a row limit the fanned metric rows count one by one, as the
    reference's LIMIT over the joined rows does."""
    import datetime as dt

    from runlens.operators import runs as R

    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [("r1", "e", "A", "m", "q", "1", "x", None, False, t), ("r2", "e", "A", "m", "q", "1", "y", None, False,
                                                                t + dt.timedelta(seconds=1))],
        "id string, experiment_id string, approach_name string, model string, input_text string, "
        "expected_answer string, parsed_answer string, parsing_method string, is_correct boolean, created_at timestamp")
    metrics = spark.createDataFrame([("r1", "")] * 6 + [("r2", "")], "run_id string, error_details string")
    full = R.failure_patterns(runs, metrics).first()
    assert full["count"] == 7 and len(full["examples"]) == 3
    limited = R.failure_patterns(runs, metrics, limit=5).first()
    assert limited["count"] == 5


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from runlens.operators.common import exact_quantiles

    df = spark.range(2001).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.lit("cold")).alias("g"),
        ((F.col("id") * 7919) % 1009).cast("double").alias("x"),
    )
    qs = {"q25": 0.25, "q50": 0.5, "q90": 0.9}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", qs).collect()}
    small = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("x", F.lit(q)).alias(k) for k, q in qs.items()]).collect()}
    for g in got:
        for name in qs:
            assert abs(got[g][name] - small[g][name]) < 1e-9
    vals = {}
    for r in df.collect():
        vals.setdefault(r.g, []).append(r.x)
    for g, xs in vals.items():
        for name, q in (("q25", 0.25), ("q50", 0.5), ("q90", 0.9)):
            assert abs(got[g][name] - float(np.quantile(xs, q))) < 1e-9
    whole = exact_quantiles(df, [], "x", {"m": 0.5}).first().m
    assert abs(whole - float(np.median([r.x for r in df.collect()]))) < 1e-9


def test_exact_quantiles_of_one_common_value(spark, monkeypatch):
    """A value that holds 90% of the rows reaches the ranking as one row; NULL
    keys and values, and an empty table, have a defined result."""
    import numpy as np
    from pyspark.sql import functions as F

    from runlens.operators import common

    df = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, F.lit("g")).alias("g"),
        F.when(F.col("id") % 10 != 1, F.lit(7.0)).when(F.col("id") > 100, F.col("id").cast("double")).alias("x"))
    ranked = []
    plain = common.running_sums
    monkeypatch.setattr(common, "running_sums", lambda d, *a: ranked.append(d.count()) or plain(d, *a))
    qs = {"q1": 0.01, "q50": 0.5, "q99": 0.99}
    got = {r.g: r for r in common.exact_quantiles(df, ["g"], "x", qs).collect()}
    assert ranked == [df.dropna(subset=["x"]).distinct().count()]
    rows = df.collect()
    for g in ("g", None):
        xs = [r.x for r in rows if r.g == g and r.x is not None]
        for name, q in qs.items():
            assert abs(got[g][name] - float(np.quantile(xs, q))) < 1e-9
    assert common.exact_quantiles(df.limit(0), ["g"], "x", qs).count() == 0
    assert common.exact_quantiles(df.limit(0), [], "x", qs).first().q50 is None


def test_fanout_join_with_hot_run_equals_plain_join(spark):
    from runlens.operators.runs import runs_with_metrics

    runs = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3)], "id string, x long")
    rows = [("r1", i, False, 0.5, i, "") for i in range(50)] + [("r2", 1, True, 0.9, 3, "e")]
    metrics = spark.createDataFrame(rows, "run_id string, parsing_attempts long, fallback_used boolean, "
                                          "confidence_score double, extraction_time_ms long, error_details string")
    split = runs_with_metrics(runs, metrics)  # r1 is hot
    # the metric rows are joined by an inner join (either side can be split), never on the right of an outer join
    logical = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in logical and "Join LeftAnti" in logical and "Outer" not in logical
    plain = runs.join(metrics, runs["id"] == metrics["run_id"], "left")
    assert split.count() == plain.count() == 52
    got = sorted((r.id, r.parsing_time_ms) for r in split.collect())
    want = sorted((r.id, r.extraction_time_ms) for r in plain.collect())
    assert got == want
