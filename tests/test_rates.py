"""Call ceilings over any second, against a sweep over the sorted times."""

import datetime as dt
import random

from pyspark.sql import functions as F

from runlens.operators.datasets import sample_seeded
from runlens.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1, 0, 0, 59)


def test_sliding_counts_equal_a_sweep(spark):
    r = random.Random(3)
    rows = [(r.choice(["cohere", "openrouter", None]), T0 + dt.timedelta(microseconds=r.choice([r.randrange(4_000_000), 500_000 * r.randrange(8), 999_999, 1_000_000])))
            for _ in range(400)] + [("cohere", None), ("anthropic", dt.datetime(1969, 12, 31, 23, 59, 59, 999_999)), ("anthropic", dt.datetime(1970, 1, 1))]
    for seconds in (1, 2):
        got = {(x.provider, x.window_end): (x.calls, x.over_limit) for x in ST.sliding_rate_audit(
            spark.createDataFrame(rows, "provider string, ts timestamp_ntz").repartition(4), seconds).withColumn("window_end", F.col("window_end").cast("timestamp_ntz")).collect()}
        want = {}
        for p, t in rows:
            if t is not None:
                n = sum(q == p and u is not None and t - dt.timedelta(seconds=seconds) < u <= t for q, u in rows)
                want[p, t] = (n, n / seconds > ST.PROVIDER_CEILINGS.get(p, ST.DEFAULT_CEILING))
        assert got == want


def test_a_burst_over_a_window_edge_is_seen(spark):
    rows = [("openrouter", T0 + dt.timedelta(milliseconds=m)) for m in (800, 900, 1100, 1200)]  # two calls in each tumbling second
    got = ST.sliding_rate_audit(spark.createDataFrame(rows, "provider string, ts timestamp_ntz")).collect()
    assert max(x.calls for x in got) == 4 and any(x.over_limit for x in got)


def test_sample_has_n_rows_with_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(i % 5 if i % 7 else None, i) for i in range(60)], "id int, v int")
    got = [tuple(r) for r in sample_seeded(df.repartition(5), 20, "id").collect()]
    assert len(got) == 20 and got == [tuple(r) for r in sample_seeded(df.repartition(2), 20, "id").collect()]
    assert sample_seeded(df, 100, "id").count() == 60
