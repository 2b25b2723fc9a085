"""Small shared helpers for operators: size-checked broadcast, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sides whose size bound is at most this many bytes may be broadcast.  A session
# can change it with spark.runlens.smallBytes (0: no broadcast hints).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def small_bytes(spark) -> int:
    return int(spark.conf.get("spark.runlens.smallBytes", str(BROADCAST_MAX_BYTES)))


def size_bound(df: DataFrame) -> int:
    """Upper bound of the data size from the optimized plan's statistics (file
    sizes propagated through the plan; filters and aggregates never raise it).
    Nothing is executed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its planned size bound is small; otherwise
    leave the strategy to Spark (sort-merge join, or AQE's runtime switch)."""
    limit = small_bytes(df.sparkSession) if max_bytes is None else max_bytes
    return F.broadcast(df) if size_bound(df) <= limit else df


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Put single-row results side by side without a join: union them (each
    with the other frames' columns NULL) and keep the one non-NULL value of
    every column."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    return u.agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in cols])


def ratio(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def flag(cond: Column) -> Column:
    """1.0 when ``cond`` is true, else 0.0 (NULL counts as 0.0)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def iflag(cond: Column) -> Column:
    """1 when ``cond`` is true, else 0 (long)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stat_r(x: str | Column, y: str | Column) -> Column:
    """Pearson r as covar_pop / (stddev_pop x * stddev_pop y); NULL for constants.

    ``corr`` raises on a zero variance under ANSI mode, so build r by hand.
    """
    den = F.stddev_pop(_c(x)) * F.stddev_pop(_c(y))
    return F.try_divide(F.covar_pop(_c(x), _c(y)), F.when(den != 0, den))


def global_index(df: DataFrame, order_cols: list | None = None, name: str = "_idx", checkpoint: bool = True) -> DataFrame:
    """0-based position of every row in a total order, computed distributed.

    A range-partitioned sort puts the rows in order across partitions; each
    row's position is its partition's offset (a running sum over one count per
    partition: a table bounded by the partition count, so it is broadcast)
    plus its position inside the partition.  No single-partition window.
    The sorted data is checkpointed into the shared checkpoint dir first, so the
    partition numbering the offsets refer to is fixed and survives executor
    loss.  Without ``order_cols`` the current row order (file order) is used.
    """
    from pyspark.sql import Window

    from ..session import cut_lineage

    s = df.orderBy(*order_cols) if order_cols else df
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = s.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long")).drop(
        "_pid", "_mid", "_m0", "_off"
    )


def running_sums(
    df: DataFrame,
    part: list[str],
    order: list,
    values: dict[str, Column],
    include_current: bool = False,
    num_partitions: int | None = None,
) -> DataFrame:
    """Running sums of ``values`` per ``part`` group in ``order``, spread over
    many tasks even when one group holds most rows.

    A range-partitioned sort on (part, order) gives every task a contiguous
    slice of the ordered rows, so a hot group is cut across tasks.  The sums of
    each (group, task) slice - at most #groups + #tasks rows - get their
    offsets from a window over the slices of a group; the running sum inside a
    slice is a window bounded by the task's size.  The sorted data is
    checkpointed (shared checkpoint dir) so slice ids stay fixed on retries.
    Inputs of every size take this one path.
    """
    from pyspark.sql import Window

    from ..session import cut_lineage

    end = 0 if include_current else -1
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df
    for name, v in values.items():
        d = d.withColumn(f"_v_{name}", v)
    d = d.repartitionByRange(n, *[F.col(c) for c in part], *order).withColumn("_pid", F.spark_partition_id())
    d = cut_lineage(d)
    tot = d.groupBy(*part, "_pid").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    w1 = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*part, "_pid", *[F.coalesce(F.sum(f"_t_{k}").over(w1), F.lit(0)).alias(f"_o_{k}") for k in values])
    j = d.join(maybe_broadcast(off), [*part, "_pid"])
    w2 = Window.partitionBy(*part, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    for k in values:
        j = j.withColumn(k, F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(w2), F.lit(0)))
    return j.drop("_pid", *[f"_v_{k}" for k in values], *[f"_o_{k}" for k in values])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics, as
    pandas and ``quantile_cont``) of ``value`` per ``keys`` group.

    No task holds a group: equal values are counted first (partial
    aggregation, so a value that most rows share is one row), the distinct
    values get the ranks they cover from ``running_sums`` (range-sliced), only
    those a quantile needs are kept, and a small aggregate interpolates.  NULLs
    are ignored; a group without values has no row, except that without
    ``keys`` there is always one row."""
    keys = list(keys)
    v = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    c = v.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")).withColumn("_g", F.struct(F.lit(0), *keys))
    ranked = running_sums(c, ["_g"], [F.col("_x")], {"_r": F.col("_c")})
    sizes = ranked.groupBy("_g").agg(F.sum("_c").alias("_n"))
    # one row a group; without keys that is a single row
    j = ranked.join(maybe_broadcast(sizes) if keys else F.broadcast(sizes), "_g")
    pos = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in qs.items()}

    def covers(rank: Column) -> Column:
        return (F.col("_r") <= rank) & (rank < F.col("_r") + F.col("_c"))

    wanted = F.lit(False)
    for p in pos.values():
        wanted = wanted | covers(F.floor(p)) | covers(F.ceil(p))
    aggs = []
    for name, p in pos.items():
        lo = F.max(F.when(covers(F.floor(p)), F.col("_x")))
        hi = F.max(F.when(covers(F.ceil(p)), F.col("_x")))
        frac = F.max(p - F.floor(p))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return j.filter(wanted).groupBy(*keys).agg(*aggs)
