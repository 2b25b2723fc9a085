"""Dataset-level operators: split choice, catalog, info, cycling, head, seeded
sample, question-set union and schema evolution (2.1, 2.6, 2.7)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import combine_rows, global_index, maybe_broadcast
from .profile import first_rows


def resolve_split(df: DataFrame, split_col: str = "split", keys: Iterable[str] = ("dataset_name",)) -> DataFrame:
    """Rows of the chosen split of each dataset: train, else test, else the
    first available (by name)."""
    keys = list(keys)
    s = F.col(split_col)
    prio = F.when(s == "train", 0).when(s == "test", 1).otherwise(2)
    chosen = df.groupBy(*keys).agg(F.min(F.struct(prio.alias("p"), s.alias("s"))).alias("_c")).select(
        *keys, F.col("_c.s").alias("_chosen")
    )
    j = df.join(maybe_broadcast(chosen), keys)
    return j.filter(F.col(split_col) == F.col("_chosen")).drop("_chosen")


def catalog_list(*sources: DataFrame) -> DataFrame:
    """Distinct sorted union of benchmark ids from several sources (first column
    of each)."""
    cols = [s.select(s[s.columns[0]].cast("string").alias("benchmark_id")) for s in sources]
    out = cols[0]
    for c in cols[1:]:
        out = out.unionByName(c)
    return out.distinct().orderBy("benchmark_id")


def dataset_info(df: DataFrame, key: str, n_sample: int = 3) -> DataFrame:
    """One row: row count, column names and types, whether INPUT and OUTPUT are
    present, and the first ``n_sample`` rows (by ``key``) as JSON."""
    names = df.columns
    types = [t for _, t in df.dtypes]
    has_io = "INPUT" in names and "OUTPUT" in names
    head = first_rows(df, key, n_sample).select(F.to_json(F.struct(*names)).alias("j"), F.col(key).alias("_k"))
    sample = head.agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "j"))), lambda x: x["j"]).alias("sample_data"))
    count = df.agg(F.count(F.lit(1)).alias("num_rows"))
    return combine_rows(count, sample).select(
        "num_rows",
        F.array(*[F.lit(n) for n in names]).alias("columns"),
        F.array(*[F.lit(t) for t in types]).alias("types"),
        F.lit(has_io).alias("has_input_output"),
        "sample_data",
    )


def cycle_to_n(df: DataFrame, n: int, order_col: str, id_prefix: str) -> DataFrame:
    """Grow a table to ``n`` rows by cycling through it in ``order_col`` order;
    row i copies base row i % count and gets id ``<prefix>_<i+1, 3 digits>``.

    ``spark.range(n)`` is equi-joined to the position-numbered base on
    ``i % count``: a shuffle join, no driver loop, no single-task window."""
    spark = df.sparkSession
    base = global_index(df, [F.col(order_col)], "_pos")
    count = base.count()
    if count == 0:
        raise ValueError("cannot cycle an empty table")
    grid = spark.range(n).select(F.col("id").alias("_i"), (F.col("id") % count).alias("_pos"))
    out = grid.join(base, "_pos")
    return out.withColumn("id", F.format_string(f"{id_prefix}_%03d", F.col("_i") + 1)).drop("_pos")


def head_n(df: DataFrame, n: int, order: list) -> DataFrame:
    """First ``n`` rows by ``order`` (ascending column names or Columns).

    A per-partition top-n and one merge; rows with NULL keys come first, as
    in any ascending order."""
    return df.orderBy(*order).limit(n)


def sample_seeded(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` pseudo-random rows, the same on every run for a seed: ordered by
    md5(id || '-' || seed), then id.  Rows are picked, not ids: repeated ids are
    rows of their own (told apart by their other columns), a NULL id is an empty
    text.  Whole table when n >= size; n <= 0 is an error.  (Not the reference's
    rows: its shuffle is numpy's.)"""
    if n <= 0:
        raise ValueError("Sample size must be positive")
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"-{seed}")))
    rest = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]  # maps have no hash
    return df.orderBy(h, F.col(id_col), F.xxhash64(*rest)).limit(n)


def union_question_sets(sets: dict[str, DataFrame], chosen: Iterable[str], order_col: str,
                        id_prefix: str = "LOCAL_TEST") -> DataFrame:
    """Concatenate the chosen question sets in the given order, then number ids
    ``<prefix>_<i+1, 3 digits>`` in that concatenated order."""
    chosen = list(chosen)
    parts = [sets[name].withColumn("_set", F.lit(i)).withColumn("category", F.lit(name)) for i, name in enumerate(chosen)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    numbered = global_index(u, [F.col("_set"), F.col(order_col)], "_i")
    return numbered.withColumn("id", F.format_string(f"{id_prefix}_%03d", F.col("_i") + 1)).drop("_set", "_i")


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as typed NULLs."""
    have = set(df.columns)
    for f in schema.fields:
        if f.name not in have:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def evolve_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an older table (missing columns as NULL) together with the new
    table's rows, in the new column order."""
    return new.unionByName(add_missing_columns(old, new.schema).select(*new.columns))
