"""Registered queries for what is kept up to date: summaries after upserts (2.4), keyed tables (2.13, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import live as L
from ..operators.maintain import results_to_runs
from ..session import cut_lineage, scratch_path
from ..sources.keyed import KeyedTable
from ..streaming import streams as ST
from .maintain_plans import RESULTS_SQL, RUN_COLS, _results
from .registry import REGISTRY, query

VIEWS = ("runs_v", "responses_v", "parsing_metrics_v", "experiments_v")

# the tables after the upsert: results replace runs, runs with an index divisible by 7 get one more metric row
_AFTER = f"""
WITH {RESULTS_SQL.strip()},
u AS (SELECT {RUN_COLS} FROM runs_v WHERE id NOT IN (SELECT id FROM res) UNION ALL SELECT {RUN_COLS} FROM res),
um AS (SELECT run_id, confidence_score FROM parsing_metrics_v
       UNION ALL SELECT id, CAST(0.9 AS DOUBLE) FROM u WHERE sample_index % 7 = 0)"""


def _recomputed(key: str) -> str:
    """The full recompute of a summary, over the tables after the upsert."""
    sql = REGISTRY[key].oracle.strip().replace("parsing_metrics_v", "um").replace("runs_v", "u")
    return f"{_AFTER},\n{sql[4:]}" if sql[:4].upper() == "WITH" else f"{_AFTER}\n{sql}"


def _partials(fx):
    """Partials of the tables as they are, then an upsert of results, then more metric rows."""
    runs = fx.runs_v.select(*[c.strip() for c in RUN_COLS.split(",")])
    stored = cut_lineage(L.summary_partials(runs, fx.parsing_metrics_v))
    metrics = fx.parsing_metrics_v.select("run_id", "confidence_score")
    runs, metrics, stored = L.upsert_with_partials(runs, metrics, stored, results=_results(fx))
    more = runs.where("sample_index % 7 = 0").select(F.col("id").alias("run_id"), F.lit(0.9).alias("confidence_score"))
    return L.upsert_with_partials(runs, metrics, cut_lineage(stored), new_metrics=more)[2]


@query("experiment_summary_upserted", VIEWS, section="2.4", oracle=_recomputed("experiment_summary"))
def _q(fx):
    return L.live_experiment_summary(_partials(fx), fx.experiments_v)


@query("compare_approaches_upserted", VIEWS, section="2.4", oracle=_recomputed("compare_approaches"))
def _q(fx):
    return L.live_comparison(_partials(fx))


UPSERTED_RUNS = f"""
WITH {RESULTS_SQL.strip()}
SELECT {RUN_COLS} FROM runs_v WHERE id NOT IN (SELECT id FROM res)
UNION ALL SELECT {RUN_COLS} FROM res
"""


@query("upsert_runs_keyed", ["runs_v", "responses_v"], section="2.13", oracle=UPSERTED_RUNS)
def _q(fx):
    """Runs in a keyed table of several files, results upserted: only files that hold a key are replaced."""
    cols = [c.strip() for c in RUN_COLS.split(",")]
    table = KeyedTable(fx.spark, scratch_path(fx.spark, "keyed"), ["id"], file_rows=20_000)
    table.upsert(fx.runs_v.select(*cols))
    table.upsert(results_to_runs(_results(fx)).select(*cols), ["created_at"])
    return table.read().select(*cols)


@query("stream_ingest_keyed", ["runs_v", "responses_v"], section="2.14", oracle=UPSERTED_RUNS)
def _q(fx):
    """The same by a stream of three appends."""
    cols = [c.strip() for c in RUN_COLS.split(",")]
    base, results = scratch_path(fx.spark, "keyedstream"), _results(fx)
    table = KeyedTable(fx.spark, f"{base}/table", ["id"], file_rows=20_000)
    table.upsert(fx.runs_v.select(*cols))
    for i in range(3):
        results.filter(F.col("sample_index") % 3 == i).write.mode("append").parquet(f"{base}/source")
    writer = ST.ingest_runs_keyed(fx.spark, f"{base}/source", results.schema, _Columns(table, cols), f"{base}/ckpt", max_files_per_trigger=8)
    ST.run_available(writer)
    return table.read().select(*cols)


class _Columns:
    """A keyed table that takes some of a batch's columns."""

    def __init__(self, table: KeyedTable, columns: list[str]):
        self.table, self.columns = table, columns

    def upsert(self, rows, order=None, tag=None):
        return self.table.upsert(rows.select(*self.columns), order, tag)
