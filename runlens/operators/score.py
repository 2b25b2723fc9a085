"""Batch scoring with a caller's function (2.15).

``score_table`` runs the caller's ``fn(prompt) -> answer`` over the work grid
with ``mapInPandas``: Arrow batches in, Arrow batches out, so the function is
the only per-row Python.  A row whose call raises becomes an error row and the
rest go on; the time of every call is recorded.  The grid is spread over tasks
by its own partitioning (repartition the grid on the sample key to spread a
large grid evenly), and a lost executor re-runs its partitions only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCORE_FIELDS = [
    T.StructField("answer", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed", T.DoubleType()),
]


def score_table(grid: DataFrame, fn: Callable[[str], str], prompt_col: str = "prompt",
                keep: list[str] | None = None) -> DataFrame:
    """Apply ``fn`` to each row's prompt; adds ``answer``, ``error`` (NULL when
    the call succeeded) and ``elapsed`` seconds."""
    keep = list(keep) if keep is not None else [c for c in grid.columns]
    if prompt_col not in keep:
        keep_in = keep + [prompt_col]
    else:
        keep_in = keep
    src = grid.select(*keep_in)
    out_schema = T.StructType([src.schema[c] for c in keep] + SCORE_FIELDS)
    from ..session import ship_package

    ship_package(grid.sparkSession)  # workers can import the caller's function's package

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors, elapsed = [], [], []
            for prompt in pdf[prompt_col].tolist():
                t0 = time.perf_counter()
                try:
                    a = fn(prompt)
                    answers.append(None if a is None else str(a))
                    errors.append(None)
                except Exception as e:  # the row becomes an error row
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                elapsed.append(time.perf_counter() - t0)
            out = pdf[keep].copy()
            out["answer"] = answers
            out["error"] = errors
            out["elapsed"] = elapsed
            yield out

    return src.mapInPandas(run, schema=out_schema)


def split_results(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of a scored grid.  The scored rows are checkpointed
    into the shared checkpoint dir first, so both parts, however often they are
    read, come from one call of the caller's function per row."""
    from pyspark.sql import functions as F

    from ..session import cut_lineage

    scored = cut_lineage(scored)
    return scored.filter(F.col("error").isNull()), scored.filter(F.col("error").isNotNull())


def evaluate_grid(samples: DataFrame, approaches: list[str], fn: Callable[[str], str], id_col: str = "id",
                  question_col: str = "INPUT", expected_col: str = "OUTPUT") -> DataFrame:
    """The run stage as one job: grid of samples x approaches, prompts from the
    approach templates, the caller's function, regex answer extraction and the
    strict verdict.  Returns one row per (sample, approach) with the answer,
    the error (a failed call keeps its row), the time and the verdict."""
    from pyspark.sql import functions as F

    from ..functions.extract import extract_answer, is_correct_strict, render_prompts
    from ..session import cut_lineage
    from .runs import sample_approach_grid

    grid = sample_approach_grid(samples.select(id_col, question_col, expected_col), approaches)
    prompts = render_prompts(grid, question_col=question_col)
    # checkpointed: reading the result twice must not call the function again
    scored = cut_lineage(score_table(prompts, fn, keep=[id_col, "approach", question_col, expected_col, "prompt"]))
    ex = extract_answer(scored.withColumn("_raw", F.coalesce(F.col("answer"), F.lit(""))), text_col="_raw")
    return ex.select(
        id_col,
        "approach",
        F.col(question_col).alias("input_text"),
        F.col(expected_col).cast("string").alias("expected_answer"),
        F.col("answer").alias("raw_output"),
        F.when(F.col("error").isNull(), F.col("final_answer")).alias("parsed_answer"),
        F.when(F.col("error").isNull(), F.col("confidence")).alias("parsing_confidence"),
        F.when(F.col("error").isNull(), F.col("extraction_method")).alias("parsing_method"),
        F.when(F.col("error").isNull(), is_correct_strict(F.col("final_answer"), F.col(expected_col))).alias("is_correct"),
        (F.col("elapsed") * 1000).cast("long").alias("execution_time_ms"),
        "error",
    )
