"""What the driver holds: a bounded share of the training texts, and no stages for small graphs that one task can settle."""

import tracemalloc

import numpy as np
import pyarrow as pa

from runlens.llm import jobs, textblocks, toxicity


def _texts(rows: int) -> list[str]:
    r = np.random.default_rng(6)
    words = np.array([f"Word{i}," for i in range(5000)])
    return ["", "é, ß"] + [" ".join(words[r.integers(0, len(words), 300)]) for _ in range(rows)]


def test_training_takes_a_small_share_of_the_driver(monkeypatch):
    monkeypatch.setattr(textblocks, "_powers", {})
    texts = _texts(900)  # about 2.5 MB
    tracemalloc.start()
    try:
        toxicity.train(texts, [i % 2 for i in range(len(texts))])
        left, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 60e6, peak  # as one block: 129 MB
    assert left < 15e6, left  # as one block: 43 MB, tables of its length stayed


def test_small_and_large_graphs_settle_alike(spark, monkeypatch):
    r = np.random.default_rng(8)
    edges = spark.createDataFrame(r.integers(0, 60, (45, 2)).tolist() + [[3, 3]], "u long, v long")
    small = sorted(map(tuple, jobs.components(edges).collect()))
    monkeypatch.setattr(jobs, "EDGES", 10)
    assert sorted(map(tuple, jobs.components(edges).collect())) == small and len(small) > 20


def test_words_of_blocks_are_those_of_one_block():
    column = pa.array(_texts(900), pa.large_string())
    (whole,) = textblocks.blocks(column, 1 << 62)
    parts = list(textblocks.blocks(column, 1 << 16))
    assert len(parts) > 3
    one, many = toxicity.Words(whole), toxicity.Words(*parts)
    for name in ("rows", "which", "first", "grams", "size", "split"):
        assert np.array_equal(getattr(one, name), getattr(many, name)), name


def test_a_round_over_a_small_graph_needs_no_exchange(spark, monkeypatch):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    cut_lineage = jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", cut)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(jobs.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert len(plans) > 2
    assert not [p for p in plans[1:] if "Exchange hashpartitioning" in p]
