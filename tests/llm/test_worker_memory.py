"""What a Python worker holds: one small block at a time, and nothing of the operators whose tasks it ran before."""

import tracemalloc

import numpy as np
import pyarrow as pa

from runlens.llm import jaccard, jobs, textblocks, units


def _batch() -> pa.RecordBatch:
    r = np.random.default_rng(5)
    words = np.array([f"word{i}" for i in range(5000)])
    texts = [" ".join(words[r.integers(0, len(words), 600)]) for _ in range(900)]  # about 5 MB
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])


def test_shingling_a_batch_takes_a_small_share_of_an_executor(monkeypatch):
    monkeypatch.setattr(textblocks, "_powers", {})
    batch = _batch()
    tracemalloc.start()
    try:
        for _ in jaccard._sets(batch, 5):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50e6  # with blocks of 2 MB: 112 MB


def test_sets_do_not_depend_on_the_blocks():
    batch = _batch().slice(0, 300)
    (whole,) = textblocks.blocks(batch.column("text"), 1 << 62)
    words, first = textblocks.words_of(whole)
    seen = 0
    for doc, tokens in jaccard._sets(batch, 5):
        assert np.array_equal(tokens, textblocks.shingles_of(words[first[doc] : first[doc + 1]], 5))
        seen += 1
    assert seen == 300 and sum(1 for _ in textblocks.blocks(batch.column("text"))) > 1


def test_a_task_drops_what_other_operators_kept(monkeypatch):
    monkeypatch.setattr(units, "_memos", {})
    assert units.shared_memo("packing", lambda: [1]) is units.shared_memo("packing", lambda: [2])
    jobs.tidy_worker()
    assert units._memos == {}
    assert units.shared_memo("packing", lambda: [3]) == [3]


def test_rows_read_at_once_are_bounded_and_smaller_settings_stay(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    old = spark.conf.get(key)
    try:
        for asked, held in ((4096, jobs.BATCH_ROWS), (64, 64)):
            spark.conf.set(key, asked)
            jobs.prepare(spark)
            assert int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, old)
