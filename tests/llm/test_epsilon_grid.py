"""The epsilon grid join: disk by the rows and not by the block pairs; blocks, weights and labels against brute force."""

import json
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from runlens.llm import epsgrid

SHUFFLED = """
import sys, time
import numpy as np
from pyspark.sql import SparkSession

out = sys.argv[1]
conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": out + "/kept",
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": out + "/events", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
from runlens.llm import epsgrid

epsgrid.BLOCK = 64
for n in (1500, 6000):
    x = np.random.default_rng(n).standard_normal((n, 64)).astype("f4")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{out}/in-{n}")
    began = time.time()
    assert epsgrid.near_duplicates(spark.read.parquet(f"{out}/in-{n}")).where("n_links = 0 and kept").count() == n
    print("RAN", n, began, time.time())
spark.stop()
"""


def test_shuffle_grows_with_rows_not_with_block_pairs(tmp_path):
    (tmp_path / "events").mkdir()
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", SHUFFLED, str(tmp_path)], cwd=repo, env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    times = [line.split()[1:] for line in run.stdout.splitlines() if line.startswith("RAN")]
    shuffled = {int(n): 0 for n, _, _ in times}
    for path in (tmp_path / "events").iterdir():
        for line in path.open():
            if '"SparkListenerTaskEnd"' in line:
                e = json.loads(line)
                for n, began, ended in times:
                    if float(began) <= e["Task Info"]["Launch Time"] / 1000 <= float(ended):
                        shuffled[int(n)] += e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    assert 0 < shuffled[6000] < 6 * shuffled[1500]
    assert shuffled[6000] < 3 * 6000 * 64 * 4


def _brute(rows, cosine=0.95):
    """Of rows (id, vector): links and least id reachable; rows of one id are one node, as in the SQL."""
    x = np.array([e for _, e in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    s = (x @ x.T >= cosine * np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))) & ~np.eye(len(x), dtype=bool)
    near = s | (ids[:, None] == ids[None, :])
    label = ids
    while not np.array_equal(label, new := np.where(near, label[None, :], 1 << 60).min(1)):
        label = new
    return s.sum(1), label


@pytest.mark.parametrize("streams", [1, 3])
def test_many_blocks_and_streams_match_brute_force(spark, monkeypatch, streams):
    for name, value in (("BLOCK", 16), ("PART_BLOCKS", 3), ("STREAMS", streams), ("TASK_ROWS", 8)):
        monkeypatch.setattr(epsgrid, name, value)
    r = np.random.default_rng(3)
    x = r.standard_normal((420, 24))
    x[:150] = x[0] + 0.05 * r.standard_normal((150, 24))  # one group over many blocks
    for i in range(151, 190):  # a chain: neighbours are linked, ends are not
        x[i] = x[i - 1] + 0.2 * r.standard_normal(24)
    x[200:320] = x[200]  # copies, over several Arrow batches
    x[320:330] = 3 * x[321]  # the same direction, another length
    x = x.astype(np.float32)
    ids = r.permutation(len(x)).tolist()
    rows = list(zip(ids, x.tolist()))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old, slots = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set(key, 32)
        spark.conf.set("spark.sql.shuffle.partitions", 3)
        got = {(v.vec_id, v.n_links, v.component_id, v.kept) for v in epsgrid.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    finally:
        spark.conf.set(key, old)
        spark.conf.set("spark.sql.shuffle.partitions", slots)
    links, label = _brute(rows)
    assert got == {(i, n, c, c == i) for i, n, c in zip(ids, links.tolist(), label.tolist())}


def test_repeated_rows_ids_and_lengths(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(7, a), (7, a), (3, a), (9, [1.0]), (5, b), (4, c), (4, c), (4, c), (6, [-0.0, 0.0, 2.0])]
    got = Counter(tuple(v) for v in epsgrid.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    links, label = _brute([(i, v + [0.0] * (3 - len(v))) for i, v in rows])
    assert got == Counter((i, n, m, m == i) for (i, _), n, m in zip(rows, links.tolist(), label.tolist()))


@pytest.mark.parametrize("merge", [1, 4096])
def test_block_pairs_match_brute_force(monkeypatch, merge):
    monkeypatch.setattr(epsgrid, "MERGE", merge)
    monkeypatch.setattr(epsgrid, "LEAF", 8)
    r = np.random.default_rng(1)
    x = r.standard_normal((260, 30))
    x[20:160] = x[20] + 0.12 * r.standard_normal((140, 30))
    x = x.astype(np.float32)
    axes, _ = np.linalg.qr(r.standard_normal((30, 30)))
    eps2 = 2 - 2 * 0.95 + 1e-9
    copies = r.integers(1, 5, 260)
    x, copies = x[order := np.lexsort(epsgrid._cells(epsgrid._units(x)[0], axes, eps2**0.5).T[::-1])], copies[order]
    for n in (260, 100, 7):  # of one block with itself, then of two
        one = epsgrid._Block(np.arange(n), copies[:n], x[:n], np.ascontiguousarray(axes[:, : epsgrid.SIEVE]))
        two = one if n == 260 else epsgrid._Block(np.arange(n, 260), copies[n:], x[n:], np.ascontiguousarray(axes[:, : epsgrid.SIEVE]))
        u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        s = (u @ u.T >= 0.95) & ~np.eye(260, dtype=bool)
        if n < 260:
            s[:n, :n] = s[n:, n:] = False
        links, root = epsgrid._linked(one, two, n == 260, 0.95, eps2)
        assert np.array_equal(links, s @ copies) and (links.any() or n == 7)
        label = np.arange(260)
        while not np.array_equal(label, new := np.minimum(label, np.where(s, label[None, :], 260).min(1))):
            label = new
        assert np.array_equal(root, label)
        if n == 260:
            pairs = list(epsgrid._leaf_pairs(one, one, eps2, True))
            assert len(pairs) == len(set(pairs)) and all(a <= b for a, b in pairs)


def test_equal_vectors_have_equal_cells_whatever_stands_beside_them():
    r = np.random.default_rng(2)
    x = r.standard_normal((1000, 64)).astype(np.float32)
    x[:64] = np.eye(64)  # projections that are zero but for rounding
    axes, _ = np.linalg.qr(r.standard_normal((64, 64)))
    cells = epsgrid._cells(epsgrid._units(x)[0], axes, 0.3)
    for part in (slice(0, 1), slice(3, 50), slice(7, 1000)):
        assert np.array_equal(epsgrid._cells(epsgrid._units(x[part])[0], axes, 0.3), cells[part])
