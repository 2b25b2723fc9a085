"""Keyed tables against last-write-wins, and which files an upsert touches."""

import os
import random

import numpy as np
import pytest

from runlens.session import scratch_path
from runlens.sources import keyed as K


def _table(spark, name="keyed", **more):
    return K.KeyedTable(spark, scratch_path(spark, name), ["id"], **more)


def test_bloom_filter_never_misses():
    r = np.random.default_rng(2)
    h = r.integers(-(1 << 63), (1 << 63) - 1, 5000)
    bloom = K.bloom_of(h, 1 << 16)
    assert K.bloom_holds(bloom, h).all()
    assert K.bloom_holds(bloom, r.integers(-(1 << 63), (1 << 63) - 1, 5000)).mean() < 0.02


def test_upserts_equal_last_write_wins(spark):
    r, want = random.Random(4), {}
    t = _table(spark, file_rows=40)
    schema = "id string, v int, at int"
    assert t.read() is None
    for step in range(4):
        rows = [(f"k{r.randrange(200)}", r.randrange(1000), i) for i in range([300, 60, 3, 80][step])] + [(None, step, 0)]
        t.upsert(spark.createDataFrame(rows, schema), ["at"])
        want.update({k: (k, v, i) for k, v, i in rows if k})
        got = t.read()
        assert got.columns == ["id", "v", "at"]
        assert sorted(map(tuple, got.where("id is not null").collect())) == sorted(want.values())
        assert got.where("id is null").count() == step + 1  # a NULL key replaces nothing
    assert all(not os.path.exists(f"{t.base}/{p}") or p.startswith("data/commit=") for p in t.unused())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_files_that_cannot_hold_a_key_are_not_read(spark, kind):
    t = _table(spark, file_rows=1000)
    base = spark.range(-5000, 5000).selectExpr(f"cast(id as {kind}) as id", "1 as v")
    assert t.upsert(base) == {"read": [], "replaced": []}
    assert t.files().count() == 10
    near = spark.range(100, 110).selectExpr(f"cast(id as {kind}) as id", "2 as v")
    before = {r.path: r for r in t.files().collect()}
    one = t.upsert(near)
    assert len(one["replaced"]) <= 2 and set(one["read"]) >= set(one["replaced"]) and len(one["read"]) <= 3
    after = {r.path for r in t.files().collect()}
    assert set(before) - after == set(one["replaced"])  # all other files stay as they are
    assert t.read().count() == 10_000 and t.read().where("v = 2").count() == 10
    # keys that no file holds: inside every range of the first commit for long keys, but in no filter
    new = spark.range(3).selectExpr(f"cast(id * 2 + 20001 as {kind}) as id", "3 as v")
    assert t.upsert(new)["replaced"] == []
    # the newest commit's keys touch the newest commit's files alone
    again = t.upsert(new)
    assert len(again["replaced"]) == 1 and t.read().count() == 10_003


def test_ranges_in_several_groups_give_the_same_files(spark):
    t = _table(spark, file_rows=100)
    for i in range(4):
        t.upsert(spark.range(i * 300, i * 300 + 400).selectExpr("id", f"{i} as v"))
    keys = spark.createDataFrame([(5,), (777,)], "id long")
    ask = keys.select(t._hash().alias("h"), t._place(keys).alias("place"))
    files = t.candidates(ask)
    spark.conf.set("spark.runlens.smallBytes", "0")
    try:
        assert t.candidates(ask) == files and 2 <= len(files) < t.files().count() / 2
    finally:
        spark.conf.unset("spark.runlens.smallBytes")


def test_a_tagged_commit_is_done_once(spark):
    t = _table(spark)
    one = spark.createDataFrame([("a", 1)], "id string, v int")
    t.upsert(one, tag="x")
    t.upsert(spark.createDataFrame([("a", 2)], one.schema), tag="x")
    t.upsert(one.limit(0), tag="y")
    assert t.read().collect()[0].v == 1
    assert {r.tag for r in t.files().collect()} == {"x", "y"}
    t.upsert(spark.createDataFrame([("a", 3)], one.schema), tag="z")
    assert [r.v for r in t.read().collect()] == [3] and not t.files().where("tag = 'y'").isEmpty()


def test_keys_of_two_columns(spark):
    t = K.KeyedTable(spark, scratch_path(spark, "two"), ["e", "n"], file_rows=50)
    t.upsert(spark.range(200).selectExpr("cast(id % 2 as string) as e", "id as n", "0 as v"))
    t.upsert(spark.createDataFrame([("1", 7, 9), ("0", 7, 9)], "e string, n long, v int"))
    got = t.read()
    assert got.count() == 201 and sorted((r.e, r.n) for r in got.where("v = 9").collect()) == [("0", 7), ("1", 7)]
