"""CSV and JSON lists read by many tasks, against Spark's one-task readers."""

import json
import os
import random

import pytest

from runlens.session import scratch_path
from runlens.sources import io as IO
from runlens.sources import splitscan as SS


@pytest.fixture()
def tiny_splits(spark):
    """Splits of a few dozen bytes, one partition each."""
    keys = {"spark.sql.files.maxPartitionBytes": "90", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _folder(spark, name):
    d = scratch_path(spark, name)
    os.makedirs(d, exist_ok=True)
    return d


def _write(path, text):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)


def _cell(r):
    kind = r.randrange(6)
    text = "".join(r.choices(["a", "é", "7", " ", "日", "x" * 30], k=r.randint(0, 4)))
    if kind < 3:
        inner = "".join(r.choices(["\n", "\r\n", '""', ",", text, "\n\n", '"",""'], k=r.randint(0, 5)))
        return f'"{inner}"'
    if kind == 3:
        return '5" ' + text  # a quote inside an unquoted cell
    return text


def _multiline(spark, path, schema):
    return spark.read.options(**IO._csv_options()).option("header", True).schema(schema).csv(path)


def test_csv_equals_the_one_task_reader_in_order(tiny_splits):
    spark, r = tiny_splits, random.Random(8)
    d = _folder(spark, "csvsplit")
    for i in range(5):
        end = r.choice(["\n", "\r\n"])
        rows = [",".join(_cell(r) for _ in range(r.choice([1, 2, 3, 3, 3, 4]))) for _ in range(60)]
        _write(f"{d}/f{i}.csv", end.join(['"a",b,"c"', *[x for x in rows if x]]) + r.choice(["", end, end + end]))
    schema = "a string, b string, c string"
    for name in [f"f{i}.csv" for i in range(5)]:
        want = [tuple(x) for x in _multiline(spark, f"{d}/{name}", schema).collect()]
        rows = IO._csv_rows(spark, f"{d}/{name}", schema).orderBy("_block", "_pos").collect()
        assert [tuple(x.row) for x in rows] == want
        assert len({x._block for x in rows}) > 10  # read from many splits
    both = sorted(map(tuple, IO.read_csv_dataset(spark, d, schema).collect()), key=str)
    assert both == sorted(map(tuple, _multiline(spark, d, schema).collect()), key=str)


def test_csv_types_and_names_are_inferred_alike(tiny_splits):
    spark = tiny_splits
    d = _folder(spark, "csvinfer")
    _write(f"{d}/a.csv", '﻿n,n,,"t\nx",when,flag,empty\n' + "".join(f'{i},{i / 4},{10**12 + i},"l\n{i}",2024-01-0{1 + i % 9}T00:00:00.000001,{"true" if i % 2 else "false"},\n' for i in range(40)))
    want = spark.read.options(**IO._csv_options()).option("header", True).option("inferSchema", True).csv(d)
    got = IO.read_csv_dataset(spark, d)
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert [c.lstrip("﻿") for c in want.columns] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_csv_of_a_header_or_nothing(spark):
    d = _folder(spark, "csvhead")
    _write(f"{d}/a.csv", "a,b\n")
    assert IO.read_csv_dataset(spark, f"{d}/a.csv").columns == ["a", "b"]
    assert IO.read_csv_dataset(spark, f"{d}/a.csv", "a int, b string").count() == 0
    _write(f"{d}/b.csv", "")
    assert IO.read_csv_dataset(spark, f"{d}/b.csv", "a int").count() == 0
    _write(f"{d}/c.csv", 'a\n"never closed\n1')
    assert [x.a for x in IO.read_csv_dataset(spark, f"{d}/c.csv", "a string").collect()] == [x.a for x in _multiline(spark, f"{d}/c.csv", "a string").collect()]


def test_import_numbers_rows_across_splits(tiny_splits):
    spark = tiny_splits
    d = _folder(spark, "imp")
    _write(f"{d}/runs.csv", "approach,input\n" + "".join(f'CoT,"line {i}\nof ""{i}"""\n' for i in range(50)))
    rows = IO.import_runs_csv(spark, f"{d}/runs.csv", "e").orderBy("sample_index").collect()
    assert [(x.id, x.input_text) for x in rows] == [(f"e_{i}", f'line {i}\nof "{i}"') for i in range(50)]


def test_json_lists_equal_the_one_task_reader(tiny_splits):
    spark, r = tiny_splits, random.Random(9)
    d = _folder(spark, "jsonsplit")
    odd = ["}", "{", "[", "]", '"', "\\", "\n", "é", "x" * 60, "\\\\", '\\"', "}{", "a"]
    for i in range(5):
        rows = [{"INPUT": "".join(r.choices(odd, k=r.randint(0, 6))), "more": [{"a": {"b": ["}"]}}], "OUTPUT": r.choice([None, 7, "z"])} for _ in range(30 * (i > 0))]
        _write(f"{d}/f{i}.json", json.dumps(rows, indent=r.choice([None, 1]), ensure_ascii=bool(i % 2)) + r.choice(["", "\n"]))
    _write(f"{d}/empty.json", "")
    want = spark.read.option("multiLine", True).schema(IO.STANDARDIZED).json(f"{d}/f*.json")
    got = IO.read_json_records(spark, d)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == 120


@pytest.mark.parametrize("text", ['{"INPUT": "a"}', " 7", "}", '[{"INPUT": "a"}', '[{"INPUT": "a"}, 7]', '[7, {"INPUT": "a"}]', '[{"INPUT": "a"}]]', '[{"INPUT": "a"} {"INPUT": "b"}]',
                                  '[[{"INPUT": "a"}]]', '[{"INPUT": "a"}] {}', '["a}"]'])
def test_json_that_is_no_closed_list_of_records_is_refused(spark, text):
    d = _folder(spark, "jsonbad")
    _write(f"{d}/a.json", text)
    with pytest.raises(Exception, match="list of records"):
        IO.read_json_records(spark, d).collect()


def test_states_are_chained_without_reading_twice(tiny_splits):
    spark = tiny_splits
    d = _folder(spark, "states")
    _write(f"{d}/a.csv", 'h\n"' + "x\n" * 300 + '"\nlast\n')
    states = SS.split_states(spark, d, SS.CSV).orderBy("at").collect()
    assert len(states) > 3 and [x.state for x in states] == [0] + [1] * (len(states) - 1)
    assert states[0].head == "h" and states[0].opening == "h"
