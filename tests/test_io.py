"""Sources and sinks with the reference's literal CSV."""

import os

import pytest

from runlens.session import scratch_path
from runlens.sources import io as IO

CSV = """approach,provider,model,input,expected,output,is_correct,execution_time_ms,cost
CoT,openai,gpt-4,"2+2=?",4,"The answer is 4",true,1500,0.001
PoT,openai,gpt-4,"3*3=?",9,"The answer is 9",true,1200,0.001"""


def test_import_reference_csv(spark):
    d = scratch_path(spark, "imp")
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/runs.csv", "w") as f:
        f.write(CSV)
    runs = IO.import_runs_csv(spark, f"{d}/runs.csv", "exp1").orderBy("sample_index").collect()
    assert [r.id for r in runs] == ["exp1_0", "exp1_1"]
    assert runs[0].approach_name == "CoT" and runs[0].is_correct is True and runs[0].execution_time_ms == 1500
    assert runs[1].expected_answer == "9" and runs[1].raw_output == "The answer is 9"
    again = IO.import_runs_csv(spark, f"{d}/runs.csv", "exp1", existing_ids=spark.createDataFrame(
        [("exp1_0",)], "id string"))
    assert [r.id for r in again.collect()] == ["exp1_1"]


def test_json_records_object_is_error(spark):
    d = scratch_path(spark, "js")
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/obj.json", "w") as f:
        f.write('{"INPUT": "a", "OUTPUT": "b"}')
    try:
        IO.read_json_records(spark, f"{d}/obj.json")
        raise AssertionError("expected an error")
    except ValueError:
        pass
    with open(f"{d}/list.json", "w") as f:
        f.write('[{"INPUT": "a", "OUTPUT": "b"}, {"INPUT": "c", "OUTPUT": "d"}]')
    assert IO.read_json_records(spark, f"{d}/list.json").count() == 2


def test_versions(spark):
    base = scratch_path(spark, "ver")
    df = spark.createDataFrame([(1,)], "x int")
    assert IO.write_version(df, base) == 0
    assert IO.write_version(df.selectExpr("x + 1 AS x"), base) == 1
    assert IO.read_latest(spark, base).first().x == 2


def test_json_shape_is_checked_in_every_file(spark):
    d = scratch_path(spark, "jsmany")
    os.makedirs(d, exist_ok=True)
    for name, body in (("a", ' \n[{"INPUT": "a", "OUTPUT": "b"}]'), ("b", '\n{"INPUT": "c", "OUTPUT": "d"}\n')):
        with open(f"{d}/{name}.json", "w") as f:
            f.write(body)
    assert IO.read_json_records(spark, f"{d}/a.json").count() == 1
    with pytest.raises(ValueError):
        IO.read_json_records(spark, d)


def test_json_output_is_a_list_that_the_reader_takes(spark):
    d = scratch_path(spark, "jsout")
    df = spark.createDataFrame([("a\n[b", "1"), (None, "2"), ('"q"', None)], "INPUT string, OUTPUT string").repartition(5)
    assert IO.write_standardized(df, f"{d}/x.json") == "json"
    got = IO.read_json_records(spark, f"{d}/x.json").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, df.collect()), key=str)
    IO.write_standardized(df.limit(0), f"{d}/empty.json")
    assert IO.read_json_records(spark, f"{d}/empty.json").count() == 0


def test_export_file_validation(spark):
    d = scratch_path(spark, "valfile")
    df = spark.createDataFrame([("a", "1")], "INPUT string, OUTPUT string")
    for suffix in ("csv", "json", "parquet"):
        IO.write_standardized(df, f"{d}/x.{suffix}")
        r = IO.validate_export_file(spark, f"{d}/x.{suffix}").first()
        assert (r.format, r.num_rows, r.is_valid, r.warnings) == (suffix, 1, True, [])
    assert IO.validate_export_file(spark, f"{d}/x.csv", max_bytes=1).first().warnings == ["File is larger than 100 MB"]
    assert IO.validate_export_file(spark, f"{d}/none.csv").first().errors == ["File not found"]
    os.makedirs(f"{d}/obj", exist_ok=True)
    with open(f"{d}/obj/o.json", "w") as f:
        f.write('{"INPUT": "a", "OUTPUT": "b"}')
    r = IO.validate_export_file(spark, f"{d}/obj/o.json").first()
    assert not r.is_valid and r.errors == ["JSON data must be a list of records"]
