"""Spark vs DuckDB oracle comparison (row count, column names, values).

Used by the tests and by ``python -m runlens.plans.check`` to verify every
registered query against its oracle SQL on the same parquet tables.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import decimal
import json
import math
import sys
import time

from ..fixtures import BASE_TABLES


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat()
    if hasattr(v, "asDict"):
        return tuple((k, _norm(x)) for k, x in v.asDict().items())
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().isoformat(sep=" ")
    return v


def _rows(cols: list[str], records) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    out.sort(key=repr)
    return out


def spark_rows(df):
    cols = df.columns
    return cols, _rows(cols, [tuple(r) for r in df.collect()])


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def duck_rows(con, sql: str):
    rel = con.sql(sql)
    cols = list(rel.columns)
    types = {c: str(t) for c, t in zip(cols, rel.types)}
    return cols, _rows(cols, rel.fetchall()), types


_SCALAR = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
           "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT",
           "smallint": "SMALLINT", "date": "DATE"}


def _family(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        inner = _family(spark_type[6:-1])
        return "NESTED[]" if inner == "NESTED" else inner + "[]"
    if spark_type.startswith(("struct<", "map<")):
        return "NESTED"
    return _SCALAR.get(spark_type, spark_type)


def type_mismatches(spark_dtypes: list[tuple[str, str]], duck_types: dict[str, str]) -> list[str]:
    out = []
    for c, t in spark_dtypes:
        d = duck_types.get(c)
        f = _family(t)
        if d is None:
            continue
        if f.startswith("NESTED"):
            if not (d.startswith(("STRUCT", "MAP")) or d.endswith("[]")):
                out.append(f"{c}: {t} vs {d}")
        elif f != d:
            out.append(f"{c}: {t} vs {d}")
    return out


def compare(spark, sf_dir: str, keys=None, con=None, verbose=True) -> dict:
    from .. import plans  # noqa: F401  (registers all plan modules)
    from .registry import REGISTRY, oracle_text

    con = con or duck_connect(sf_dir)
    report = {}
    for key, spec in REGISTRY.items():
        if keys and key not in keys:
            continue
        t0 = time.time()
        res: dict = {"oracle": spec.oracle is not None}
        try:
            df = spec.build(__import__("runlens.fixtures", fromlist=["Fixtures"]).Fixtures(spark, sf_dir))
            scols, srows = spark_rows(df)
            res["rows"] = len(srows)
            sql = oracle_text(spec)
            if sql is not None:
                dcols, drows, dtypes = duck_rows(con, sql)
                res["oracle_rows"] = len(drows)
                res["cols_match"] = sorted(scols) == sorted(dcols)
                res["values_match"] = srows == drows
                res["type_mismatches"] = type_mismatches(df.dtypes, dtypes)
                if not res["cols_match"]:
                    res["spark_cols"] = sorted(scols)
                    res["duck_cols"] = sorted(dcols)
                elif not res["values_match"]:
                    ds_, ss_ = set(drows), set(srows)
                    diff_s = [r for r in srows if r not in ds_][:3]
                    diff_d = [r for r in drows if r not in ss_][:3]
                    res["spark_only"] = [repr(x)[:400] for x in diff_s]
                    res["duck_only"] = [repr(x)[:400] for x in diff_d]
                res["ok"] = res["cols_match"] and res["values_match"] and not res["type_mismatches"]
            else:
                res["ok"] = True
        except Exception as e:  # report and go on with the rest
            res["ok"] = False
            res["error"] = f"{type(e).__name__}: {str(e)[:600]}"
        res["sec"] = round(time.time() - t0, 2)
        report[key] = res
        if verbose:
            status = "OK " if res["ok"] else "BAD"
            print(f"{status} {key:32s} {res.get('rows')} {res.get('oracle_rows')} {res['sec']}s", flush=True)
            if not res["ok"]:
                print("    ", json.dumps({k: v for k, v in res.items() if k not in ("ok",)})[:1500], flush=True)
    return report


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--distributed", action="store_true",
                    help="force the distributed paths (spark.runlens.smallBytes=0, no automatic broadcast)")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args(argv)
    from ..session import get_session

    conf = {"spark.runlens.smallBytes": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"} if a.distributed else {}
    spark = get_session(**conf)
    rep = compare(spark, a.sf, set(a.keys) or None)
    bad = [k for k, v in rep.items() if not v["ok"]]
    print(f"{len(rep) - len(bad)}/{len(rep)} ok; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
