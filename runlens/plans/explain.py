"""Plan audit: ``python -m runlens.plans.explain [--sf DIR] [--formatted] [keys...]``.

For each registered query prints the physical-plan shape (shuffles, join
strategies, windows, Python nodes, scans with their pushed filters), or the
full ``explain("formatted")`` output with ``--formatted``.
"""

from __future__ import annotations

import argparse
import re
import sys

from ..fixtures import Fixtures
from . import REGISTRY


def shape(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "nested_loop_joins": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "windows": len(re.findall(r"\bWindow ", plan)),
        "group_limits": plan.count("WindowGroupLimit"),
        "python": any(p in plan for p in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython")),
    }


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("--formatted", action="store_true")
    ap.add_argument("--scale", action="store_true",
                    help="plan as for large inputs: distributed paths, no size-based broadcast")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args(argv)
    from ..session import get_session

    conf = {"spark.runlens.smallBytes": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"} if a.scale else {}
    spark = get_session(**conf)
    keys = a.keys or sorted(REGISTRY)
    print("| query | shuffles | broadcast joins | sort-merge joins | nested-loop joins | windows | group limits | python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for k in keys:
        df = REGISTRY[k].build(Fixtures(spark, a.sf))
        if a.formatted:
            print(f"## {k}")
            df.explain("formatted")
            continue
        s = shape(df)
        print(f"| {k} | {s['exchanges']} | {s['broadcast_joins']} | {s['sort_merge_joins']} | {s['nested_loop_joins']} "
              f"| {s['windows']} | {s['group_limits']} | {'yes' if s['python'] else ''} |")
    return 0


if __name__ == "__main__":
    sys.exit(main())
