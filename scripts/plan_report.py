"""Physical-plan audit of the headline queries → PLANS.md.

For each query: shuffles (hash/range exchanges), broadcasts, window
operators, aggregate kinds (hash vs sort), pandas stages, and what reaches
the Parquet scans (read schema, pushed filters). Plans are the initial
adaptive plans (AQE may still coalesce partitions or switch a join to a
broadcast at run time).

Usage: python scripts/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import headline  # noqa: E402
from barengine.session import get_spark  # noqa: E402


def audit(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "single_partition": plan.count("Exchange SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "hash_aggs": plan.count("HashAggregate("),
        "sort_aggs": plan.count("SortAggregate("),
        "pandas": plan.count("FlatMapGroupsInPandas") + plan.count("FlatMapCoGroupsInPandas"),
        "scans": [(m.group(1)) for m in re.finditer(r"ReadSchema: (struct<[^>]*>)", plan)],
        "pushed": sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan))),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    out = ["# Physical plans of the headline queries", "",
           f"Data: `{sf}`. Counts from `executedPlan` (initial adaptive plan); "
           "`scripts/plan_report.py` regenerates this file.", "",
           "| query | shuffles | single-partition | broadcasts | windows | hash aggs | sort aggs | pandas stages |",
           "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    details = []
    for name, fn in headline().items():
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        formatted = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        a = audit(plan + "\n" + formatted)
        out.append(f"| {name} | {a['shuffles']} | {a['single_partition']} | {a['broadcasts']} | {a['windows']} | "
                   f"{a['hash_aggs']} | {a['sort_aggs']} | {a['pandas']} |")
        details += [f"### {name}", "", "Read schemas:", ""]
        details += [f"* `{s}`" for s in sorted(set(a["scans"]))] or ["* (no Parquet scan)"]
        details += ["", "Pushed filters:", ""]
        details += [f"* `{p}`" for p in a["pushed"]] or ["* none"]
        details.append("")
    spark.stop()
    text = "\n".join(out + ["", "## Scans", ""] + details) + "\n"
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write(text)
    print(text)


if __name__ == "__main__":
    main()
