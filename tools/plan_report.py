"""Physical-plan shape of every registered query (initial adaptive plan, before execution):
shuffle exchanges by kind, broadcasts, windows, aggregates, Python stages. Writes docs/PLANS.md.

usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairjudge.plans import QUERIES  # noqa: E402
from pairjudge.session import get_spark  # noqa: E402

# Queries that write scratch data while being built (their plan is a read-back scan).
SIDE_EFFECTS = {"read_table", "export_csv", "read_salvage", "read_encoding_fallback", "load_labelled_runs",
                "write_results", "failure_policy", "incremental_run", "explain_mismatches", "length_confound",
                "stream_keep_last", "judge_gold_pairs"}


def shape(plan: str) -> dict:
    return {
        "hash_shuffles": len(re.findall(r"Exchange hashpartitioning", plan)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "range_shuffles": len(re.findall(r"Exchange rangepartitioning", plan)),
        "round_robin": len(re.findall(r"Exchange RoundRobinPartitioning", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "windows": len(re.findall(r"\bWindow\b", plan)),
        "aggregates": len(re.findall(r"HashAggregate|ObjectHashAggregate|SortAggregate", plan)),
        "python": len(re.findall(r"MapInPandas|ArrowEvalPython|BatchEvalPython", plan)),
        "cartesian": len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan)),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]")
    rows = []
    for k in sorted(QUERIES):
        if k in SIDE_EFFECTS:
            continue
        plan = QUERIES[k](spark, sf)._jdf.queryExecution().executedPlan().toString()
        rows.append((k, shape(plan)))
    cols = list(rows[0][1])
    out = ["# Physical plan shapes", "",
           f"Initial adaptive plans of the registered queries on `{os.path.basename(sf)}` "
           "(`python tools/plan_report.py`). Counts are operators in the plan; broadcasts include the "
           "planner's own size-checked choices on these small inputs (sort-merge at scale) and the "
           "explicit bounded ones (bucket offsets, prompt templates). `single_partition` exchanges feed "
           "only keyless final aggregates or the bounded bucket-offset table. Subtrees that appear twice "
           "(e.g. the count and rank passes of the exact rank over the same input) are reused at run time "
           "(ReusedExchange), so exchange counts are upper bounds; per exact rank only one exchange "
           "moves data rows, the others move bucket counts. "
           f"Side-effecting queries ({', '.join(sorted(SIDE_EFFECTS))}) are not listed.", "",
           "| query | " + " | ".join(cols) + " |", "|---|" + "---|" * len(cols)]
    for k, s in rows:
        out.append(f"| `{k}` | " + " | ".join(str(s[c]) for c in cols) + " |")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out) + "\n")
    print(f"wrote {path}: {len(rows)} queries; cartesian total = {sum(s['cartesian'] for _, s in rows)}")


if __name__ == "__main__":
    main()
