"""Scale review: run each registered query and summarise its final (AQE) physical plan.

usage: python scripts/plan_audit.py [--sf-dir DIR] [name ...]

Per query: wall time, parquet scans per table, shuffle stages, reused exchanges,
broadcast exchanges, nested-loop joins, sort-merge / shuffled-hash joins, and windows
without a partition spec (single-task windows).
"""

from __future__ import annotations

import argparse
import collections
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"stream_posts_daily", "quality_classifier", "tfidf_mllib"}


def final_plan(plan: str) -> str:
    """The plan without its initial plans, those of nested subqueries too: such a part ends
    where a line starts no deeper than its heading."""
    out, skip = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if skip is not None and depth >= skip:
            continue
        skip = None
        if "== Initial Plan ==" in line:
            skip = depth
            continue
        out.append(line)
    return "\n".join(out)


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from brieflane.plans import registry
    from brieflane.session import build_session

    spark = build_session("local[8]", 8)
    qs = registry.queries()
    for name in a.names or sorted(n for n in qs if n not in SKIP):
        df = qs[name](spark, a.sf_dir)
        t0 = time.time()
        df.write.format("noop").mode("overwrite").save()
        wall = time.time() - t0
        df.collect()  # the final adaptive plan is recorded on this DataFrame's execution
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = final_plan(plan)
        scans = collections.Counter(re.findall(r"FileScan parquet .*?/(\w+)\.parquet", plan))
        single = sum(1 for ln in plan.splitlines() if "Window [" in ln and "windowspecdefinition(" in ln
                     and re.search(r"\], \[\]", ln))
        print(f"{name:24s} {wall:6.2f}s scans={dict(scans)} stages={plan.count('ShuffleQueryStage')} "
              f"reused={plan.count('ReusedExchange')} bcast={plan.count('BroadcastExchange')} "
              f"bnlj={plan.count('BroadcastNestedLoopJoin')} smj={plan.count('SortMergeJoin')} "
              f"shj={plan.count('ShuffledHashJoin')} unpartitioned_windows={single}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
