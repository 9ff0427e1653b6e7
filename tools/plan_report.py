"""Run every registered query once and summarise its executed (final AQE) plan:
shuffles, broadcasts, Python nodes, single-partition exchanges, scan pruning and
push-down. Usage: python tools/plan_report.py [sf_dir] > PLANS.md"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tokenmill import registry  # noqa: E402
from tokenmill.session import local_session  # noqa: E402

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonMapInArrow")


def final_plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def summarise(plan: str) -> dict:
    scans = []
    for m in re.finditer(r"FileScan (\w+) \[([^\]]*)\].*?(?:PartitionFilters: (\[[^\]]*\]))?.*?"
                         r"(?:PushedFilters: (\[[^\]]*\]))?, ReadSchema", plan):
        cols = [re.sub(r"#\d+L?", "", c) for c in m.group(2).split(",")]
        scans.append((m.group(1), cols, m.group(3) or "[]", m.group(4) or "[]"))
    return {
        "shuffles": len(re.findall(r"\bExchange (?:hashpartitioning|rangepartitioning|RoundRobinPartitioning|"
                                   r"SinglePartition)", plan)),
        "single": plan.count("Exchange SinglePartition"),
        "broadcast": plan.count("BroadcastExchange"),
        "reused": plan.count("ReusedExchange"),
        "python": sorted({k for k in PY_NODES if k in plan}),
        "scans": scans,
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    registry.load_all()
    print(f"# Executed plans of the registered queries ({os.path.basename(sf)}, local, AQE on)\n")
    print("Generated by `tools/plan_report.py`. Shuffles count exchanges of data (hash, range, round-robin,")
    print("single-partition); `reused` exchanges are not run twice. Scan columns show pruning; partition")
    print("filters and pushed filters are what reached the Parquet scan.\n")
    print("| query | shuffles | of which single-partition | broadcasts | reused | python | scans (columns / partition filters / pushed) |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name in sorted(registry.QUERIES):
        df = registry.QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        s = summarise(final_plan(df))
        seen, scans = set(), []
        for fmt, cols, pf, pu in s["scans"]:
            key = (fmt, tuple(cols), pf, pu)
            if key in seen:
                continue
            seen.add(key)
            extra = "".join([f" / part {pf}" if pf != "[]" else "", f" / pushed {pu}" if pu != "[]" else ""])
            scans.append(f"{fmt} {','.join(cols)}{extra}")
        print(f"| `{name}` | {s['shuffles']} | {s['single']} | {s['broadcast']} | {s['reused']} | "
              f"{', '.join(s['python']) or '-'} | {'; '.join(scans) or 'checkpointed input'} |")


if __name__ == "__main__":
    main()
