"""Write PLANS.md: the executed physical plan skeleton of every query
(exchanges, window limits, joins, Python nodes, scans with pushed filters).

usage: python scripts/show_plans.py [sf_dir]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(r"(Exchange|WindowGroupLimit|Window \[|Join|TakeOrderedAndProject|HashAggregate|"
                  r"ArrowEvalPython|MapInPandas|Generate|Scan|ReusedExchange|AQEShuffleRead|Sort \[)")


def skeleton(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        m = KEEP.search(line)
        if not m:
            continue
        indent = len(line) - len(line.lstrip(" :+-"))
        node = line[m.start():]
        if "ExistingRDD" in node:
            node = "Scan checkpointed partitions (reliable checkpoint)"
        elif node.startswith("FileScan") or node.startswith("Scan"):
            table = re.search(r"file:[^\]]*/(\w+)\.parquet", node)
            pushed = re.search(r"PushedFilters: (\[[^\]]*\])", node)
            schema = re.search(r"ReadSchema: (struct<[^>]*>)", node)
            node = (f"Scan {table.group(1) if table else '?'} pushed={pushed.group(1) if pushed else '[]'} "
                    f"read={schema.group(1) if schema else '?'}")
        else:
            node = re.sub(r"#\d+L?", "", node)
            node = node[:150]
        out.append(" " * indent + node)
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from estatelens.session import build_session
    spark = build_session(extra={"spark.ui.showConsoleProgress": "false",
                                 "spark.sql.maxMetadataStringLength": "10000"})
    lines = ["# PLANS", "", f"Executed physical plans (after AQE) at `{os.path.basename(sf)}`, local[8], "
             "reduced to the nodes that decide cost: scans (pushed filters, read schema), exchanges, "
             "window limits, windows, joins, aggregates, Python nodes. Regenerate with "
             "`python scripts/show_plans.py`.", ""]
    from estatelens.plans.registry import QUERIES
    for name, q in QUERIES.items():
        df = q(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines += [f"## {name}", "", "```"] + skeleton(plan) + ["```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines))


if __name__ == "__main__":
    main()
