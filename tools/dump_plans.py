"""Write the final (post-adaptive) physical plan of every query to docs/PLANS.md.

    python tools/dump_plans.py [--sf-dir DIR]

Each query is collected once first (a dev tool on test sizes), so the
adaptive plan shown is the one that executed (``isFinalPlan=true``): join
strategies, exchanges, pushed filters and read schemas as Spark chose them.
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--out", default=None)
    ap.add_argument("--at-scale", action="store_true",
                    help="plan with broadcasts off (the shuffled shapes the plans take on large inputs) "
                         "and write docs/PLANS_AT_SCALE.md")
    a = ap.parse_args(argv)
    a.out = a.out or os.path.join(HERE, "docs", "PLANS_AT_SCALE.md" if a.at_scale else "PLANS.md")
    from rowsmith.session import build_session
    from rowsmith.plans.catalog import all_queries
    extra = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"} \
        if a.at_scale else {}
    spark = build_session("local[8]", 16, extra=extra)
    specs = all_queries()
    if a.at_scale:
        parts = ["# Physical plans at scale\n\nThe plan of every catalogued query with broadcast joins switched off "
                 "and adaptive execution off: the shuffled shape the plans take when no side is small "
                 "(generated by `tools/dump_plans.py --at-scale`). On a cluster, adaptive execution may still "
                 "turn a join into a broadcast when a side measures small, and may split skewed partitions.\n"]
    else:
        parts = [f"# Physical plans\n\nFinal adaptive plans of every catalogued query on `{a.sf_dir}`, "
                 "`local[8]`, 16 shuffle partitions (generated by `tools/dump_plans.py`). Broadcast joins here "
                 "reflect the small test sizes; Catalyst and adaptive execution choose shuffled joins when the "
                 "measured sides are larger than the broadcast thresholds (see PLANS_AT_SCALE.md).\n"]
    for name, fn in ((n, s.run) for n, s in specs.items()):
        df = fn(spark, a.sf_dir)
        if not a.at_scale:
            df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="simple")
        plan = re.sub(r"#\d+L?", "", buf.getvalue()).replace("file:" + a.sf_dir, "$SF")
        plan = "\n".join(line[:220] for line in plan.splitlines() if line.strip())
        parts.append(f"## `{name}` ({specs[name].operator})\n\n```\n{plan}\n```\n")
    spark.stop()
    with open(a.out, "w") as f:
        f.write("\n".join(parts))
    print(a.out)


if __name__ == "__main__":
    main()
