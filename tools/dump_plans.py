"""Execute every catalogue query and write its final (adaptive) physical plan to docs/PLANS.md.

usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark.plans.catalogue import QUERIES  # noqa: E402
from tallyspark.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    out = ["# Physical plans", "",
           f"Final adaptive plans after execution on `{sf_dir}` (`local[8]`, AQE on). Generated by "
           "`tools/dump_plans.py`; scan details are reduced to the pushed filters.", ""]
    for key, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()
        qe = df._jdf.queryExecution()
        tree = qe.executedPlan().treeString()
        tree = tree.split("+- == Initial Plan ==")[0]  # the final adaptive plan only
        tree = re.sub(r"#\d+L?", "", tree)
        pushed = sorted(set(re.findall(r"PushedFilters: \[[^\]]*\]", qe.executedPlan().toString())))
        lines = [ln for ln in tree.splitlines() if ln.strip()]
        lines = [ln if len(ln) <= 160 else ln[:157] + "..." for ln in lines]
        out += [f"## {key}", "", "```"] + lines + ["```", ""]
        if pushed:
            out += ["Pushed filters: " + "; ".join(p[len("PushedFilters: "):] for p in pushed), ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
