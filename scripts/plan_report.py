"""Physical-plan report for registered queries (writes PLANS.md).

For each query: shuffles (Exchange), broadcasts, whole-stage-codegen stages,
the parquet scans' ReadSchema / PushedFilters, and Python (Arrow) operators.
Plans are taken after one execution so AQE's final plan is shown.

Usage: python scripts/plan_report.py [--sf DIR] [--out PLANS.md] [name ...]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["all_features", "label_text_profile", "evaluate", "pr_curve", "lift_table", "threshold_sweep",
           "fold_metrics", "pairwise_corr", "scale_features", "stratified_folds", "oversample",
           "drop_invalid_posts", "class_weights"]


def plan_text(df, mode, final_only=True):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    text = buf.getvalue()
    if final_only and "== Final Plan ==" in text:            # keep AQE's final plan only
        text = text.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return text


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--out", default="PLANS.md")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from postsignal.registry import all_queries
    from postsignal.session import local_session
    spark = local_session(8, 16)
    qs = all_queries()
    lines = ["# Physical plans of headline queries", "",
             f"Final (post-AQE) plans at `{a.sf}`, `local[8]`, 16 shuffle partitions; generated by "
             "`scripts/plan_report.py`. Counts are over the last plan of each query (checkpoint and "
             "driver-side helper jobs are separate plans).", "",
             "| query | exchanges | broadcasts | codegen stages | python ops | scans: columns read / pushed filters |",
             "|---|---|---|---|---|---|"]
    for n in a.names or DEFAULT:
        df = qs[n].fn(spark, a.sf)
        df.collect()                       # executes this DataFrame's own plan: AQE final plan
        simple = plan_text(df, "simple")
        formatted = plan_text(df, "formatted", final_only=False)
        exch = len(re.findall(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", simple))
        bcast = len(re.findall(r"BroadcastExchange", simple))
        stages = len(set(re.findall(r"\*\((\d+)\)", simple)))
        py = len(re.findall(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", simple))
        scans = []
        seen = set()
        for block in re.split(r"\n\(\d+\) ", formatted):
            if not block.startswith("Scan parquet"):
                continue
            rs = re.search(r"ReadSchema: (struct<[^\n]*>)", block)
            loc = re.search(r"Location: [^\n]*\[file:[^\]]*/([a-z]+)\.parquet\]", block)
            pf = re.search(r"PushedFilters: \[([^\]]*)\]", block)
            if not rs:
                continue
            item = (f"{loc.group(1) if loc else '?'}: {rs.group(1).count(':')} cols"
                    + (f" [{pf.group(1)}]" if pf and pf.group(1) else ""))
            if item not in seen:
                seen.add(item)
                scans.append(item)
        lines.append(f"| `{n}` | {exch} | {bcast} | {stages} | {py} | {'; '.join(scans) or '-'} |")
        print(n, exch, bcast, stages, py)
    lines += ["", "Reading the table:", "",
              "* every scan reads only the columns the query uses (`ReadSchema`), with join-key",
              "  `IsNotNull` filters pushed into the parquet reader;",
              "* `all_features` is one codegen projection over the joined post rows: no exchange; the",
              "  three joins are broadcast here only because the driver tables are small (AQE picks",
              "  sort-merge joins once the sides exceed `autoBroadcastJoinThreshold`);",
              "* `pr_curve` reads the checkpointed distinct-score table: no exchange in its final plan",
              "  (its range partitioning and running sums ran in the checkpoint jobs);",
              "* `lift_table` is the heaviest ranking plan: one range exchange for the global rank, one",
              "  hash exchange on the partition id for the running window, then <= bins-row aggregates;",
              "* `pairwise_corr` has a single Python operator (`MapInPandas`: per-task Gram sums) and one",
              "  exchange of k^2 partial sums per task;",
              "* broadcasts are the small sides (per-partition offsets, class/bin tables, image keys at",
              "  this scale)."]
    with open(a.out, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
