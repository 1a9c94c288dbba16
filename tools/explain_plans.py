"""Write the executed (post-AQE) physical plans of the main queries to
PLANS.md.  Usage: python tools/explain_plans.py [sf_dir]"""

from __future__ import annotations

import os
import re
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

NOTES = {
    "segment_lines": "Narrow: scan (two columns) -> spread -> one array of segments, exploded once; "
                     "no shuffle besides spreading the single-row-group file.",
    "segment_html_nested": "Leaves are told by their tags, the element stack is folded inside the row; no shuffle.",
    "document_findings": "Both checks in one pass over the lines of documents that can hold a finding.",
    "segment_totals": "Counted inside the row: one scan, no shuffle.",
    "size_ratio": "One join of the pairing with one row per document.",
    "sensitive_findings": "One combined-alternation filter, then one Generate over the "
                          "flattened per-rule hits; no shuffle.",
    "segment_markdown": "Fence parity is computed inside the row (no Window, no Exchange on doc).",
    "review_texts": "Runs of a sorted array inside the row: one scan, no shuffle.",
    "review_texts_cells": "Counts of digests: partial/final HashAggregate.  First locations: partial "
                          "WindowGroupLimit below the Exchange, final above it, on the same keys.",
    "align_cells": "Sheet map: equi-joins + min(struct) aggregate, persisted and broadcast "
                   "after a row-count check.  Cells: one SortMergeJoin FullOuter on the cell key.",
    "consistency_findings": "(source, target) partial aggregate, once (reused by the bitmaps of issue "
                            "sources); coordinates of those via partial WindowGroupLimit(5).",
    "report_summary_all12": "One Expand (rollup) + conditional counts over the persisted "
                            "findings, joined to the fixed dimension list.",
    "report_detail": "Global numbering: each row once to its range; the counts of the ranges reuse that "
                     "exchange and come back as a broadcast of offsets.",
    "terminology_check": "A small glossary is tested inside the row; no join.",
}


def shorten(plan: str) -> str:
    plan = re.sub(r"\\A\[[^\]]{40,}\]\+\|\[[^\]]{40,}\]\+\\z", "<strip>", plan)
    plan = re.sub(r"\[[^\]\n]{60,}?\]", "[…]", plan)
    plan = re.sub(r"#\d+L?", "", plan)
    lines = []
    for ln in plan.splitlines():
        lines.append(ln if len(ln) <= 160 else ln[:157] + "...")
    return "\n".join(lines)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from polyglint.plans.queries import QUERIES
    from polyglint.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8,
                      **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    out = ["# Executed plans", "",
           f"Final (post-AQE) physical plans of the main queries at `{sf}`, written by "
           "`tools/explain_plans.py`. Long regex literals are shortened.", ""]
    for name, note in NOTES.items():
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("+- == Initial Plan ==")[0]
        out += [f"## {name}", "", note, "", "```", shorten(final).rstrip(), "```", ""]
    with open(os.path.join(HERE, "PLANS.md"), "w", encoding="utf-8") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main(sys.argv)
