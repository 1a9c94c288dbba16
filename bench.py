"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line::

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is planned and fully executed (a ``noop`` write forces every
column of every row) after one warm-up query has started the JVM.  Before each
of them the caches and the inputs shared between queries are dropped, so that
every time is that of the query from the files on.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "segment_lines",
    "segment_markdown",
    "segment_html",
    "sensitive_findings",
    "detect_language",
    "review_texts",
    "size_ratio",
    "scan_cells",
    "align_cells",
    "consistency_findings",
    "terminology_check",
    "report_summary_all12",
    "report_detail",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from polyglint.plans.queries import QUERIES, forget_shared
    from polyglint.session import get_spark, size_partitions

    spark = get_spark(f"local[{cpus}]", app="polyglint-bench",
                      shuffle_partitions=max(8, 2 * int(cpus)),
                      **{"spark.ui.enabled": "false",
                         "spark.ui.showConsoleProgress": "false",
                         "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    input_bytes = sum(os.path.getsize(os.path.join(sf_dir, f)) for f in os.listdir(sf_dir)
                      if f.endswith(".parquet"))
    size_partitions(spark, input_bytes)
    QUERIES["segment_lines"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        forget_shared(spark)
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
