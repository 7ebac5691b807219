"""Benchmark: run the catalogue queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row is produced,
nothing is collected to the driver), and timed from DataFrame construction to
the end of the job.  A first pass over all queries warms the JVM (JIT, codegen
caches, parquet footers) and is reported as ``cold_value``/``cold_queries``;
the second pass is the reported ``value``/``queries``.  Prints ONE JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyspark.plans.catalogue import QUERIES  # noqa: E402
from tallyspark.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    if os.environ.get("BENCH_EVENT_LOG"):
        # stage and task times for offline analysis, written to a fresh scratch folder
        import tempfile

        log_dir = tempfile.mkdtemp(prefix="tallyspark-eventlog-")
        os.environ.setdefault("PYSPARK_SUBMIT_ARGS",
                              f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{log_dir} "
                              "pyspark-shell")
        print(f"event log: {log_dir}", file=sys.stderr)
    spark = local_session(cpus, app="tallyspark-bench")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    keys = only or list(QUERIES)
    passes = []
    errors: dict[str, str] = {}
    for _ in range(2):
        times: dict[str, float | None] = {}
        for k in keys:
            t0 = time.perf_counter()
            try:
                QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
                times[k] = round(time.perf_counter() - t0, 3)
            except Exception as e:  # noqa: BLE001 - record and keep measuring the others
                times[k] = None
                errors[k] = f"{type(e).__name__}: {str(e)[:200]}"
        passes.append(times)
    cold, warm = passes

    def total(ts):
        return round(sum(v for v in ts.values() if v is not None), 3)

    out = {"metric": "total_query_sec", "value": total(warm), "unit": "sec", "queries": warm, "sf": sf,
           "cpus": int(cpus), "n_queries": len(warm), "cold_value": total(cold), "cold_queries": cold}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
