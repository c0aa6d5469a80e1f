"""Benchmark of the headline queries.

Runs each query end to end (the redaction plan is rebuilt for every query,
so checkpoints and name keys are paid each time) at $BENCH_SF_DIR on
local[$BENCH_CPUS] and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["redacted_text", "redacted_markup", "spans_decoded", "persons_numbered", "name_pair_key",
            "case_roster", "ledger_latest", "throughput_hourly", "case_sessions", "mentions_parsed"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from redactum.plans import catalog
    from redactum.session import get_spark

    spark = get_spark(f"local[{cpus}]", int(cpus))
    # warm-up on the smallest folder so JVM start-up is not billed to a query
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        catalog.QUERIES["redacted_text"](spark, warm).count()
        catalog._cache.clear()
    times = {}
    for name in HEADLINE:
        catalog._cache.clear()
        t = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "docs_per_sec_redacted_text": round(n_docs / times["redacted_text"], 1)}))


if __name__ == "__main__":
    main()
