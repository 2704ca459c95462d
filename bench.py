"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores. Each query writes to Spark's noop sink, after one small warm-up.
"""

from __future__ import annotations

import json
import os
import time

from strandframe.plans import catalog
from strandframe.session import local_session

HEADLINE = ["fastx_stats", "dedup_exact", "dedup_revcomp", "translate_frame", "kmer_counts", "rename_number", "exclude_hits", "one_per_query", "drop_contained", "one_per_range", "merge_overlapping", "hsp_edges", "components", "correlate_pearson", "termini_exact", "taxonomy_lineage"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["fastx_stats"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
