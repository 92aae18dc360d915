"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is fully
materialized with a ``noop`` write (all rows computed, nothing collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from encyclo.plans.registry import load_all  # noqa: E402
from encyclo.session import get_spark  # noqa: E402

HEADLINE = [
    "a5_source_quality",      # links x quality -> mean -> label
    "j4_resolve_links",       # links through redirects to ids
    "a2_assign_category",     # n largest + argmin assignment
    "g2_deepen_categories",   # ancestors + article categories
    "a12_dictionary",         # document frequencies over the corpus
    "a14_collocations",       # bigram scores
    "v9_similar_articles",    # exact all-pairs top-10
    "g3_shortest_paths",      # frontier relaxation on the kNN graph
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", app="encyclo-bench", shuffle_partitions=int(cpus) * 2)
    reg = load_all()
    names = [n for n in HEADLINE if n in reg]
    times = {}
    # warm-up: JVM, Python workers, parquet footers
    reg["a1_category_sizes"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for n in names:
        t0 = time.perf_counter()
        reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
