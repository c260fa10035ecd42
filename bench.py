"""Time the headline queries; prints one JSON line.

Shared intermediates are dropped before each query, so a time includes everything the query needs.
"""

from __future__ import annotations

import json
import os
import sys
import time

import taxaspark.catalog as catalog
from taxaspark.catalog.registry import forget_shared
from taxaspark.session import build_session

HEADLINE = (
    "a2_ndjson_scan",
    "b8_dedupe",
    "b11_funnel_counts",
    "b13_pasted_text",
    "c5_all_splits",
    "d1_kmer_tokens",
    "d2_kmer_frequencies",
    "d3_dense_vector",
    "d5_pca_transform",
    "d8_triplets",
    "e8_nearest_species",
    "f1_rank_centroids",
    "f9_thresholds",
    "f10_barcode_cascade",
    "f16_deployed_scoring",
    "g2_bayes_predict",
    "g4_nearest_row",
    "g4_indexed_nearest_row",
    "g7_similarity_search",
    "h3_bootstrap_interval",
    "h7_fcw_curve",
    "i5_isotonic_map",
    "k1_stream_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    picked = sys.argv[1:] or HEADLINE
    queries, _ = catalog.load()
    spark = build_session("bench", cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not a query's time
    times = {}
    for name in picked:
        forget_shared()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
