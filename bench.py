"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tastemill.catalog import QUERIES
from tastemill.session import build_session

HEADLINE = [
    "interactions", "encode_interactions", "item_popularity", "topk_per_user", "recommend_request", "filtered_topk", "recommend_enriched",
    "rerank_hybrid", "hybrid_fuse", "sessions", "next_item_pairs", "context_pairs", "transition_probs", "predict_next_items", "user_profile_weighted",
    "profile_recommend", "ann_flat_ip", "similar_items", "ann_ivf", "ivf_probe_given_cells", "tfidf_terms", "text_vectors", "item_gram",
    "item_cosine_topm", "itemknn_recommend", "ease_recommend", "leave_last_out", "evaluate_popularity_baseline", "als_recommend", "als_foldin",
    "bpr_triples", "gdpr_export", "gdpr_delete", "retention", "stream_ingest", "stream_sessions",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus=cpus, shuffle_partitions=int(cpus), driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    seconds = {}
    for name in names:
        started = time.monotonic()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - started, 3)
        print(f"{name:32s} {seconds[name]:8.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(root.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
