"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder with the tables, BENCH_CPUS the number of local cores, BENCH_QUERIES a comma list
of query names to time instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pairloom.plans.registry import Tables, load_all
from pairloom.session import local_session

HEADLINE = [
    "set_similarity_topk", "star_join", "array_map_lookup", "last_wins_lookup", "prefix_descendants", "map_attach", "page_link_join",
    "yearly_stability", "duplicate_count", "feature_distribution", "corr_matrix", "child_outcome", "trial_flatten", "pair_label",
    "first_date_fallback", "feature_matrix", "condensed_pairs", "topk_group", "keep_first", "row_index", "time_split", "stratified_folds",
    "token_tfidf", "cosine_topk", "edges_tokens", "metapath_support", "hop_mean", "ranking_metrics", "case_correlations",
    "nearest_euclidean", "svd_scores", "pca_scores", "rule_importance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    queries = load_all()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    tables.lineitem.groupBy("l_returnflag").count().collect()  # start the JVM's compilers before timing
    timings: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.time()
        queries[name].run(tables).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr)
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
