"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs once after a warm-up session;
the stored index is built first and timed by itself."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanseek.catalogue import all_queries  # noqa: E402
from spanseek.catalogue.corpus import stored_vectors  # noqa: E402
from spanseek.catalogue.registry import Tables  # noqa: E402
from spanseek.session import local_session  # noqa: E402

HEADLINE = ("dense_topk", "dense_topk_scoped", "gate", "bm25_scores", "gated_search", "fusion_search", "concat_ensemble",
            "term_freq", "doc_freq", "metrics_by_group", "percentile_floor", "dup_text", "split_python")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("spanseek-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    queries, _ = all_queries()
    queries["doc_length"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    began = time.perf_counter()
    stored_vectors(Tables(spark, folder))  # units, inverted index and vectors; the queries below find them stored, as a search does
    took["index_build"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {took[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
