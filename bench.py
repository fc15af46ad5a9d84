"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weftline.plans.catalog import Tables, load_all  # noqa: E402
from weftline.session import local_session  # noqa: E402

HEADLINE = [
    "filter_length_ratio",
    "filter_language",
    "scored_evaluation",
    "dataset_error_rates",
    "corpus_bleu",
    "tokenise_corpus",
    "word_tokens",
    "pack_contiguous",
    "pack_first_fit_decreasing",
    "retrieval_chunks",
    "knn_inner_product",
    "phrase_candidates",
    "keep_first",
    "exact_split",
    "token_budget_batches",
    "session_sweep",
    "noisy_channel_rerank",
    "coefficient_search",
    "label_quota",
    "chat_targets",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    out = sys.stdout
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "weftline-bench")
    queries = load_all()
    tables = Tables(spark, folder)
    tables.region.count()  # start the session before the clock
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        # the noop sink computes every column of every row
        queries[name].build(tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    record = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}
    print(json.dumps(record), file=out, flush=True)


if __name__ == "__main__":
    main()
