"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "preprocessed_documents", "text_statistics_by_language", "exact_duplicates_dropped", "markdown_paragraphs", "default_chunks",
    "semantic_chunks", "retrieval_ranked", "bm25_ranked", "vector_ranked", "mmr_ranked", "document_summaries", "quality_report",
    "expanded_queries", "answers_merged_by_sentence", "fresh_events_by_type", "near_duplicate_keepers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from corpusflow import plans
    from corpusflow.session import local_session

    spark = local_session(cores, "corpusflow-bench", shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # start the Python workers and the code generator before the clock
    spark.range(100).mapInPandas(lambda batches: batches, "id bigint").count()
    queries, seconds = plans.queries(), {}
    if not sys.argv[1:]:
        # the stored index that the lexical queries read is built once, and counts as a query of its own
        from corpusflow.plans import retrieval

        start = time.time()
        for part in ("terms", "words"):
            retrieval.index(spark, folder, part)
        seconds["stored_index_built"] = round(time.time() - start, 3)
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    asked = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    result = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "documents": documents, "questions": asked,
    }
    if "preprocessed_documents" in seconds:
        result["documents_per_second_cleaned"] = round(documents / seconds["preprocessed_documents"], 1)
    if "retrieval_ranked" in seconds:
        result["milliseconds_per_question"] = round(1000 * seconds["retrieval_ranked"] / asked, 1)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
