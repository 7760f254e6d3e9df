"""Headline queries at one scale; prints one JSON line."""

import json
import os
import sys
import time

from citeloom.catalogue import QUERIES, load_all, shared
from citeloom.session import build_session

HEADLINE = (
    "src3_text_blocks",
    "src3_html_blocks",
    "win9_packed_chunks",
    "fn15_redacted_documents",
    "agg1_lexical_hits",
    "jn3_hash_search",
    "jn3_vector_search",
    "jn4_rrf_fusion",
    "win2_greedy_dedup",
    "jn5_governed_candidates",
    "flt10_relevance_gate",
    "agg5_recall_precision",
    "agg13_arm_report",
    "agg3_chunk_integrity",
    "agg26_candidate_summary",
    "jn1_eligibility_reasons",
    "jn9_document_list",
    "win6_complete_turns",
    "mnt9_projected_cases",
    "agg23_question_groups",
    "agg29_usage_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session("bench", f"local[{cpus}]", driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    # Indexes hold nothing of the questions and are kept; what they cost is a line of its own.
    for name, build in (("build_lexical_index", shared.lexical_index), ("build_hash_index", shared.hash_index)):
        started = time.perf_counter()
        build(spark, folder)
        seconds[name] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        # Every query pays for its own search; only the indexes are carried over.
        shared.forget()
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
