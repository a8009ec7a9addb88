"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rosterline.plans.catalog import QUERIES  # noqa: E402
from rosterline.session import local_session  # noqa: E402

HEADLINE = [
    "extract_emails", "extract_phones", "html_to_text", "rank_contact_links", "person_blocks", "extract_contacts",
    "crm_category", "export_projection", "dedup_merge", "normalization_report", "propagate_inn_kpp", "apply_corrections",
    "block_domains", "block_any", "fuzzy_dictionary_join", "token_budget_cutoff", "progress_track", "task_totals",
    "correction_prompts", "stream_upsert_merge", "site_contacts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(2):  # the better of two: the first one also loads and compiles code
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(min(took), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
