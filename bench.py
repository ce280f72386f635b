"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glossa.session import local_session, ship_by_value  # noqa: E402
from registry.queries import QUERIES  # noqa: E402

HEADLINE = (
    "assign_row_id", "column_stats", "json_profile", "json_keys", "column_report",
    "is_json_cell", "json_leaves", "json_rebuild", "estimate_tokens", "split_boundaries",
    "chunk_table", "chunk_deep", "chunk_pages", "dedupe_chunks", "resume_remaining", "job_state",
    "translate_plain", "translate_json", "translate_column", "translate_dataset",
    "translate_resumed", "write_roundtrip",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    ship_by_value()
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    QUERIES["estimate_tokens"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": total, "unit": "sec",
                "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
