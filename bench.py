"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tallywell.catalog import QUERIES
from tallywell.session import local_session

HEADLINE = [
    "month_closing", "parse_amount_source", "parse_category", "account_cascade", "category_lookup",
    "transfer_split", "rule_apply", "rule_match", "dup_exact", "dup_near", "dup_flags", "ttl_cache_hits",
    "balances_applied", "running_balance", "quota_admission", "csv_import", "import_audit",
    "constraint_violations", "month_summary", "spending_by_category", "recent_10", "ledger_posted",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tallywell-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start-up is not part of any query
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
