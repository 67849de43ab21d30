"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then RUNS times; its seconds are the median of complete runs
into a no-op sink. With --duckdb the same queries' SQL is timed in DuckDB as well.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = (
    "orders_check_sum_le orders_check_same check_counts link_orders_to_customers doc_fold_contains doc_facet_lang_source lang_status_pivot doc_value_key_dedup "
    "meta_range meta_validate inner_join_chain left_chain user_usage_with_counts events_by_month_tz usage_cost_by_kind three_way_diff current_value_per_slot supersede_chain "
    "first_flag_groups gap_fill_pages overlap_anti bool_search_and_or_not furniture_lines doc_tree sections_chunk cosine_topk sheet_pivot smallest_containing_box conv_history_trim"
).split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from folia import catalog
    from folia.session import session

    spark = session(f"local[{CPUS}]", int(CPUS), spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for k in range(RUNS + 1):
            began = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.perf_counter() - began)
        took[name] = round(median(times), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    out = {"metric": "total_seconds_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}
    if "--duckdb" in sys.argv:
        out["duckdb"] = duckdb_times(catalog.oracles())
    print(json.dumps(out))


def duckdb_times(sql: dict[str, str]) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": int(CPUS)})
    for f in os.listdir(SF_DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF_DIR}/{f}'")
    took = {}
    for name in HEADLINE:
        if name in sql:
            times = []
            for k in range(RUNS + 1):
                began = time.perf_counter()
                con.execute(sql[name]).to_arrow_table()
                if k:
                    times.append(time.perf_counter() - began)
            took[name] = round(median(times), 3)
    return took


if __name__ == "__main__":
    main()
