"""Headline queries on one data folder: prints one JSON line with the seconds of each.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores; arguments choose
queries. Each query runs whole into a no-op sink, twice; the second run counts, so that the start of Python workers and the
compilation of a plan do not. The seconds of the first runs are given beside them.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from civicspark.plans.catalog import QUERIES
from civicspark.session import build_session

HEADLINE = [
    "join_anti_not_exists", "join_anti_left_null", "join_anti_left_null_dedup", "report_wide", "join_star_n", "join_three", "join_tract",
    "join_contains_name", "geo_nearest", "geo_nearest_many_places", "geo_nearest_geodesic", "geo_within_radius", "geo_point_in_polygon",
    "geo_geocode_lookup", "agg_pivot_history", "agg_turnout_by_tract", "agg_histogram", "agg_profile_width", "win_ecdf", "win_first_seen",
    "win_fill_same_address", "win_surrogate_key", "sample_exact", "sample_stratified_exact", "dedup_cascade", "upsert_update",
    "set_insert_absent", "json_flatten_place", "src_html_table", "src_csv", "ei_bounds", "ei_goodman_weighted", "ei_posterior_summary",
    "ei_precinct_summary", "ei_fit_band", "ei_candidate_of_choice", "fair_set_objective", "fair_pareto", "ml_prepare", "ml_auc",
    "ml_roc_points", "ml_logistic", "ml_counterfactual", "ml_per_tract", "inc_backlog",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
                                                        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["join_star_n"](spark, folder).write.format("noop").mode("overwrite").save()
    first, seconds = {}, {}
    for name in names:
        for run in (first, seconds):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            run[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "first_run": first,
                      "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
