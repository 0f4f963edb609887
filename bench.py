"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is run once to warm up, then up to three times within a few seconds; the median is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

import tamis
from tamis.operators.duplicates import duplicate_rows

from tamis.plans import views
from tamis.plans.catalog import QUERIES

RUNS = 3
ENOUGH_SECONDS = 5


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def whole_profile(name: str):
    return lambda spark, folder: drain(tamis.profile(views.read(spark, folder, name)))


def staff_masked(spark, folder) -> None:
    staff = views.staff(spark, folder)
    found = tamis.detections(tamis.detect(staff))
    drain(tamis.pseudonymise(staff, found, order_by="cle")[0])


HEADLINES = {
    "profile_lineitem": whole_profile("lineitem"),
    "profile_orders": whole_profile("orders"),
    "profile_documents": whole_profile("documents"),
    "profile_sales": lambda spark, folder: drain(QUERIES["profile_full"](spark, folder)),
    "duplicates_lineitem": lambda spark, folder: drain(duplicate_rows(views.read(spark, folder, "lineitem"))),
    "detect_documents": lambda spark, folder: drain(tamis.detect(views.read(spark, folder, "documents"))),
    "mask_staff": staff_masked,
    **{
        name: (lambda build: lambda spark, folder: drain(build(spark, folder)))(QUERIES[name])
        for name in (
            "csv_promote_numeric", "quality_score", "pii_detect", "pii_tokens", "pii_token_vault",
            "revenue_by_segment", "orphan_keys", "clean_replay", "priced_usage", "registry_listing",
        )
    },
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or list(HEADLINES)
    times = {}
    for name in wanted:
        HEADLINES[name](spark, folder)
        spent = []
        while len(spent) < RUNS and sum(spent) < ENOUGH_SECONDS:
            started = time.perf_counter()
            HEADLINES[name](spark, folder)
            spent.append(time.perf_counter() - started)
        times[name] = round(statistics.median(spent), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total of median query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
