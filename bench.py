"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query is run once to warm up and then timed, written to Spark's no-op sink."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

HEADLINE = """
scan_all filter_eq_key filter_eq_string filter_ne between_int between_double point_projection radius_small radius_large knn point_exact order_by
where_order_by page_range delete_eq upsert_pk row_count csv_roundtrip tx_conflicts tx_summary lock_contention deadlock_cycle lookup_bucketed lookup_clustered lookup_grid
""".split()


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    from granary.plans import catalogue
    from granary.plans.tables import Table
    from granary.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="granary-bench-")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{folder}"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}

    def timed(name, run):
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 4)

    for name in HEADLINE:
        run = lambda q=queries[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        timed(name, run)

    # the published micro-benchmark's shape: bulk load, point and range lookups on a keyed table of 100,000 rows
    rows = spark.range(100_000).selectExpr("cast(id as int) id", "cast(id % 250 as int) country_id", "cast(id % 180 as float) latitude", "cast(id % 360 as float) longitude", "concat('city ', id) name")
    columns = {"id": "int", "country_id": "int", "latitude": "float", "longitude": "float", "name": "char(40)"}
    keys = [(7919 * i) % 100_000 for i in range(200)]
    for how in ("btree", "sequential", "hash"):
        table = Table.create(spark, f"file://{folder}/tables", f"cities_{how}", columns, primary_key="id", pk_index_type="sequential" if how == "sequential" else "btree")
        if how == "hash":
            table.drop_index("id")
            table.create_index("id", "hash")
        timed(f"load_100k_{how}", lambda t=table: t.insert_frame(rows, "id"))
        table.select("id", 7).collect()
        timed(f"point_lookup_{how}", lambda t=table: t.select("id", 54_321).collect())
        table.select_many("id", keys).collect()
        timed(f"lookups_200_{how}", lambda t=table: t.select_many("id", keys).collect())
        timed(f"range_500_{how}", lambda t=table: t.select_range("id", 40_000, 40_500).collect())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
