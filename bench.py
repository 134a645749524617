"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from beamlake.plans import QUERIES

HEADLINE = ("signature_stats", "signature_export", "sensor_stats", "range_histogram", "class_name_campaign_sensor", "pose_interpolated", "rotate_vectors", "positional_join", "octree_cells", "assoc_point_top1", "assoc_beam_top1", "cell_view")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sensor_stats"](spark, sf).collect()  # starts the executors
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
