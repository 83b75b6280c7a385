"""Wall-clock seconds of the headline queries; one JSON line."""

import json
import os
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + ":" + os.environ.get("PYTHONPATH", "")

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairnmap.operators import knn, knn_index
from cairnmap.plans.registry import QUERIES
from cairnmap.sources import shared

HEADLINE = "knn_l1_k5 knn_l2_k5 knn_l1_k20 plurality_vote weighted_vote gt_vote_rank k_sweep_accuracy metric_bundle metrics_by_site metrics_by_season metrics_overall_and_site coverage vote_diagnostics variant_metrics error_ecdf pixel_confusion quantile_cap box_iou_match overlap_blend tile_grid latlon_to_pixel error_meters fuzzy_bounds resume_anti_join polygon_descriptors dmax_sweep locate_images".split()


def reference_scale(spark):
    """300 five-component queries against 600,000 descriptors, k = 5, L1: by a scan, and in an index that is stored before."""
    unit = lambda i, j: F.pmod(F.xxhash64(i, F.lit(j)), F.lit(1_000_003)) / 1_000_003.0 * 180
    rows = spark.range(600_000, numPartitions=32).select(F.col("id").alias("index_id"), F.array(*(unit("id", j) for j in range(5))).cast("array<float>").alias("vec"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.array(*(unit("id", j + 9) for j in range(5))).cast("array<float>").alias("vec"))
    rows, asked = rows.persist(), asked.persist()
    rows.count(), asked.count()
    stored = knn_index.build(rows, shared.fresh(spark, "bench"))
    return {"knn_300x600k": lambda: knn.knn_join(asked, rows, 5), "knn_index_300x600k": lambda: knn_index.search(asked, stored, 5)}


def calibration():
    """Seconds of a fixed piece of work on one core, so that runs on other machines compare."""
    began = time.time()
    sum(range(20_000_000))
    return time.time() - began


def main():
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = {n: (lambda q=QUERIES[n]: q(spark, sf_dir)) for n in HEADLINE} | reference_scale(spark)
    seconds = {}
    for name, query in run.items():
        times = []
        for _ in range(2):
            began = time.time()
            query().write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        seconds[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "geomean": round(float(np.exp(np.mean(np.log(list(seconds.values()))))), 4), "calibration": round(min(calibration() for _ in range(3)), 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
