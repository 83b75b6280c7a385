"""Error metrics and their break-downs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import order

RECALL_AT = (10, 20, 50)
#: Steps of a distribution function that one row stands for while they are dealt.
STRETCH = 65_536


def finite(value: Column) -> Column:
    """Whether a value is neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def bundle(error: str = "error_m", at: Sequence[int] = RECALL_AT) -> list[Column]:
    """Aggregates: count, mean, median, RMSE and recall in per cent; nulls for no rows.  The exact median's buffer has an
    entry for each distinct error; records store errors in hundredths of a metre, which bounds it."""
    e = F.when(finite(F.col(error).cast("double")), F.col(error).cast("double"))
    recall = [(100 * F.avg((e <= t).cast("int"))).alias(f"recall_{t}") for t in at]
    return [F.count(e).alias("n"), F.avg(e).alias("mean"), F.median(e).alias("median"), F.sqrt(F.avg(e * e)).alias("rmse"), *recall]


def metrics_by(records: DataFrame, keys: Sequence[str] = (), error: str = "error_m", extra: Sequence[Column] = (), any_values: bool = False) -> DataFrame:
    """The bundle for each group; rows with a null key are left out.  ``any_values``: for errors that are not stored to
    hundredths, as many distinct ones as rows, the median is found by refinement (order.quantile), in bounded memory."""
    for k in keys:
        records = records.where(F.col(k).isNotNull())
    if any_values:
        names = ["n", "mean", "median", "rmse", *(f"recall_{t}" for t in RECALL_AT)]
        rest = [c for n, c in zip(names, bundle(error)) if n != "median"]
        found = (records.groupBy(*keys) if keys else records).agg(*rest, *extra)
        median = order.quantile(records, keys, error, 0.5, "median").drop("n")
        found = found.join(median, list(keys), "left") if keys else found.join(F.broadcast(median), how="left")  # one row each
        return found.select(*keys, *names, *(c for c in found.columns if c not in (*keys, *names)))
    return records.groupBy(*keys).agg(*bundle(error), *extra) if keys else records.agg(*bundle(error), *extra)


def metrics_and_total(records: DataFrame, key: str, error: str = "error_m", total: str = "overall") -> DataFrame:
    """The bundle for each group and, pooled, for all rows (key = ``total``), in one pass."""
    known = records.where(F.col(key).isNotNull())
    return known.rollup(key).agg(F.grouping(key).alias("_all"), *bundle(error)).withColumn(key, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(key))).drop("_all")


def evaluable(records: DataFrame, with_truth: bool = False) -> DataFrame:
    """Records with an error and descriptors (and, for ablations, a true position)."""
    kept = records.where("error_m is not null and n_descriptors > 0")
    return kept.where("gt_px_x is not null") if with_truth else kept


def coverage(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Over all records: total, with descriptors, per cent, mean number of descriptors."""
    has = F.col("n_descriptors") > 0
    aggs = [F.count("*").alias("total"), F.count_if(has).alias("with_descriptors"), (100 * F.avg(F.coalesce(has.cast("int"), F.lit(0)))).alias("coverage_pct"), F.avg("n_descriptors").alias("avg_descriptors")]
    return records.groupBy(*keys).agg(*aggs) if keys else records.agg(*aggs)


def vote_diagnostics(records: DataFrame, keys: Sequence[str] = ("site",), within: int = 100) -> DataFrame:
    """Inlier ratio, margin, least winning votes, share of true patches ranked within ``within`` (no rank: a miss)."""
    for k in keys:
        records = records.where(F.col(k).isNotNull())
    inlier = 100 * F.avg(F.coalesce("gt_patch_votes", F.lit(0)) / F.greatest("total_votes", F.lit(1)))
    hit = 100 * F.avg(F.coalesce((F.col("gt_patch_rank") <= within).cast("int"), F.lit(0)))
    return records.groupBy(*keys).agg(inlier.alias("inlier_ratio_pct"), F.avg("margin").alias("avg_margin"), F.min("votes").alias("min_winning_votes"), hit.alias(f"gt_in_top_{within}_pct"))


def runtimes(records: DataFrame) -> DataFrame:
    return records.agg(*(F.avg(c).alias(f"avg_{c}") for c in ("t_total", "t_query", "t_segment")))


def ecdf(records: DataFrame, key: str, error: str = "error_m") -> DataFrame:
    """(key, error, fraction): i / n of the i-th smallest error; equal errors step one by one.  Only distinct errors are
    ranked; records store them in hundredths of a metre, so their number has a bound, whatever the number of records."""
    known = records.where(F.col(key).isNotNull() & finite(F.col(error).cast("double")))
    steps, at = known.groupBy(key, error).agg(F.count("*").alias("_n")), Window.partitionBy(key)
    steps = steps.withColumns({"_upto": F.sum("_n").over(at.orderBy(error)), "_all": F.sum("_n").over(at)})
    # A common error stands for many steps: they are dealt in stretches before they are written out.
    parts = steps.select(key, error, "_all", "_upto", F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, F.col("_upto"), F.lit(STRETCH))).alias("_i"))
    parts = parts.hint("rebalance")
    each = parts.select(key, error, "_all", F.explode(F.sequence("_i", F.least(F.col("_i") + STRETCH - 1, F.col("_upto")))).alias("_i"))
    return each.select(key, error, (F.col("_i") / F.col("_all")).alias("fraction"))


def confusion(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Micro-averaged counts with precision, recall, F1 and IoU; 0 where a denominator is 0."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counts = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp + fn).alias("iou"))


def quantile_cap(rows: DataFrame, key: str, area: str, image_area: Column | float, fraction: float = 0.95, quantile: float = 0.995, least: int = 4, any_values: bool = False) -> DataFrame:
    """Rows of an area up to its group's cap: ``fraction`` of the image, and from ``least`` rows on also the quantile
    (interpolated, at least 1).  The caps are joined back on the key, so a large group is not gathered; the quantile's
    buffer has an entry for each distinct area, at most the image's pixels.  ``any_values``: for areas that are no numbers
    of pixels, the quantile is found by refinement (order.quantile), in bounded memory."""
    hard = (image_area if isinstance(image_area, Column) else F.lit(float(image_area))) * fraction
    if any_values:
        caps = order.quantile(rows, [key], area, quantile, "_q").withColumnRenamed("n", "_n")
    else:
        caps = rows.groupBy(key).agg(F.count(area).alias("_n"), F.percentile(area, quantile).alias("_q"))
    cap = F.when(F.col("_n") >= least, F.least(F.greatest("_q", F.lit(1.0)), hard)).otherwise(hard)
    return rows.join(caps, key).withColumn("cap", cap).where(F.col(area) <= F.col("cap")).drop("_n", "_q")


def blended(pixels: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of overlapping values, sum(w v) / (sum(w) + 1e-6), kept in [0, 1]."""
    mean = F.sum(F.col(weight) * F.col(value)) / (F.sum(weight) + 1e-6)
    return pixels.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("blended"))


def iou_matches(left: DataFrame, right: DataFrame, image: str, left_id: str, right_id: str, iou, least: float = 0.5, boxes: tuple | None = None, cell: float | None = None) -> DataFrame:
    """For each left box its best right box of the same image, where they overlap by more than ``least``.

    With ``boxes`` (x0, y0, x1, y1 of either side as two lists of column names) and ``cell``, only boxes that reach into one
    cell of a grid meet: an image with many boxes is not squared.  The grid has levels, of cells twice as wide each: a box
    lies in four cells at most of the first level that is as wide as it is, and of each wider one up to that of the image's
    largest box; two boxes meet at the level of the larger.  Pairs that meet in several cells count once."""
    keys = [image]
    if boxes:
        wide = lambda b: F.greatest(F.col(b[2]) - F.col(b[0]), F.col(b[3]) - F.col(b[1]))
        own = lambda b: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide(b) / cell, F.lit(1.0)))).cast("int"))
        left, right = left.withColumn("_own", own(boxes[0])), right.withColumn("_own", own(boxes[1]))
        tops = left.select(image, "_own").unionByName(right.select(image, "_own")).groupBy(image).agg(F.max("_own").alias("_top"))

        def spread(df, b):
            df = df.join(tops, image).select("*", F.explode(F.sequence("_own", "_top")).alias("_level")).drop("_top")
            side = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
            for lo, hi, name in ((b[0], b[2], "_cx"), (b[1], b[3], "_cy")):
                df = df.select("*", F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))).alias(name))
            return df

        left, right = spread(left, boxes[0]), spread(right, boxes[1]).withColumnRenamed("_own", "_other")
        keys = [image, "_level", "_cx", "_cy"]
    both = left.join(right, keys).withColumn("iou", iou)
    both = both.where(F.greatest("_own", "_other") == F.col("_level")) if boxes else both
    best = both.groupBy(image, left_id).agg(F.max_by(right_id, F.struct("iou", -F.col(right_id))).alias(right_id), F.max("iou").alias("iou"))
    return best.where(F.col("iou") > least)


def codes(rows: DataFrame, column: str) -> DataFrame:
    """(column, code, n): the distinct values that are not null, numbered from 0 in order; one row a value.

    Values are dealt to ranges and written, each range numbers its own, and the sizes of the ranges before are added; the
    driver sees a number for each range."""
    spark, path = rows.sparkSession, shared.fresh(rows.sparkSession, "codes")
    found = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The running number of a row counts from 2^33 times its task's number on.
    numbered = found.repartitionByRange(ranges, column).sortWithinPartitions(column).select("*", F.monotonically_increasing_id().alias("_at"))
    numbered.select(column, "n", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).write.parquet(path)
    stored, before, offsets = spark.read.parquet(path), 0, []
    for r in stored.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    offsets = spark.createDataFrame(offsets, "_range long, _before long")
    return stored.join(F.broadcast(offsets), "_range").select(column, (F.col("_before") + F.col("_at")).alias("code"), "n")


def index_size(index: DataFrame, patch: str = "patch", keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, n_descriptors, n_patches, mb) of an index, at 32 bytes a descriptor."""
    aggs = [F.count("*").alias("n_descriptors"), F.count_distinct(patch).alias("n_patches"), F.round(F.count("*") * 32 / 1048576, 1).alias("mb")]
    return index.groupBy(*keys).agg(*aggs) if keys else index.agg(*aggs)
