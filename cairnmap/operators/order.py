"""Exact order statistics and places in groups of any size, without a buffer of their values.

For statistics a mergeable sketch of bounded size brackets the wanted rank; the values inside the bracket are counted exactly, the others by
side.  Of a group of n values about 6 n / ``accuracy`` are ranked, whatever the values are; a group of fewer than
``accuracy`` values is ranked whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared


def quantile(rows: DataFrame, keys: Sequence[str], value: str, probability: float, name: str = "quantile", accuracy: int = 10_000) -> DataFrame:
    """(*keys, n, name): the interpolated quantile of the finite values of each group (the value at (n - 1) * probability,
    between neighbours in proportion).  Null keys are a group; groups without a finite value give no row."""
    if not 0 <= probability <= 1:
        raise ValueError("probability must be from 0 to 1")
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*keys, (v + 0.0).alias("_v"))
    around = [min(1.0, max(0.0, probability + sign * 3 / accuracy)) for sign in (-1, 1)]
    sketch = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", [*around], accuracy).alias("_b"))
    whole = F.col("n") < accuracy
    sketch = sketch.withColumns({"_lo": F.when(~whole, F.col("_b")[0]), "_hi": F.when(~whole, F.col("_b")[1])}).drop("_b")
    if keys:
        sketch = sketch.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
        both = known.join(sketch, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    else:
        both = known.join(F.broadcast(sketch))  # one row
    # Below the bracket all values count as one, and above it none is needed.
    place = F.when(F.col("_v") < F.col("_lo"), F.lit(None)).otherwise(F.col("_v"))
    counts = both.where(F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi"))).groupBy(*keys, "n", place.alias("_v")).agg(F.count("*").alias("_c"))
    over = Window.partitionBy(*keys, "n").orderBy(F.asc_nulls_first("_v"))
    ranked = counts.withColumn("_upto", F.sum("_c").over(over))
    at = (F.col("n") - 1) * F.lit(float(probability))
    low, high = F.floor(at), F.ceil(at)
    inside = lambda r: (F.col("_upto") - F.col("_c") <= r) & (r < F.col("_upto"))
    picked = ranked.groupBy(*keys, "n").agg(F.max(F.when(inside(low), F.col("_v"))).alias("_x"), F.max(F.when(inside(high), F.col("_v"))).alias("_y"), F.min(F.col("_upto") - F.col("_c")).alias("_first"))
    missed = F.raise_error(F.lit("the sketch's bracket misses the rank")).cast("double")
    found = F.when(F.col("_x").isNull() | F.col("_y").isNull(), missed).otherwise(F.col("_x") + (F.col("_y") - F.col("_x")) * (at - low))
    return picked.select(*keys, "n", found.alias(name))


def places(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """rows with ``name``: how many rows of the same keys come before, by ``order`` (ties in any order).  Null keys are a
    group; nulls of ``order`` come first.

    Rows are dealt to ranges of keys and order and written, so a large group is spread over many tasks.  Each range numbers
    its own rows; what a group has in the ranges before is added, from one number for each group and range."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    # The running number of a row counts from 2^33 times its task's number on.
    dealt = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    stored = shared.saved(dealt, "places").withColumn("_range", F.shiftright("_at", 33))
    runs = stored.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_range").alias("_in")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(f"_key{i}" for i in range(len(keys)))).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return stored.join(runs, [F.col("_range") == F.col("_in"), *same]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
