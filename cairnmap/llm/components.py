"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable, for every id that has a link.  Rounds are written to the
    shared folder; the number of rounds grows with the logarithm of a component's size."""
    now = work.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    was, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        new = work.save(small, f"{name}-{step}")
        print_ = new.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        work.drop(f"{name}-{step - 1}")
        now = new
        if (print_.n, print_.x) == was:
            break
        was = (print_.n, print_.x)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
