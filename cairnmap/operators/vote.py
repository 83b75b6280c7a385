"""Votes of matches for patches of the map: plurality, distance-weighted, ranked, and their diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _over(image: Sequence[str]):
    return Window.partitionBy(*image) if image else Window.partitionBy(F.lit(1))


def vote_counts(matches: DataFrame, image: Sequence[str] = ("image",), patch: str = "patch") -> DataFrame:
    """(*image, patch, votes, weight): matches and sum of 1 / (1 + distance) for each voted patch."""
    return matches.groupBy(*image, patch).agg(F.count("*").alias("votes"), F.sum(1 / (1 + F.col("distance"))).alias("weight"))


def ranked_votes(counts: DataFrame, image: Sequence[str] = ("image",), patch: str = "patch", by: str = "votes", n: int | None = None) -> DataFrame:
    """counts with rank 1, 2, ... by descending ``by``, then patch; the first n of each image."""
    out = counts.withColumn("rank", F.row_number().over(_over(image).orderBy(F.desc(by), F.asc(patch))))
    return out.where(F.col("rank") <= n) if n is not None else out


def plurality(matches: DataFrame, image: Sequence[str] = ("image",), patch: str = "patch", patches_in_index: int | None = None) -> DataFrame:
    """(*image, winner, votes, runner_up, margin, total_votes, n_voted): most votes, ties to the smallest patch; no second
    patch counts as 0.  Images without matches give no row."""
    ranked = ranked_votes(vote_counts(matches, image, patch), image, patch)
    total = ranked.groupBy(*image).agg(F.max(F.when(F.col("rank") == 1, F.col(patch))).alias("winner"), F.max("votes").alias("votes"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("votes"))), F.lit(0)).alias("runner_up"), F.sum("votes").alias("total_votes"), F.count("*").alias("n_voted"))
    return total.withColumn("margin", F.col("votes") - F.col("runner_up"))


def plurality_first_seen(matches: DataFrame, image: Sequence[str] = ("image",), patch: str = "patch", ordinal: str = "ordinal") -> DataFrame:
    """(*image, winner, votes): most votes, ties to the patch that was matched first."""
    seen = matches.groupBy(*image, patch).agg(F.count("*").alias("votes"), F.min(ordinal).alias("first"))
    return seen.groupBy(*image).agg(F.max_by(patch, F.struct("votes", -F.col("first"))).alias("winner"), F.max("votes").alias("votes"))


def weighted(matches: DataFrame, image: Sequence[str] = ("image",), patch: str = "patch") -> DataFrame:
    """(*image, winner, weight, shown_votes, runner_up_weight): the largest sum of 1 / (1 + distance); shown votes are cut to
    whole numbers, the order uses the sums."""
    ranked = ranked_votes(vote_counts(matches, image, patch), image, patch, by="weight")
    out = ranked.groupBy(*image).agg(F.max(F.when(F.col("rank") == 1, F.col(patch))).alias("winner"), F.max("weight").alias("weight"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("weight"))), F.lit(0.0)).alias("runner_up_weight"))
    return out.withColumn("shown_votes", F.col("weight").cast("long"))


def vote_map(matches: DataFrame, image: Sequence[str] = ("image",), patch: str = "patch") -> DataFrame:
    """(*image, all_votes): map of patch to votes."""
    return vote_counts(matches, image, patch).groupBy(*image).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(patch, "votes")))).alias("all_votes"))


def truth_rank(matches: DataFrame, truth: DataFrame, image: Sequence[str] = ("image",), patch: str = "patch") -> DataFrame:
    """truth (*image, patch) with gt_votes and gt_rank = 1 + patches with more votes; rank null without votes."""
    counts = vote_counts(matches, image, patch).withColumn("gt_rank", F.rank().over(_over(image).orderBy(F.desc("votes"))))
    return truth.join(counts.select(*image, patch, F.col("votes").alias("gt_votes"), "gt_rank"), [*image, patch], "left").withColumn("gt_votes", F.coalesce("gt_votes", F.lit(0)))


def top_one(matches: DataFrame, image: Sequence[str] = ("image",), patch: str = "patch") -> DataFrame:
    """(*image, winner, distance): the patch of the single closest match, first query on a tie; no vote."""
    return matches.groupBy(*image).agg(F.min_by(patch, F.struct("distance", "query_id", "index_id")).alias("winner"), F.min("distance").alias("distance"))


def patch_centroids(descriptors: DataFrame, patch: str = "patch", x: str = "x", y: str = "y") -> DataFrame:
    """(patch, centroid_x, centroid_y, n), centroids in single precision from double sums."""
    return descriptors.groupBy(patch).agg(F.avg(F.col(x).cast("double")).cast("float").alias("centroid_x"), F.avg(F.col(y).cast("double")).cast("float").alias("centroid_y"), F.count("*").alias("n"))
