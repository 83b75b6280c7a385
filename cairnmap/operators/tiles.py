"""Sliding-window tiles over maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATCH, STRIDE = 500, 100


def starts(length: Column, patch: int = PATCH, stride: int = STRIDE) -> Column:
    """Tile starts along one axis: every ``stride``, and a last one that ends at the border."""
    last = F.greatest(length - patch, F.lit(0)).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def tile_count(width: Column, height: Column, patch: int = PATCH, stride: int = STRIDE) -> Column:
    along = lambda n: F.greatest(F.lit(1), F.ceil(F.greatest(n - patch, F.lit(0)) / stride) + 1).cast("long")
    return along(width) * along(height)


def tile_grid(maps: DataFrame, name: str, width: str, height: str, patch: int = PATCH, stride: int = STRIDE, limit: int | None = None) -> DataFrame:
    """maps with tile_row, tile_col, left, top, patch_id; row by row.  A null size gives no tile.  ``limit`` keeps the first
    tiles of each map."""
    grid = maps.select("*", F.posexplode(starts(F.col(height), patch, stride)).alias("tile_row", "top")).select("*", F.posexplode(starts(F.col(width), patch, stride)).alias("tile_col", "left"))
    if limit is not None:
        per_row = F.size(starts(F.col(width), patch, stride))
        grid = grid.where(F.col("tile_row") * per_row + F.col("tile_col") < limit)
    return grid.withColumn("patch_id", F.format_string("%s_%04d_%04d", F.col(name).cast("string"), "tile_row", "tile_col"))


def training_starts(length: Column, patch: int, stride: int) -> Column:
    return F.when(length <= patch, F.array(F.lit(0))).otherwise(starts(length, patch, stride))


def blend_weight(position: Column, size: int, least: float = 0.001) -> Column:
    """Hat-shaped weight along one axis of a tile."""
    half = (size - 1) / 2
    return F.greatest(F.lit(least), 1 - F.abs(position - half) / (half if half else 1.0))
