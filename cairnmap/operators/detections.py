"""Relational parts of a segmenter's post-processing.  The model itself is a pluggable function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import polygons

#: Pixels that are blended in one step.
STEP = 1 << 20


def segment(tiles: DataFrame, model: Callable, schema: str) -> DataFrame:
    """Runs ``model``, a function of an iterator of Arrow batches, over tiles (image bytes and keys)."""
    return tiles.mapInArrow(model, schema)


def confident(detections: DataFrame, least: float = 0.5, score: str = "score") -> DataFrame:
    """Detections of a score of ``least`` or more."""
    return detections.where(F.col(score) >= least)


def combined_mask(detections: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    """The largest value of each pixel over a tile's instances; masks are arrays of rows of one size."""
    cells = detections.select(*keys, F.posexplode(mask).alias("_r", "_row")).select(*keys, "_r", F.posexplode("_row").alias("_c", "_v"))
    rows = cells.groupBy(*keys, "_r", "_c").agg(F.max("_v").alias("_v")).groupBy(*keys, "_r").agg(F.sort_array(F.collect_list(F.struct("_c", "_v"))).alias("_row"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "_row"))).alias("_m")).select(*keys, F.transform("_m", lambda r: F.transform(r["_row"], lambda c: c["_v"])).alias(mask))


def best_masks(detections: DataFrame, keys: Sequence[str], least: float = 0.5, score: str = "score", mask: str = "mask") -> DataFrame:
    """(*keys, mask): the largest value of each pixel over a tile's confident instances, as combined_mask() gives it, without
    a row for each pixel.  The instances of one tile meet in a task."""
    known = confident(detections, least, score).select(*keys, F.col(mask).cast("array<array<float>>").alias(mask))

    def run(group: pa.Table) -> pa.Table:
        best = None
        for m in group.column(mask):
            own = _square(m.values, 1)[0]
            best = own if best is None else np.maximum(best, own)
        return group.slice(0, 1).select(list(keys)).append_column(mask, pa.array([best.tolist()], pa.list_(pa.list_(pa.float32()))))

    return known.groupBy(*keys).applyInArrow(run, known.schema)


def _square(rows: pa.Array, n: int) -> np.ndarray:
    """n masks from the rows of all of them."""
    values = rows.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, len(rows) // n if n else 0, -1)


def hat(size: int) -> np.ndarray:
    """Weight of each pixel of a tile: the product of two hats, one along each axis, and 0.001 at least."""
    one = 1 - np.abs(2 * np.arange(size) / (size - 1) - 1) if size > 1 else np.ones(1)
    return np.maximum(one[:, None] * one[None, :], 0.001)


def blended_blocks(tiles: DataFrame, image: str = "image", left: str = "left", top: str = "top", mask: str = "mask", size: int = 500, cell: int = 100) -> DataFrame:
    """Overlapping soft masks of tiles -> (image, block_row, block_col, values) of a whole image: weighted means of all tiles
    over each pixel, sum(w v) / (sum(w) + 1e-6) in [0, 1], in blocks of ``cell`` x ``cell`` pixels, row by row.

    Tiles are ``size`` pixels wide and high and begin at multiples of ``cell``, which divides ``size`` (other tiles raise an
    error), so a block lies in a tile or outside it.  A tile is cut into blocks, single precision, and these are what
    moves; weights follow from the place in the tile.  Null masks count as no tile.  No image is ever in one task.
    """
    if size % cell:
        raise ValueError("cell has to divide size")
    per, kind = size // cell, tiles.schema[image].dataType.simpleString()
    schema = StructType.fromDDL(f"`{image}` {kind}, block_row int, block_col int, at_row int, at_col int, part binary")
    rows = tiles.where(F.col(mask).isNotNull()).select(image, F.col(top).cast("int").alias("_t"), F.col(left).cast("int").alias("_l"), F.col(mask).cast("array<array<float>>").alias("_m"))

    def cut(batches):
        for b in batches:
            n = b.num_rows
            place = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)]
            values = _square(b.column(3).flatten(), n) if n else np.zeros((0, size, size), np.float32)
            if values.shape[1:] != (size, size) or any((x % cell).any() for x in place):
                raise ValueError(f"tiles have to be {size} x {size} and begin at multiples of {cell}")
            blocks = np.ascontiguousarray(values.reshape(n, per, cell, per, cell).swapaxes(2, 3)).reshape(-1, cell * cell)
            tile = np.repeat(np.arange(n), per * per)
            row, col = np.tile(np.repeat(np.arange(per), per), n), np.tile(np.arange(per), per * n)
            ints = [pa.array(x.astype(np.int32)) for x in (place[0][tile] // cell + row, place[1][tile] // cell + col, row, col)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(tile)), *ints, pa.array([x.tobytes() for x in blocks], pa.binary())], names=schema.names)

    weights = np.ascontiguousarray(hat(size).reshape(per, cell, per, cell).swapaxes(1, 2)).reshape(per, per, cell * cell)
    keys, out = [image, "block_row", "block_col"], StructType.fromDDL(f"`{image}` {kind}, block_row int, block_col int, `values` array<double>")

    def blocks(at: pa.Table, total, weight):
        values = pa.array(np.clip(total / (weight + 1e-6), 0, 1).ravel())
        ends = pa.array(np.arange(0, total.size + 1, cell * cell, dtype=np.int32))
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in at.columns), pa.ListArray.from_arrays(ends, values)], names=out.names)

    def blend(batches):
        # Parts of a block come one after the other, in the order of their places in the tile; the last block stays open.
        open_ = None
        for whole in batches:
            for lo in range(0, whole.num_rows, most):
                b = whole.slice(lo, most)
                at = pa.Table.from_batches([b]).select(keys)
                weight = weights[b.column("at_row").to_numpy(), b.column("at_col").to_numpy()]
                total = weight * np.frombuffer(b"".join(b.column("part").to_pylist()), np.float32).reshape(b.num_rows, -1)
                if open_:
                    at, total, weight = pa.concat_tables([open_[0], at]), np.concatenate([open_[1], total]), np.concatenate([open_[2], weight])
                first = np.flatnonzero(np.concatenate([[True], _changes(at)]))
                block = np.repeat(np.arange(len(first)), np.diff([*first, len(total)]))
                sums, place = (total[first], weight[first]), np.arange(len(total)) - first[block]
                order = np.argsort(place, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1)[1:]:
                    for x, part in zip(sums, (total, weight)):
                        x[block[rows]] += part[rows]
                at = at.take(pa.array(first))
                if len(first) > 1:
                    yield blocks(at.slice(0, len(first) - 1), *(x[:-1] for x in sums))
                open_ = at.slice(len(first) - 1), *(x[-1:] for x in sums)
        if open_:
            yield blocks(*open_)

    most = max(1, STEP // (cell * cell))
    cuts = rows.mapInArrow(cut, schema).repartition(*keys).sortWithinPartitions(*keys, "at_row", "at_col")
    return cuts.mapInArrow(blend, out)


def _changes(keys: pa.Table) -> np.ndarray:
    """Which rows but the first differ from the row before; nulls are equal."""
    differ = np.zeros(max(0, len(keys) - 1), bool)
    for c in (c.combine_chunks() for c in keys.columns):
        a, b = c.slice(0, len(differ)), c.slice(1)
        differ |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return differ


def windows(blocks: DataFrame, tiles: DataFrame, image: str = "image", left: str = "left", top: str = "top", size: int = 500, cell: int = 100) -> DataFrame:
    """tiles (image, left, top, ...) with ``mask``, an array of rows, from the blended blocks under them: what one tile saw of
    a building at its edge is now what all tiles saw.  Pixels without a block are 0; tiles without any give no row."""
    per, keys = size // cell, [c for c in tiles.columns if c != "mask"]
    own = tiles.select(*keys).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    own = own.withColumns({"block_row": (F.col(top) / cell).cast("int") + F.col("_i"), "block_col": (F.col(left) / cell).cast("int") + F.col("_j")})
    under = own.join(blocks.hint("merge"), [image, "block_row", "block_col"]).select(*keys, "_i", "_j", "values")

    def put(group: pa.Table) -> pa.Table:
        whole = np.zeros((size, size))
        for i, j, values in zip(*(group.column(x) for x in ("_i", "_j", "values"))):
            r, c = i.as_py() * cell, j.as_py() * cell
            whole[r : r + cell, c : c + cell] = values.values.to_numpy().reshape(cell, cell)
        return group.slice(0, 1).select(keys).append_column("mask", pa.array([whole.tolist()], pa.list_(pa.list_(pa.float64()))))

    return under.groupBy(*keys).applyInArrow(put, StructType([*tiles.select(*keys).schema.fields, *StructType.fromDDL("mask array<array<double>>").fields]))


def blended_polygons(detections: DataFrame, keys: Sequence[str], image: str = "image", size: int = 500, cell: int = 100, least_score: float = 0.5, least_area: float = 50.0, tolerance: float = 2.0) -> DataFrame:
    """keys (image, left, top, ...) and polygons: a model's instances on overlapping tiles are combined by tile, blended over
    the image, and outlined tile by tile.  A tile on which the model is sure of nothing counts with zeros."""
    seen = detections.select(*keys).distinct()
    masks = seen.join(best_masks(detections, keys, least_score), list(keys), "left")
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), size), size)
    masks = masks.withColumn("mask", F.coalesce("mask", zeros))
    return polygons.masks_to_polygons(windows(blended_blocks(masks, image, size=size, cell=cell), seen, image, size=size, cell=cell), least_area=least_area, tolerance=tolerance)


def to_polygons(detections: DataFrame, keys: list[str], least_score: float = 0.5, least_area: float = 50.0, tolerance: float = 2.0) -> DataFrame:
    """keys, polygons: confident instances combined, outlined and simplified; tiles without one give no row."""
    return polygons.masks_to_polygons(combined_mask(confident(detections, least_score), keys), least_area=least_area, tolerance=tolerance)


def query_pool(queries: DataFrame, key: str, order: str, per_key: int = 5, total: int = 20) -> DataFrame:
    """Up to ``per_key`` queries of each key in order, until ``total`` is reached; a key that reaches it is taken whole."""
    first = queries.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= per_key)
    # Each key has a query at least, so the first ``total`` keys decide: what is summed and sent is bounded by that.
    sizes = first.groupBy(key).agg(F.count("*").alias("_n")).orderBy(key).limit(total)
    before = F.coalesce(F.sum("_n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.join(F.broadcast(sizes.withColumn("_before", before).where(F.col("_before") < total).select(key)), key).drop("_r")
