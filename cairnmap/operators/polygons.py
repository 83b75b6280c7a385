"""Polygon columns -> descriptor rows, by Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geometry, many_polygons

POLYGON = "array<array<double>>"


def explode_polygons(rows: DataFrame, polygons: str = "polygons") -> DataFrame:
    """A row for each polygon of three points or more, with its number."""
    others = [c for c in rows.columns if c != polygons]
    return rows.select(*others, F.posexplode(polygons).alias("polygon_idx", "polygon")).where(F.size("polygon") >= 3)


def below_share(rows: DataFrame, area: str, image_area: float, share: float = 0.2, least: float | None = None) -> DataFrame:
    """Rows of an area under ``share`` of the image, and of ``least`` or more where that is given."""
    kept = rows.where(F.col(area) < share * image_area)
    return kept if least is None else kept.where(F.col(area) >= least)


def _corners(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The corners (x, y) of all polygons one after the other, and how many each has; none for a null."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    corners = column.flatten()
    if corners.null_count or pc.any(pc.not_equal(pc.list_value_length(corners), 2)).as_py():
        raise ValueError("the corners of a polygon have to be (x, y)")
    return corners.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2), sizes


def polygon_descriptors(rows: DataFrame, polygon: str = "polygon", cap: int | tuple[int, ...] = 4, offset: tuple[str, str] | None = None, kind: str = "float") -> DataFrame:
    """A row for each interior triangle of each polygon: the other columns, triangle_idx, alpha1, alpha2, e1, e2, e3 and the
    triangle's centre (moved by the offset columns), in single precision or as ``kind``, double, says.  Null and degenerate
    polygons give no row.  With several caps the rows of each, and its number in column cap."""
    caps = cap if isinstance(cap, tuple) else (cap,)
    others = [c for c in rows.columns if c != polygon]
    schema = rows.select(*others).schema.add("triangle_idx", "integer")
    for c in ("alpha1", "alpha2", "e1", "e2", "e3", "centroid_x", "centroid_y"):
        schema = schema.add(c, kind)
    if caps is cap:
        schema = schema.add("cap", "integer")
    precision = np.float32 if kind == "float" else np.float64

    def run(batches):
        for batch in batches:
            of, grown, number, values, centre = many_polygons.descriptors(*_corners(batch.column(polygon)), caps)
            centre = centre.astype(precision).astype(float)
            for i, c in enumerate(offset or ()):
                centre[:, i] += batch.column(c).to_numpy(zero_copy_only=False)[of]
            columns = [pa.array(v.astype(precision)) for v in (*values.T, *centre.T)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in others), pa.array(number.astype(np.int32)), *columns, *([pa.array(np.array(caps, np.int32)[grown])] if caps is cap else [])], names=schema.names)

    # The work for a polygon far exceeds its bytes, so files do not set the number of tasks.
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*others, polygon).repartition(spread).mapInArrow(run, schema)


def as_vector(descriptors: DataFrame) -> DataFrame:
    """descriptors with vec = [alpha1, alpha2, e1, e2, e3]."""
    return descriptors.withColumn("vec", F.array("alpha1", "alpha2", "e1", "e2", "e3").cast("array<float>"))


def simplify_polygons(rows: DataFrame, polygon: str = "polygon", tolerance: float = 2.0) -> DataFrame:
    """rows with the polygon simplified (Douglas-Peucker); null stays null."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(polygon)
            new = [None if p is None else geometry.simplify(p, tolerance).tolist() for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.list_(pa.list_(pa.float64()))) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.withColumn(polygon, F.col(polygon).cast(POLYGON)).mapInArrow(run, rows.withColumn(polygon, F.col(polygon).cast(POLYGON)).schema)


def masks_to_polygons(rows: DataFrame, mask: str = "mask", least_area: float = 50.0, tolerance: float = 2.0, threshold: float = 0.5) -> DataFrame:
    """rows with the simplified outlines (three points or more) of a soft mask, an array of rows."""
    schema = rows.drop(mask).schema.add("polygons", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(mask)
            found = []
            for m in batch.column(at).to_pylist():
                rings = geometry.outlines(np.array(m) > threshold, least_area) if m else []
                found.append([r.tolist() for r in (geometry.simplify(ring, tolerance) for ring in rings) if len(r) >= 3])
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(found, pa.list_(pa.list_(pa.list_(pa.float64()))))], names=[*(n for n in batch.schema.names if n != mask), "polygons"])

    return rows.select(*(c for c in rows.columns if c != mask), mask).mapInArrow(run, schema)


def star_polygons(rows: DataFrame, key: str, per_row: int = 3, seed: int = 42) -> DataFrame:
    """A reproducible synthetic set: ``per_row`` star-shaped polygons (5 to 9 corners, radius 15 to 50) for each row, from a
    hash of key, polygon and corner."""
    unit = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_003)) / 1_000_003.0
    base = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("polygon_idx"))
    base = base.withColumns({"n": (F.lit(5) + F.floor(5 * unit(key, "polygon_idx", F.lit("n")))).cast("int"), "cx": 60 + 380 * unit(key, "polygon_idx", F.lit("x")), "cy": 60 + 380 * unit(key, "polygon_idx", F.lit("y"))})

    def corner(i):
        turn = 6.283185307179586 * (i + 0.8 * unit(key, "polygon_idx", i, F.lit("a"))) / F.col("n")
        radius = 15 + 35 * unit(key, "polygon_idx", i, F.lit("r"))
        return F.array(F.col("cx") + radius * F.cos(turn), F.col("cy") + radius * F.sin(turn))

    return base.select(key, "polygon_idx", F.transform(F.sequence(F.lit(0), F.col("n") - 1), corner).alias("polygon"))
