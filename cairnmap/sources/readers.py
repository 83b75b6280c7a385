"""Readers with declared schemas."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import lookup

#: Column names and order of the stored tables (fixed values).
POSE = (("num", "string"), ("filename", "string"), ("date", "string"), ("lat", "double"), ("lon", "double"), ("height", "double"), ("Omega", "double"), ("Kappa", "double"), ("Phi1", "double"), ("Phi2", "double"))
BOUNDS = "map string, LT_lat_map double, LT_lon_map double, RB_lat_map double, RB_lon_map double"
TILE_POLYGONS = "patch_id string, tl array<int>, polygons array<array<array<double>>>"
IMAGE_POLYGONS = "image string, polygons array<array<array<double>>>"
META = "site string, parent_tif string, sat_width int, sat_height int, bounds struct<LT_lat: double, LT_lon: double, RB_lat: double, RB_lon: double>, n_triangles long, n_patches_with_buildings long, build_seconds double, limit_patches int"
DESCRIPTORS = "patch_id string, parent_tif string, top_left_x int, top_left_y int, centroid_x double, centroid_y double, alpha1 double, alpha2 double, e1 double, e2 double, e3 double"
RECORD = "site string, image string, variant string, n_polygons int, n_descriptors int, k int, total_votes int, pred_patch_id string, pred_px_x double, pred_px_y double, pred_lat double, pred_lon double, gt_lat double, gt_lon double, gt_px_x double, gt_px_y double, error_m double, votes int, second_votes int, margin int, gt_patch_id string, gt_patch_votes int, gt_patch_rank int, height double, date string, season string, alt_band string, t_preprocess double, t_segment double, t_descriptor double, t_query double, t_total double"


def in_file_order(read: DataFrame) -> DataFrame:
    """Rows that a file source has just read, with ``position`` = (file, block, row): its order is the order of the rows in
    their file, whatever number of tasks read it.  A block of a file is read by one task from its start on, in which the
    running number grows; files follow each other by path."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return read.select("*", at.alias("position"))


def flight_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Poses from text without a header, fields apart by blanks or a comma; fields that do not parse are null.  ``position``
    orders them as their lines stand in the file."""
    return parse_poses(in_file_order(spark.read.text(path)))


def parse_poses(lines: DataFrame) -> DataFrame:
    """Lines (value, ...) of flight metadata -> the other columns and POSE; blank lines give no row."""
    parts = F.split(F.trim("value"), r"\s*,\s*|\s+")
    fields = [F.get(parts, i) if kind == "string" else F.expr(f"try_cast(get(split(trim(value), '\\\\s*,\\\\s*|\\\\s+'), {i}) as {kind})") for i, (_, kind) in enumerate(POSE)]
    others = [c for c in lines.columns if c != "value"]
    return no_nan(lines.where(F.trim("value") != "").select(*others, *(F.trim(f).alias(n) if kind == "string" else f.alias(n) for f, (n, kind) in zip(fields, POSE))))


def map_bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOUNDS).csv(path, header=True)


def bounds_by_name(spark: SparkSession, name: str, *paths: str) -> dict[str, float] | None:
    """The bounds of the most similar map name in the first table of bounds that exists; None without a table or a hit."""
    path = first_existing(spark, *paths)
    if path is None:
        return None
    table = in_file_order(map_bounds(spark, path))
    row = lookup.match_bounds(spark.createDataFrame([(name,)], "name string"), table, order="position").first()
    return None if row.tier is None else {k: row[f"{k}_map"] for k in ("LT_lat", "LT_lon", "RB_lat", "RB_lon")}


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of some candidate paths that exists, on any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return p
    return None


def numpy_rows(spark: SparkSession, path: str, members: dict[str, str], rows: int = 4096) -> DataFrame:
    """(path, row, *members) from ``.npy`` and ``.npz`` files under a path (a folder, a file, or a pattern): a row for each
    index of the first axis.  ``members`` declares columns and their SQL types, which values are cast to; a ``.npy`` file has
    one member, whatever its name.  Pickled objects are refused.  A missing path, and files of no bytes or no rows, give no
    rows; members of one file have to agree in length.  A file is read by one task (of 2 GB at most); its rows leave it in
    batches of ``rows``."""
    schema = "path string, row long, " + ", ".join(f"`{c}` {kind}" for c, kind in members.items())
    if not any(c in path for c in "*?[{") and first_existing(spark, path) is None:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.np[yz]").load(path)
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                found = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                arrays = {next(iter(members)): found} if isinstance(found, np.ndarray) else {c: found[c] for c in members}
                if len({len(a) for a in arrays.values()}) > 1:
                    raise ValueError(f"members of different length in {name}")
                n = len(next(iter(arrays.values())))
                for lo in range(0, n, rows):
                    part = [pa.array(a[lo : lo + rows].tolist()) for a in arrays.values()]
                    size = len(part[0])
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * size), pa.array(range(lo, lo + size), pa.int64()), *(x.cast(types.field(c).type) for c, x in zip(arrays, part))], schema=types)

    return files.where("length > 0").select("path", "content").mapInArrow(run, schema)


def image_list(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name) of images in a folder, by name; without reading them.  A missing folder gives no rows."""
    if first_existing(spark, folder) is None:
        return spark.createDataFrame([], "path string, name string")
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.where(F.lower("name").rlike(r"\.(jpg|jpeg|png)$")).orderBy("name")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, compressed or not."""
    return spark.read.schema(schema).json(path)


def json_text(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("encoding", encoding).json(path)


def cached_polygons(spark: SparkSession, path: str, images: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """(image, polygons) of the images (image) whose stored polygons are found by file stem and are not empty."""
    if first_existing(spark, path) is None:
        return spark.createDataFrame([], IMAGE_POLYGONS)
    return cached_of(images, json_text(spark, path, IMAGE_POLYGONS, encoding), "polygons")


def cached_of(images: DataFrame, cached: DataFrame, value: str) -> DataFrame:
    """images with their cached value (an array), joined on the file stem; images without one, or with an empty one, give
    no row.  Of several cached rows of a stem, the first by the cached name counts."""
    known = cached.where(F.size(value) > 0).groupBy(text.stem(F.col("image")).alias("_stem")).agg(F.min_by(value, "image").alias(value))
    return images.withColumn("_stem", text.stem(F.col("image"))).join(known, "_stem").drop("_stem")


def descriptors(spark: SparkSession, path: str, format: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """The descriptor table or some columns of it; csv or parquet."""
    df = spark.read.parquet(path) if format == "parquet" else spark.read.schema(DESCRIPTORS).csv(path, header=True)
    return require(df, columns).select(*columns) if columns else df


def records(spark: SparkSession, path: str, sites: list[str] | None = None, variant: str | None = None) -> DataFrame:
    """Evaluation records, of some sites and a variant; no table yet gives no rows."""
    if first_existing(spark, path) is None:
        return spark.createDataFrame([], RECORD)
    schema = StructType.fromDDL(RECORD)
    df = spark.read.schema(schema).parquet(path).select(*schema.names)
    if variant is not None:
        df = df.where(F.col("variant") == variant)
    return df.where(F.col("site").isin(sites)) if sites is not None else df


def variant_names(df: DataFrame) -> DataFrame:
    return df.select("variant").where("variant is not null").distinct().orderBy("variant")


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating columns."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}) if any(k in ("double", "float") for _, k in df.dtypes) else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
