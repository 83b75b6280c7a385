"""Sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import number, tex

#: Columns of the expansion table (fixed values).
EXPANSION = "filename string, seed_triangle_idx int, vertex_0_idx int, vertex_1_idx int, vertex_2_idx int, vertex_0_x double, vertex_0_y double, vertex_1_x double, vertex_1_y double, vertex_2_x double, vertex_2_y double, ekeland_v0 double, ekeland_v1 double, ekeland_v2 double, axis_v0 string, axis_v1 string, axis_v2 string, mean_ekeland double, expansion_steps int, num_triangles_in_region int, num_boundary_vertices int"


def append_records(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds records under the name of a batch: a batch that is written again replaces itself, so one that was killed and
    runs once more leaves each record once.  Without a name it is a batch of its own.  Within it, records are partitioned by
    variant and site, so readers of some prune the others."""
    df.write.mode("overwrite").partitionBy("variant", "site").parquet(f"{path}/batch={batch or uuid.uuid4().hex}")


def write_descriptors(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer = writer.partitionBy("site") if "site" in df.columns and format == "parquet" else writer
    writer.option("header", True).format(format).save(path)


def write_polygons(df: DataFrame, path: str, polygons: str = "polygons") -> None:
    """JSON lines, gzip, of rows with a polygon."""
    df.where(F.size(polygons) > 0).write.mode("overwrite").option("compression", "gzip").json(path)


def to_report(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text: {key: {metrics}} (nested for two keys); metrics are few rows by nature."""
    values = [c for c in metrics.columns if c not in keys]
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(keys[-1]).cast("string").alias("k"), F.struct(*values).alias("v")))))
    if len(keys) == 1:
        return metrics.agg(F.to_json(entry).alias("report"))
    inner = metrics.groupBy(keys[0]).agg(entry.alias("v"))
    return inner.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(keys[0]).cast("string").alias("k"), "v"))))).alias("report"))


def tex_rows(metrics: DataFrame, label: str, columns: list[str], digits: int = 1) -> DataFrame:
    """(label, line): table rows in TeX, sorted by label; --- for missing values."""
    cells = [number(F.col(c), digits) for c in columns]
    return metrics.orderBy(label).select(label, F.concat(F.concat_ws(" & ", tex(F.col(label).cast("string")), *cells), F.lit(r" \\")).alias("line"))


def flat_expansions(df: DataFrame) -> DataFrame:
    """The 21 columns of the expansion table from nested records (filename, seed_triangle_idx, vertices, coordinates, angles
    map, axes map, counts); angles default to 0, axes to Unknown."""
    v = lambda i: F.get("vertices", i)
    angle = lambda i: F.coalesce(F.try_element_at("angles", v(i)), F.lit(0.0))
    return df.select(
        "filename", "seed_triangle_idx",
        *(v(i).alias(f"vertex_{i}_idx") for i in range(3)),
        *(F.get(F.get("coordinates", i), j).alias(f"vertex_{i}_{'xy'[j]}") for i in range(3) for j in range(2)),
        *(angle(i).alias(f"ekeland_v{i}") for i in range(3)),
        *(F.coalesce(F.try_element_at("axes", v(i)), F.lit("Unknown")).alias(f"axis_v{i}") for i in range(3)),
        ((angle(0) + angle(1) + angle(2)) / 3).alias("mean_ekeland"), "expansion_steps", "num_triangles_in_region", "num_boundary_vertices",
    )


def write_meta(totals: DataFrame, path: str) -> None:
    """One JSON file with a line for each site; totals are a row a site."""
    totals.coalesce(1).write.mode("overwrite").json(path)


def cache_images(images: DataFrame, polygons_path: str, descriptors_path: str, mode: str = "append") -> None:
    """Stored polygons and descriptors of located images (image, variant, polygons, descriptors): main variant only."""
    main = images.where("variant = 'main'")
    main.select("image", "polygons").write.mode(mode).json(polygons_path)
    main.select("image", "descriptors").write.mode(mode).parquet(descriptors_path)


def stored(records: DataFrame) -> DataFrame:
    """Records as they are stored: seconds to four digits, pixels to one, metres to two, halves to even."""
    digits = {"pred_px_x": 1, "pred_px_y": 1, "error_m": 2} | {c: 4 for c in records.columns if c.startswith("t_")}
    return records.withColumns({c: F.bround(c, n) for c, n in digits.items() if c in records.columns})


def write_expansions(df: DataFrame, path: str) -> bool:
    """The expansion table as CSV with a header; no rows: no file, and False."""
    rows = flat_expansions(df)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_tex(tables: dict[str, DataFrame], path: str) -> None:
    """One text file: a comment with each table's name, then its lines (column line, in the order of column label)."""
    lines = None
    for i, (name, rows) in enumerate(tables.items()):
        label, line = rows.columns
        part = rows.select(F.lit(i).alias("_t"), F.col(label).cast("string").alias("_l"), F.col(line).alias("value"))
        head = rows.sparkSession.createDataFrame([(i, None, f"% {name}")], "_t int, _l string, value string")
        lines = head.unionByName(part) if lines is None else lines.unionByName(head).unionByName(part)
    lines.orderBy("_t", F.asc_nulls_first("_l")).select("value").coalesce(1).write.mode("overwrite").text(path)
