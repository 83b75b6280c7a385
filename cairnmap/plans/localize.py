"""The flows: build an index from polygons, locate images, record, evaluate, compare variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import detections, knn, knn_index, metrics, polygons, vote
from ..sources import layout, readers, writers


def build_index(tiles: DataFrame, cap: int | tuple[int, ...] = 4) -> tuple[DataFrame, DataFrame]:
    """tiles (site, patch_id, tl, polygons) -> (descriptor rows with vec and descriptor_id, patch table).  Patch ids are
    unique across sites: site/patch_id."""
    each = polygons.explode_polygons(tiles).withColumns({"left": F.get("tl", 0), "top": F.get("tl", 1)})
    rows = polygons.polygon_descriptors(each.select("site", "patch_id", "left", "top", "polygon_idx", "polygon"), cap=cap, offset=("left", "top"))
    rows = polygons.as_vector(rows).withColumn("patch", F.concat_ws("/", "site", "patch_id"))
    rows = rows.withColumn("descriptor_id", F.xxhash64("patch", "polygon_idx", "triangle_idx"))
    return rows, vote.patch_centroids(rows, "patch", "centroid_x", "centroid_y")


def image_descriptors(images: DataFrame, cap: int = 4) -> DataFrame:
    """images (image, polygons) -> (image, query_id, vec)."""
    rows = polygons.polygon_descriptors(polygons.explode_polygons(images).select("image", "polygon_idx", "polygon"), cap=cap)
    return polygons.as_vector(rows).select("image", F.xxhash64("image", "polygon_idx", "triangle_idx").alias("query_id"), "vec")


def match(queries: DataFrame, index: DataFrame | knn_index.Index, k: int = 5, p: int = 1, dims: tuple[int, int] | None = None) -> DataFrame:
    """(image, query_id, index_id, patch, distance, rank) of the k nearest descriptors of each query descriptor.  A stored
    index (knn_index.build, which carries patch) is searched where it is; a table is scanned."""
    if isinstance(index, knn_index.Index):
        near = knn_index.search(queries, index, k, p, dims=dims)
    else:
        near = knn.knn_join(queries, index, k, p, "query_id", "descriptor_id", "vec", dims, carry=("patch",))
    return near.join(queries.select("query_id", "image"), "query_id")


def query_images(queries: DataFrame, index: DataFrame | knn_index.Index, patches: DataFrame, k: int = 5, p: int = 1, weighted: bool = False, top1: bool = False, dims: tuple[int, int] | None = None, n: int = 100) -> DataFrame:
    """A row for each image with matches: winner, its centre, votes, runner-up, margin, all votes, the n best patches."""
    matches = match(queries, index, 1 if top1 else k, p, dims)
    by = "weight" if weighted else "votes"
    counts = matches.groupBy("image", "patch").agg(F.count("*").alias("votes"), F.sum(1 / (1 + F.col("distance"))).alias("weight"), F.min(F.struct("distance", "query_id", "index_id")).alias("closest"))
    # The counts are ranked, mapped and summed per image in one pass after one shuffle of voted patches.
    best = Window.partitionBy("image").orderBy(F.asc("closest") if top1 else F.desc(by), F.asc("patch"))
    ranked = counts.join(patches.select("patch", "centroid_x", "centroid_y"), "patch").withColumns({"rank": F.row_number().over(best), "by_votes": F.row_number().over(Window.partitionBy("image").orderBy(F.desc("votes"), F.asc("patch")))})
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    entry = F.when(F.col("rank") <= n, F.struct("rank", "patch", "centroid_x", "centroid_y", "votes"))
    out = ranked.groupBy("image").agg(
        first("patch").alias("winner"), first("centroid_x").alias("pred_px_x"), first("centroid_y").alias("pred_px_y"),
        F.max("votes").alias("votes"), F.coalesce(F.max(F.when(F.col("by_votes") == 2, F.col("votes"))), F.lit(0)).alias("runner_up"),
        F.sum("votes").alias("total_votes"), F.count("*").alias("n_voted"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("patch", "votes")))).alias("all_votes"), F.sort_array(F.collect_list(entry)).alias("top_n"),
    )
    return out.withColumns({"margin": F.col("votes") - F.col("runner_up"), "k": F.lit(k)})


def truth_and_top(results: DataFrame, truth: DataFrame, n: int = 100) -> DataFrame:
    """What a picture of an image's truth and its n best patches shows: (image, kind, rank, patch, px, py, votes, error_px), a
    row of kind ``truth`` (rank null) and one of kind ``patch`` for each of top_n.  truth: image, gt_px_x, gt_px_y."""
    known = truth.where("gt_px_x is not null")
    best = results.select("image", F.explode(F.slice("top_n", 1, n)).alias("t")).join(known, "image", "left")
    far = F.hypot(F.col("t.centroid_x") - F.col("gt_px_x"), F.col("t.centroid_y") - F.col("gt_px_y"))
    place = lambda c: F.col(c).cast("double")
    patches = best.select("image", F.lit("patch").alias("kind"), "t.rank", "t.patch", place("t.centroid_x").alias("px"), place("t.centroid_y").alias("py"), F.col("t.votes").alias("votes"), far.alias("error_px"))
    spots = known.join(results.select("image"), "image", "left_semi").select("image", F.lit("truth").alias("kind"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("patch"), place("gt_px_x").alias("px"), place("gt_px_y").alias("py"), F.lit(None).cast("long").alias("votes"), F.lit(0.0).alias("error_px"))
    return spots.unionByName(patches)


def locate(results: DataFrame, sites: DataFrame, poses: DataFrame) -> DataFrame:
    """results (image, site, pred_px_x, pred_px_y, ...) with predicted degrees, true pixel, error in metres, season and band.

    sites: site, sat_width, sat_height, lt_lat, lt_lon, rb_lat, rb_lon; poses: image, lat, lon, height, date.
    """
    df = results.join(sites, "site").join(poses, "image", "left")
    corners = [F.col(c) for c in ("lt_lat", "lt_lon", "rb_lat", "rb_lon", "sat_width", "sat_height")]
    lat, lon = geo.pixel_to_lat_lon(F.col("pred_px_x"), F.col("pred_px_y"), *corners)
    gx, gy = geo.lat_lon_to_pixel(F.col("lat"), F.col("lon"), *corners)
    mx, my, _ = geo.ground_resolution(*corners)
    df = df.withColumns({"pred_lat": lat, "pred_lon": lon, "gt_px_x": gx, "gt_px_y": gy, "season": geo.season(F.col("date")), "alt_band": geo.altitude_band(F.col("height"))})
    return df.withColumn("error_m", geo.error_metres(F.col("pred_px_x") - F.col("gt_px_x"), F.col("pred_px_y") - F.col("gt_px_y"), mx, my)).withColumnsRenamed({"lat": "gt_lat", "lon": "gt_lon"})


def k_sweep(matches: DataFrame, ks: tuple[int, ...], image: tuple[str, ...] = ("image",)) -> DataFrame:
    """(k, *image, winner, votes, margin) for several k from one ranking with the largest k."""
    wide = matches.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    return vote.plurality(wide, ("k", *image)).select("k", *image, "winner", "votes", "margin")


def depth_sweep(tiles: DataFrame, caps: tuple[int, ...] = (0, 1, 2, 8)) -> DataFrame:
    """Descriptor rows for several growth caps, in one table with a column cap."""
    return build_index(tiles, caps)[0]


def report(records: DataFrame) -> dict[str, DataFrame]:
    """The tables of the evaluation of main and other variants."""
    main = records.where("variant = 'main'")
    base = metrics.evaluable(main)
    m = [F.avg("n_descriptors").alias("avg_descriptors")]
    return {
        "coverage": metrics.coverage(main),
        "runtimes": metrics.runtimes(base),
        "overall": metrics.metrics_by(base),
        "by_site": metrics.metrics_by(base, ["site"], extra=m),
        "by_season": metrics.metrics_by(base, ["season"]),
        "by_band": metrics.metrics_by(base, ["alt_band"], extra=m),
        "votes": metrics.vote_diagnostics(base),
        "by_variant": metrics.metrics_by(records.where("error_m is not null"), ["variant"], extra=[F.avg("t_total").alias("avg_t_total")]),
        "ecdf": metrics.ecdf(base, "site"),
    }


def scalability(index: DataFrame, counts: tuple[int, ...] = (1, 3), seconds: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """(sites, n_descriptors, n_patches, mb[, build_s, query_s]) of the index of the first 1, 3, ... and all sites, in one
    pass over the index.  ``seconds`` are measured times of a number of sites."""
    sizes = index.groupBy("site").agg(F.count("*").alias("_n"), F.count_distinct("patch").alias("_p"))
    place, all_ = F.row_number().over(Window.orderBy("site")), F.count("*").over(Window.partitionBy())
    wanted = F.array_distinct(F.transform(F.array(*map(F.lit, counts), F.col("_all").cast("int")), lambda c: F.least(c, F.col("_all").cast("int"))))
    each = sizes.withColumns({"_at": place, "_all": all_}).withColumn("sites", F.explode(wanted)).where("_at <= sites")
    out = each.groupBy("sites").agg(F.sum("_n").alias("n_descriptors"), F.sum("_p").alias("n_patches"), F.round(F.sum("_n") * 32 / 1048576, 1).alias("mb"))
    if seconds is None:
        return out
    times = index.sparkSession.createDataFrame([(n, b, q) for n, (b, q) in seconds.items()], "sites int, build_s double, query_s double")
    return out.join(times, "sites", "left")


def build_totals(index: DataFrame) -> DataFrame:
    """(site, n_triangles, n_patches_with_buildings), a row a site."""
    return index.groupBy("site").agg(F.count("*").alias("n_triangles"), F.count_distinct("patch").alias("n_patches_with_buildings"))


def as_json(results: DataFrame) -> DataFrame:
    """(image, json): each result as one JSON text."""
    return results.select("image", F.to_json(F.struct(*results.columns)).alias("json"))


def extract(images: DataFrame, model: Callable, schema: str, keys: list[str], cap: int = 4, least_score: float = 0.5) -> DataFrame:
    """Images through a segmentation model to descriptors: mask instances, polygons, (image, query_id, vec)."""
    found = detections.to_polygons(detections.segment(images, model, schema), keys, least_score)
    return image_descriptors(found.select(F.col(keys[0]).alias("image"), "polygons"), cap)


def build_site(tiles: DataFrame, model: Callable, schema: str, out: layout.Results | None = None, cap: int = 4, least_score: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Tiles (site, patch_id, left, top, image) through a segmentation model to the index and its patch table.  ``schema``
    is what the model gives: those keys with mask and score.  With ``out``, polygons, descriptors and totals are written
    and the index is read back."""
    found = detections.to_polygons(detections.segment(tiles, model, schema), ["site", "patch_id", "left", "top"], least_score)
    found = found.select("site", "patch_id", F.array(F.col("left").cast("int"), F.col("top").cast("int")).alias("tl"), "polygons")
    if out is None:
        return build_index(found, cap)
    writers.write_polygons(found, out.table("polygons"))
    rows, _ = build_index(tiles.sparkSession.read.json(out.table("polygons"), schema="site string, " + readers.TILE_POLYGONS), cap)
    writers.write_descriptors(rows, out.table("descriptors"))
    index = tiles.sparkSession.read.schema(rows.schema).parquet(out.table("descriptors"))
    writers.write_meta(build_totals(index), out.table("meta"))
    return index, vote.patch_centroids(index, "patch", "centroid_x", "centroid_y")


def workload(images: int, tiles: int, variants: int, tiles_per_s: float, triangles: int, triangles_per_s: float) -> dict[str, float]:
    """Estimated hours of a full evaluation."""
    passes = tiles + images * variants
    return {"forward_passes": passes, "segment_hours": passes / tiles_per_s / 3600, "geometry_hours": triangles / triangles_per_s / 3600}
