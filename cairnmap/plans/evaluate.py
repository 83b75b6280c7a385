"""The stages of an evaluation: locate images and record them, with measured times; ablations over what was stored."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import knn, knn_index, lookup, metrics, vote
from ..sources import layout, readers, shared, writers
from . import localize

#: Ablations of matching and voting (fixed values): name -> arguments of localize.query_images.
MATCHING = {"l2_distance": {"p": 2}, "top1_no_voting": {"top1": True}, "distance_weighted": {"weighted": True}, "interior_angles_only": {"dims": (0, 2)}, "mfca_only": {"dims": (2, 3)}}


class Clock:
    """Writes the tables of a run's stages and keeps the seconds that each took."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.paths: list[str] = []

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        """df as a stored table; its time counts for ``stage``."""
        began, spark = time.perf_counter(), df.sparkSession
        self.paths.append(shared.fresh(spark, stage))
        df.write.parquet(self.paths[-1])
        self.seconds[stage] = self.seconds.get(stage, 0.0) + time.perf_counter() - began
        return spark.read.schema(df.schema).parquet(self.paths[-1])

    def each(self, n: int, stage: str) -> Column:
        """Seconds of a stage for each of n images: a stage takes all images together, so they share its time."""
        return F.lit(self.seconds.get(stage, 0.0) / max(1, n))

    def drop(self, df: DataFrame) -> None:
        for path in self.paths:
            shared.delete(df.sparkSession, path)
        self.paths = []


def store_sites(index: DataFrame, out: layout.Results) -> dict[str, knn_index.Index]:
    """A stored index for each site of the descriptor table, under the results' folder."""
    sites = [r.site for r in index.select("site").distinct().orderBy("site").collect()]  # a row a site
    return {site: knn_index.build(index.where(F.col("site") == site), f"{out.table('index')}/{site}", "descriptor_id", carry=("patch",)) for site in sites}


def tile_centres(index: DataFrame, size: int = 500) -> DataFrame:
    """(site, patch, cx, cy): the centre of each tile that has descriptors."""
    return index.groupBy("site", "patch").agg((F.min("left") + size / 2).alias("cx"), (F.min("top") + size / 2).alias("cy"))


def true_patches(truth: DataFrame, centres: DataFrame) -> DataFrame:
    """truth (image, gt_px_x, gt_px_y) of one site -> (image, gt_patch_id): the tile with the nearest centre."""
    points = truth.where("gt_px_x is not null").select("image", F.xxhash64("image").alias("_i"), "gt_px_x", "gt_px_y")
    tiles = centres.select("patch", F.xxhash64("patch").alias("_c"), "cx", "cy")
    near = knn.nearest_point(points, tiles, "_i", ("gt_px_x", "gt_px_y"), "_c", ("cx", "cy"))
    return points.join(near, "_i").join(tiles, "_c").select("image", F.col("patch").alias("gt_patch_id"))


def evaluate(images: DataFrame, index: DataFrame, sites: DataFrame, poses: DataFrame, out: layout.Results, batch: str, variant: str = "main", k: int = 5, prepare: Callable[[DataFrame], DataFrame] | None = None, segment: Callable[[DataFrame], DataFrame] | None = None, cap: int = 4, size: int = 500, stored: dict[str, knn_index.Index] | None = None) -> DataFrame:
    """Locates the images (site, image, ...; names unique over all sites) that have no record of this variant yet, each in its
    own site's index, appends their records under the name ``batch`` and returns these.  Stages, written and timed:

    ``prepare`` gets the images with their pose and ``sign`` (+1, -1, ... along a site, for sweeps of heading noise);
    ``segment`` turns them into (site, image, polygons), which they have to have already without it; descriptors; matches
    and votes.  Images without a pose are left out.  Those without descriptors are recorded without a position.  The
    variant main also stores polygons and descriptors, for ablate().

    sites: site, sat_width, sat_height, lt_lat, lt_lon, rb_lat, rb_lon (bounds may be null: no degrees, no errors); poses: as
    flight_metadata() reads them.  ``stored`` has the sites' stored indexes (store_sites), which are searched in place of
    scans.  A batch that runs again under its name, killed or not, gives its records once."""
    spark, clock = images.sparkSession, Clock()
    done = readers.records(spark, out.table("records"), variant=variant)
    signed = lookup.signs(images, "site", "image")
    todo = lookup.not_done(signed, done)
    known = lookup.pose_required(todo.join(poses.select("filename").distinct(), F.trim(F.element_at(F.split("image", "/"), -1)) == F.col("filename"), "left_semi"), poses).drop("filename")
    prepared = clock.run("preprocess", prepare(known) if prepare else known)
    n = prepared.count()
    found = clock.run("segment", (segment(prepared) if segment else prepared).select("site", "image", "polygons"))
    rows = clock.run("descriptor", localize.image_descriptors(found, cap).join(found.select("image", "site"), "image"))
    where = [r.site for r in found.select("site").distinct().orderBy("site").collect()]  # a row a site
    results = None
    for site in where:
        own = index.where(F.col("site") == site)
        patches = vote.patch_centroids(own, "patch", "centroid_x", "centroid_y")
        base = stored[site] if stored and site in stored else own
        part = localize.query_images(rows.where(F.col("site") == site).drop("site"), base, patches, k=k).withColumn("site", F.lit(site))
        results = part if results is None else results.unionByName(part)
    if results is None:
        return spark.createDataFrame([], readers.RECORD)
    results = clock.run("query", results)

    counts = found.select("site", "image", F.size("polygons").alias("n_polygons")).join(rows.groupBy("image").agg(F.count("*").alias("n_descriptors")), "image", "left")
    pose = prepared.select("image", *(c for c in ("lat", "lon", "height", "date") if c in prepared.columns))
    all_ = counts.join(results.drop("k", "site"), "image", "left")
    placed = localize.locate(all_, sites, pose)
    truth = placed.select("site", "image", "gt_px_x", "gt_px_y")
    nearest = None
    for site in where:
        part = true_patches(truth.where(F.col("site") == site), tile_centres(index.where(F.col("site") == site), size))
        nearest = part if nearest is None else nearest.unionByName(part)
    placed = placed.join(nearest, "image", "left")
    mine = F.try_element_at("all_votes", F.col("gt_patch_id"))
    has = F.col("n_descriptors").isNotNull()
    stages = {c: clock.each(n, c) for c in ("preprocess", "segment", "descriptor", "query")}
    times = {f"t_{c}": F.when(has | F.lit(c != "query"), t).otherwise(0.0) for c, t in stages.items()}
    out_rows = placed.withColumns(times | {
        "variant": F.lit(variant), "k": F.lit(k), "n_descriptors": F.coalesce("n_descriptors", F.lit(0)).cast("int"), "pred_patch_id": F.col("winner"), "second_votes": F.col("runner_up"),
        "total_votes": (F.coalesce("n_descriptors", F.lit(0)) * k), "gt_patch_votes": F.when(F.col("winner").isNotNull() & F.col("gt_patch_id").isNotNull(), F.coalesce(mine, F.lit(0))),
        "gt_patch_rank": F.when(mine.isNotNull(), 1 + F.size(F.filter(F.map_values("all_votes"), lambda v: v > mine))),
    }).withColumn("t_total", sum((F.col(f"t_{c}") for c in stages), F.lit(0.0)))
    schema = spark.createDataFrame([], readers.RECORD).schema
    stored = writers.stored(out_rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)))
    writers.append_records(stored, out.table("records"), batch)
    if variant == "main":
        kept = found.join(rows.groupBy("image").agg(F.collect_list(F.col("vec").cast("array<double>")).alias("descriptors")), "image", "left")
        kept = kept.withColumn("descriptors", F.coalesce("descriptors", F.array().cast("array<array<double>>")))
        kept.select("image", "polygons").write.mode("overwrite").json(f"{out.table('image_polygons')}/batch={batch}")
        kept.select("image", "descriptors").write.mode("overwrite").parquet(f"{out.table('image_descriptors')}/batch={batch}")
    clock.drop(images)
    written = f"{out.table('records')}/batch={batch}"
    return spark.read.schema(schema).parquet(written).select(*schema.names)


def errors_of(results: DataFrame, truth: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, image, error_m) of located images; truth (site, image, gt_px_x, gt_px_y) is what the records hold."""
    both = results.join(truth, "image").join(sites, "site")
    corners = [F.col(c) for c in ("lt_lat", "lt_lon", "rb_lat", "rb_lon", "sat_width", "sat_height")]
    mx, my, _ = geo.ground_resolution(*corners)
    return both.select("site", "image", geo.error_metres(F.col("pred_px_x") - F.col("gt_px_x"), F.col("pred_px_y") - F.col("gt_px_y"), mx, my).alias("error_m"))


def ablate(index: DataFrame, sites: DataFrame, out: layout.Results, ks: Sequence[int] = (1, 3, 10, 20), k: int = 5, tiles: DataFrame | None = None, caps: Sequence[int] = (0, 1, 2, 8)) -> DataFrame:
    """(variant, site, n, mean, median, ...; site ``overall`` pools all): the located images of the variant main, searched
    again from their stored descriptors with other K, metric, votes and components; with ``tiles`` (site, patch_id, tl,
    polygons) also with descriptors of other growth caps, computed again from stored polygons."""
    spark = index.sparkSession
    main = metrics.evaluable(readers.records(spark, out.table("records"), variant="main"), with_truth=True)
    truth = main.select("site", "image", "gt_px_x", "gt_px_y")
    stored = spark.read.schema("image string, descriptors array<array<double>>").parquet(out.table("image_descriptors"))
    known = readers.cached_of(truth, stored.select("image", "descriptors"), "descriptors")
    rows = known.select("site", "image", F.posexplode("descriptors").alias("i", "v")).select("site", "image", F.xxhash64("image", "i").alias("query_id"), F.col("v").cast("array<float>").alias("vec"))
    rows, found = shared.saved(rows, "ablate"), []
    where = [r.site for r in truth.select("site").distinct().orderBy("site").collect()]  # a row a site

    def add(name: str, queries: DataFrame, base: DataFrame, **how) -> None:
        for site in where:
            own = base.where(F.col("site") == site)
            patches = vote.patch_centroids(own, "patch", "centroid_x", "centroid_y")
            got = localize.query_images(queries.where(F.col("site") == site).drop("site"), own, patches, **({"k": k} | how))
            found.append(errors_of(got, truth, sites).withColumn("variant", F.lit(name)))

    for n in ks:
        add(f"K={n}", rows, index, k=n)
    for name, how in MATCHING.items():
        add(name, rows, index, **how)
    if tiles is not None:
        polygons_ = readers.cached_polygons(spark, out.table("image_polygons"), truth.select("image")).join(truth.select("image", "site"), "image")
        for c in caps:
            again = shared.saved(localize.build_index(tiles, c)[0], "ablate")
            add(f"Dmax={c}", shared.saved(localize.image_descriptors(polygons_, c).join(truth.select("image", "site"), "image"), "ablate"), again)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    # The errors are read for sites and for all: made once.
    every = shared.saved(every, "ablate")
    by_site = metrics.metrics_by(every, ["variant", "site"])
    return by_site.unionByName(metrics.metrics_by(every, ["variant"]).withColumn("site", F.lit("overall")))


def scalability(index: DataFrame, queries: DataFrame, counts: Sequence[int] = (1, 3), k: int = 5) -> DataFrame:
    """(sites, n_descriptors, n_patches, mb, build_s, query_s): an index of the first 1, 3, ... and all sites is stored and
    searched for the queries (query_id, vec); seconds are measured, the queries' share of one search each."""
    spark, all_ = index.sparkSession, index.select("site").distinct().count()
    names = [r.site for r in index.select("site").distinct().orderBy("site").collect()]  # a row a site
    asked, seconds = queries.count(), {}
    for n in sorted({min(c, all_) for c in (*counts, all_)}):
        path, began = shared.fresh(spark, "scale"), time.perf_counter()
        stored = knn_index.build(index.where(F.col("site").isin(names[:n])), path, "descriptor_id", carry=("patch",))
        built = time.perf_counter()
        knn_index.search(queries, stored, k).write.format("noop").mode("overwrite").save()
        seconds[n] = (built - began, (time.perf_counter() - built) / max(1, asked))
        shared.delete(spark, path)
    return localize.scalability(index, tuple(counts), seconds)
