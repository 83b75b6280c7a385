"""Layout, caches, sinks and the composed builders, with a toy segmentation model."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnmap.functions import geo
from cairnmap.operators import detections, knn, lookup, metrics, order, polygons
from cairnmap.plans import localize
from cairnmap.sources import layout, readers, writers

SCHEMA = "site string, patch_id string, left int, top int, mask array<array<double>>, score double"


def toy(names=tuple(c.split(" ")[0] for c in SCHEMA.split(", "))):
    """A model that gives two instances of each tile: a confident block, and the whole tile without confidence."""

    def run(batches):
        for b in batches:
            masks = [[[1.0 if n <= r < n + 9 and 3 <= c < 12 else 0.0 for c in range(16)] for r in range(16)] for n in b.column("n").to_pylist()]
            keys = [b.column(c) for c in ("site", "patch_id", "left", "top")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(masks), pa.array([0.9] * len(masks))], names=names)
            yield pa.RecordBatch.from_arrays([*keys, pa.array([[[1.0] * 16] * 16] * len(masks)), pa.array([0.2] * len(masks))], names=names)

    return run


@pytest.fixture(scope="module")
def tiles(spark):
    return spark.createDataFrame([("01", f"a_{i}", 100 * i, 50, 1 + i % 4) for i in range(8)] + [("02", "b_0", 0, 0, 2)], "site string, patch_id string, left int, top int, n int")


def test_build_site_from_tiles_to_index(spark, tiles, tmp_path):
    index, patches = localize.build_site(tiles, toy(), SCHEMA)
    rows = index.collect()
    # A square block gives two right triangles for each tile, placed by the tile's corner.
    assert {r.patch for r in rows} == {f"01/a_{i}" for i in range(8)} | {"02/b_0"} and len(rows) == 18
    assert all(sorted((r.alpha1, r.alpha2)) == pytest.approx([45, 45]) for r in rows)
    assert all(r.left <= r.centroid_x < r.left + 16 and r.top <= r.centroid_y < r.top + 16 for r in rows)
    out = layout.Results(str(tmp_path))
    again, centres = localize.build_site(tiles, toy(), SCHEMA, out)
    key = lambda r: (r.patch, r.polygon_idx, r.triangle_idx)
    assert [(key(r), r.vec) for r in sorted(again.collect(), key=key)] == [(key(r), r.vec) for r in sorted(rows, key=key)]
    assert sorted(centres.collect()) == sorted(patches.collect())
    totals = readers.json_lines(spark, out.table("meta"), readers.META).select("site", "n_triangles", "n_patches_with_buildings").collect()
    assert sorted(map(tuple, totals)) == [("01", 16, 8), ("02", 2, 1)]
    with pytest.raises(ValueError):
        out.table("nothing")


def test_extract_gives_descriptors_of_images(tiles):
    got = localize.extract(tiles, toy(), SCHEMA, ["patch_id", "site", "left", "top"]).collect()
    assert len(got) == 18 and {r.image for r in got} == {f"a_{i}" for i in range(8)} | {"b_0"}


def test_sites_are_those_with_a_map(spark, tmp_path):
    for name in ("02", "11", "12"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"satellite{name}.tif").write_bytes(b"")
    (tmp_path / "03").mkdir()
    assert layout.present_sites(spark, str(tmp_path)) == ["02", "11"]
    site = layout.Site("/d", "07")
    assert (site.map_image, site.poses, site.bounds, site.photo("x.jpg")) == ("/d/07/satellite07.tif", "/d/07/07.csv", "/d/satellite_coordinates_range.csv", "/d/07/drone/x.jpg")


def test_bounds_by_name(spark, tmp_path):
    (tmp_path / "b.csv").write_text("mapname,LT_lat_map,LT_lon_map,RB_lat_map,RB_lon_map\nsatellite01.tif,1,2,3,4\nsatellite02.tif,5,6,7,8\n")
    paths = (str(tmp_path / "none.csv"), str(tmp_path / "b.csv"))
    assert readers.bounds_by_name(spark, "Satellite02.TIF", *paths) == {"LT_lat": 5, "LT_lon": 6, "RB_lat": 7, "RB_lon": 8}
    assert readers.bounds_by_name(spark, "elsewhere", *paths) is None and readers.bounds_by_name(spark, "satellite01", paths[0]) is None


def test_caches_hold_main_images_and_skip_empty_ones(spark, tmp_path):
    rows = [("a.jpg", "main", [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]], [[1.0]]), ("b.jpg", "main", [], []), ("c.jpg", "other", [[[0.0, 0.0]]], [[2.0]])]
    images = spark.createDataFrame(rows, "image string, variant string, polygons array<array<array<double>>>, descriptors array<array<double>>")
    p, d = str(tmp_path / "p"), str(tmp_path / "d")
    assert readers.cached_polygons(spark, p, images.select("image")).count() == 0
    writers.cache_images(images, p, d)
    found = readers.cached_polygons(spark, p, spark.createDataFrame([("x/a.png",), ("b.png",), ("c.png",), ("e.png",)], "image string")).collect()
    assert [(r.image, r.polygons) for r in found] == [("x/a.png", rows[0][2])]
    assert readers.cached_of(images.select("image"), spark.read.parquet(d), "descriptors").count() == 1


def test_sinks_of_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "filename string, seed_triangle_idx int, vertices array<int>, coordinates array<array<double>>, angles map<int, double>, axes map<int, string>, expansion_steps int, num_triangles_in_region int, num_boundary_vertices int")
    assert writers.write_expansions(empty, str(tmp_path / "e")) is False and not (tmp_path / "e").exists()
    one = spark.createDataFrame([("f", 0, [0, 1, 2], [[0.0, 0.0]] * 3, {0: 3.0}, {}, 1, 2, 3)], empty.schema)
    assert writers.write_expansions(one, str(tmp_path / "e")) is True
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == [c.split(" ")[0] for c in writers.EXPANSION.split(", ")]
    rows = writers.tex_rows(spark.createDataFrame([("b_1", 2.0), ("a", None)], "site string, mean double"), "site", ["mean"], digits=2)
    writers.write_tex({"sites": rows, "again": rows}, str(tmp_path / "t"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines == ["% sites", r"a & --- \\", r"b\_1 & 2.00 \\"] * 1 + ["% again", r"a & --- \\", r"b\_1 & 2.00 \\"]
    assert json.loads(localize.as_json(spark.createDataFrame([("i", 1, [2])], "image string, n int, l array<int>")).first().json) == {"image": "i", "n": 1, "l": [2]}


def test_boxes_meet_by_cells_as_they_do_by_image(spark):
    rng = random.Random(1)
    box = lambda i: (i, f"m{i % 2}", x := rng.uniform(-30, 30), y := rng.uniform(-30, 30), x + rng.uniform(1, 15), y + rng.uniform(1, 15))  # noqa: E731, F841
    side = lambda n: spark.createDataFrame([box(i) for i in range(120)], f"{n}_id long, image string, {n}x double, {n}y double, {n}x1 double, {n}y1 double")
    left, right = side("l"), side("r")
    iou = geo.box_iou([F.col(c) for c in ("lx", "ly", "lx1", "ly1")], [F.col(c) for c in ("rx", "ry", "rx1", "ry1")])
    names = (["lx", "ly", "lx1", "ly1"], ["rx", "ry", "rx1", "ry1"])
    plain = metrics.iou_matches(left, right, "image", "l_id", "r_id", iou, 0.2).collect()
    for cell in (0.3, 4.0, 500.0):
        assert len(plain) > 20 and sorted(plain) == sorted(metrics.iou_matches(left, right, "image", "l_id", "r_id", iou, 0.2, names, cell).collect())


def test_pairs_under_any_metric(spark):
    rows = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5)]) for i in range(60)], "id long, vec array<double>")
    l1 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    asked, index = rows.where("id % 6 = 0").withColumnRenamed("id", "query_id"), rows.where("id % 6 <> 0").withColumnRenamed("id", "index_id")
    assert knn.top_pairs(asked, index, 25, l1).collect() == knn.top_pairs(asked, index, 25, "l1").collect()


def test_lots_are_drawn_alike_in_any_partitioning(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    first = lookup.hash_sample(rows, "id", 10, 5).collect()
    assert first == lookup.hash_sample(rows.repartition(7), "id", 10, 5).collect() != lookup.hash_sample(rows, "id", 10, 6).collect()
    share = lookup.foreground_or_chance(rows, "id", F.col("g") / 2.0, 1.0, 0.3).where("g < 2").count() / rows.where("g < 2").count()
    assert 0.24 < share < 0.36


def test_query_pool_takes_whole_keys_until_the_total(spark):
    rows = spark.createDataFrame([(f"k{i % 30:02d}", i) for i in range(300)], "key string, n int")
    got = detections.query_pool(rows, "key", "n", 5, 18).collect()
    assert {r.key for r in got} == {"k00", "k01", "k02", "k03"} and len(got) == 20
    assert polygons.below_share(rows, "n", 100, 0.2, 5).count() == 15


def test_places_in_groups_of_any_size(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, *range(900)]), i) for i in range(2500)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(5)
    got = order.places(df, ["k"], ["o", "i"]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r: n for n, r in enumerate(mine)}
    assert {(r.k, r.o, r.i): r.place for r in got} == want and len(got) == len(rows)
    tied = order.places(df.select("k"), ["k"], ["k"]).groupBy("k").agg(F.count_distinct("place").alias("n"), F.max("place").alias("m")).collect()
    assert {r.k: (r.n, r.m + 1) for r in tied} == {k: (n, n) for k, n in ((k, sum(r[0] == k for r in rows)) for k in {r[0] for r in rows})}
    assert order.places(df.limit(0), ["k"], ["o"]).count() == 0
    assert {r.place for r in order.places(df.limit(10), [], ["i"], "place").collect()} == set(range(10))


def test_first_rows_are_cut_before_they_move(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id")
    plan = lookup.first_n(df, "k", "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert lookup.first_n(df, "k", "id", 5).count() == 15
