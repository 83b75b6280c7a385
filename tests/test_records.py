import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cairnmap.functions import geo, text
from cairnmap.operators import lookup, metrics, tiles
from cairnmap.plans import localize
from cairnmap.sources import readers, writers
from cairnmap.streaming import ingest


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("w,h,want", [(9774, 26762, 24816), (500, 500, 1), (300, 200, 1), (700, 500, 3), (750, 500, 4)])
def test_tiles(spark, w, h, want):
    df = spark.createDataFrame([("m", w, h)], "name string, w int, h int")
    grid = tiles.tile_grid(df, "name", "w", "h")
    assert grid.count() == want == df.select(tiles.tile_count(F.col("w"), F.col("h"))).first()[0]
    last = grid.agg(F.max("left"), F.max("top")).first()
    assert tuple(last) == (max(w - 500, 0), max(h - 500, 0))


def test_first_tile_id_and_limit(spark):
    df = spark.createDataFrame([("m", 750, 700)], "name string, w int, h int")
    ids = [r.patch_id for r in tiles.tile_grid(df, "name", "w", "h", limit=5).orderBy("tile_row", "tile_col").collect()]
    assert ids == ["m_0000_0000", "m_0000_0001", "m_0000_0002", "m_0000_0003", "m_0001_0000"]


def test_pixels_round_trip_and_half_even(spark):
    b = [F.lit(x) for x in (30.0, 114.0, 29.9, 114.1, 2001, 1001)]
    lat, lon = geo.pixel_to_lat_lon(F.lit(123.0), F.lit(456.0), *b)
    x, y = geo.lat_lon_to_pixel(lat, lon, *b)
    assert tuple(one(spark, x=x, y=y)) == (123, 456)
    x, y = geo.lat_lon_to_pixel(F.lit(0.5), F.lit(2.5), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0), F.lit(11), F.lit(11))
    assert tuple(one(spark, x=x, y=y)) == (2, 0)
    with pytest.raises(Exception, match="zero span"):
        one(spark, x=geo.lat_lon_to_pixel(F.lit(0.5), F.lit(2.5), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(11), F.lit(11))[0])


@pytest.mark.parametrize("h,band", [(399.0, "other"), (400.0, "400-700"), (700.0, "700-1200"), (1200.0, "1200-2000"), (1999.9, "1200-2000"), (2000.0, "other"), (math.nan, "unknown"), (None, "unknown")])
def test_bands(spark, h, band):
    assert one(spark, b=geo.altitude_band(F.lit(h).cast("double"))).b == band


@pytest.mark.parametrize("date,want", [("2023-07-15", "summer"), ("2023/10/02", "autumn"), ("2023-01-01 10:00:00", "other"), ("soon", "unknown"), (None, "unknown")])
def test_seasons(spark, date, want):
    assert one(spark, s=geo.season(F.lit(date).cast("string"))).s == want


@pytest.mark.parametrize("name,normal,number", [("maps/Satellite_01.tif", "satellite01", "1"), ("00", "00", "0"), ("north", "north", None)])
def test_names(spark, name, normal, number):
    r = one(spark, a=text.normal_name(F.lit(name)), b=text.numeric_id(text.normal_name(F.lit(name))))
    assert (r.a, r.b) == (normal, number)


def test_bounds_tiers(spark):
    names = spark.createDataFrame([(n,) for n in ("satellite01.tif", "7", "orth", "zzz")], "name string")
    bounds = spark.createDataFrame([(0, "01"), (1, "satellite01"), (2, "area007"), (3, "north"), (4, "northern")], "pos int, map string")
    got = {r.name: (r.tier, r["map"]) for r in lookup.match_bounds(names, bounds).collect()}
    assert got == {"satellite01.tif": (1, "01"), "7": (2, "area007"), "orth": (3, "north"), "zzz": (None, None)}


def test_variants():
    assert text.variant_name("heading_noise", 5.0) == "heading_noise_5"
    assert text.variant_name("gsd_error", 0.9) == "gsd_error_-10"


def records(spark):
    rows = [("01", "a", 10.0, 5, 2), ("01", "b", 20.0, 5, None), ("02", "c", 50.0, 1, 200), (None, "d", 4.0, 2, 1), ("02", "e", None, 0, None), ("02", "f", math.nan, 3, 1)]
    df = spark.createDataFrame(rows, "site string, image string, error_m double, n_descriptors int, gt_patch_rank int")
    return df.selectExpr("*", "'main' as variant", "2 as gt_patch_votes", "10 as total_votes", "3 as margin", "4 as votes", "1.0D as t_total", "1.0D as t_query", "1.0D as t_segment", "'summer' as season", "'other' as alt_band", "1.0D as gt_px_x")


def test_bundle_is_inclusive_and_ignores_non_finite(spark):
    r = metrics.metrics_by(records(spark)).first()
    assert (r.n, r["mean"], r["median"], r.recall_10, r.recall_20, r.recall_50) == (4, 21, 15, 50, 75, 100)
    empty = metrics.metrics_by(records(spark).limit(0)).first()
    assert empty.n == 0 and empty["mean"] is None


def test_report(spark):
    t = localize.report(records(spark))
    assert {r.site: r.n for r in t["by_site"].collect()} == {"01": 2, "02": 1}
    assert t["coverage"].first().total == 6 and t["coverage"].first().with_descriptors == 5
    votes = {r.site: r.gt_in_top_100_pct for r in t["votes"].collect()}
    assert votes == {"01": 50, "02": 50}
    assert t["by_variant"].first().n == 4
    total = {r.site: r.n for r in metrics.metrics_and_total(records(spark), "site").collect()}
    assert total == {"01": 2, "02": 1, "overall": 3}
    js = json.loads(writers.to_report(t["by_site"], ["site"]).first().report)
    assert js["01"]["n"] == 2


def test_ecdf_steps_through_ties(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 1.0), ("s", 3.0)], "site string, error_m double")
    assert sorted(r.fraction for r in metrics.ecdf(df, "site").collect()) == pytest.approx([1 / 3, 2 / 3, 1])


def test_number_format(spark):
    assert [one(spark, x=text.number(F.lit(v).cast("double"), 2)).x for v in (1.004, None, math.inf)] == ["1.00", "---", "---"]
    assert one(spark, x=text.number(F.lit(12.345))).x == "12.3"


def test_metadata_source(spark, tmp_path):
    (tmp_path / "f.csv").write_text("1, a.JPG ,2023-07-15,30.1,114.2,500,1,2,3,4\n2 b.JPG soon 30.2 114.3 x 1 2 3 nan\n\n")
    a, b = readers.flight_metadata(spark, str(tmp_path)).orderBy("num").collect()
    assert (a.filename, a.lat, a.Phi2) == ("a.JPG", 30.1, 4.0)
    assert (b.filename, b.height, b.Phi2) == ("b.JPG", None, None)


def test_poses(spark):
    images = spark.createDataFrame([("d/a.JPG",), ("d/c.JPG",)], "image string")
    poses = spark.createDataFrame([("1", "a.JPG", 1.0), ("2", "a.JPG", 2.0)], "num string, filename string, lat double")
    assert {r.image: r.lat for r in lookup.pose_of(images, poses).collect()} == {"d/a.JPG": 1.0, "d/c.JPG": None}
    with pytest.raises(Exception, match="no pose for d/c.JPG"):
        lookup.pose_required(images, poses).collect()


def test_records_round_trip_and_missing(spark, tmp_path):
    path = str(tmp_path / "r")
    assert readers.records(spark, path).count() == 0
    df = spark.createDataFrame([{"site": "01", "image": "a", "variant": "main", "error_m": 1.0}], readers.RECORD)
    writers.append_records(df, path)
    writers.append_records(df.withColumn("image", F.lit("b")), path)
    assert readers.records(spark, path, ["01"], "main").count() == 2
    assert lookup.not_done(spark.createDataFrame([("a",), ("z",)], "image string"), readers.records(spark, path)).first().image == "z"


def test_polygon_cache(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("t", [0, 0], [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]]), ("u", [1, 1], [])], readers.TILE_POLYGONS)
    writers.write_polygons(df, path)
    assert [r.patch_id for r in readers.json_lines(spark, path, readers.TILE_POLYGONS).collect()] == ["t"]


def test_image_list(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.name for r in readers.image_list(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]
    assert readers.image_list(spark, str(tmp_path / "none")).count() == 0


def test_expansion_columns(spark):
    df = spark.createDataFrame([("f", 0, [3, 1, 2], [[0.0, 1.0]] * 3, {3: 90.0}, {3: "Analytical"}, 1, 2, 4)], "filename string, seed_triangle_idx int, vertices array<int>, coordinates array<array<double>>, angles map<int, double>, axes map<int, string>, expansion_steps int, num_triangles_in_region int, num_boundary_vertices int")
    r = writers.flat_expansions(df)
    assert len(r.columns) == 21 and (r.first().ekeland_v0, r.first().ekeland_v1, r.first().axis_v1, r.first().mean_ekeland) == (90, 0, "Unknown", 30)


def test_quantile_cap(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 100)] + [("b", 100.0)], "k string, area double")
    assert sorted((r.k, r.area) for r in metrics.quantile_cap(df, "k", "area", 90.0).collect()) == [("a", 1), ("a", 2), ("a", 3)]


def test_end_to_end(spark, sf_dir):
    from cairnmap.plans.registry import QUERIES

    got = QUERIES["locate_images"](spark, sf_dir).collect()
    assert sum(r.image == r.winner.split("/")[1] for r in got) >= 0.7 * len(got) > 0


def test_stream_adds_each_image_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    locate = lambda df: df.select(*(F.lit("01").alias("site") if f.name == "site" else F.lit("main").alias("variant") if f.name == "variant" else F.col("image") if f.name == "image" else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], readers.RECORD).schema))
    for n, check in (("a", "c1"), ("b", "c1"), ("b", "c2")):
        (src / f"{n}.json").write_text(json.dumps({"image": n, "polygons": []}))
        ingest.locate_stream(ingest.image_stream(spark, str(src)), locate, out, str(tmp_path / check)).awaitTermination()
    assert sorted(r.image for r in readers.records(spark, out).collect()) == ["a", "b"]


def test_contained_names_equal_brute_force(spark):
    """Names without an equal form or number: the first map that holds the name, also where many do; repeats, blanks, nulls."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    maps = [(i, ("satellite_" if i % 3 == 0 else "") + word(rng.randint(4, 9)) + ".tif") for i in range(60)] + [(60, None), (61, "")]
    asked = [word(rng.randint(1, 5)) for _ in range(60)] + ["satellite " + word(3), "a", "a", "", "__", None]
    names = spark.createDataFrame([(n,) for n in asked], "name string")
    got = lookup.match_bounds(names, spark.createDataFrame(maps, "pos int, map string"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()

    form = lambda s: re.sub("[^a-z0-9]", "", re.sub(r"(?<=.)\.[^.]*$", "", s).strip().lower())
    plain = lambda s: re.sub("^satellite", "", s)

    def want(name):
        if name is None:
            return (None, None)
        n = form(name)
        known = [(i, form(m)) for i, m in maps if m is not None]
        for i, m in known:
            if {n, plain(n)} & {m, plain(m)}:
                return (1, i)
        return next(((3, i) for i, m in known if n in m or plain(n) in m), (None, None))

    rows = got.collect()
    assert len(rows) == len(asked)
    for r in rows:
        assert (r.tier, r.pos) == want(r.name), r
    assert {r.tier for r in rows} == {1, 3, None}


def test_first_pose_is_the_first_line(spark, tmp_path):
    """By number as text 10 comes first, by number 9; the file has 11 first, in whatever number of tasks it is read."""
    lines = [f"{100 + i},x{i}.jpg,2024-01-01,{i}.5" for i in range(3000)] + ["11,a.jpg,2024-01-01,1.5", "9,a.jpg,2024-01-01,2.5", "10,a.jpg,2024-01-01,3.5"] + [f"{i},y{i}.jpg" for i in range(3000)] + ["1,x7.jpg,2024-01-01,9"]
    (tmp_path / "poses.csv").write_text("\n".join(lines))
    images = spark.createDataFrame([("d/a.jpg",), ("d/x7.jpg",), ("d/none.jpg",)], "image string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "9000", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            poses = readers.flight_metadata(spark, str(tmp_path / "poses.csv"))
            assert size == before or poses.rdd.getNumPartitions() > 4
            got = {r.image: (r.num, r.lat) for r in lookup.pose_of(images, poses).collect()}
            assert got == {"d/a.jpg": ("11", 1.5), "d/x7.jpg": ("107", 7.5), "d/none.jpg": (None, None)}
            assert [r.num for r in poses.orderBy("position").collect()] == [x.split(",")[0] for x in lines]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numpy_files(spark, tmp_path):
    import numpy as np

    x, names = np.arange(12, dtype=np.float32).reshape(4, 3), np.array(["p", "q", "r", "s"])
    np.save(tmp_path / "a.npy", x)
    np.savez_compressed(tmp_path / "b.npz", vec=x.astype(np.float64) + 1, patch=names, other=np.zeros(9))
    np.save(tmp_path / "none.npy", x[:0])
    (tmp_path / "empty.npz").write_bytes(b"")
    (tmp_path / "c.txt").write_text("no array")
    got = readers.numpy_rows(spark, f"{tmp_path}/*.npy", {"vec": "array<double>"}, rows=3).orderBy("row").collect()
    assert [(r.row, r.vec) for r in got] == [(i, v) for i, v in enumerate(x.tolist())] and got[0].path.endswith("a.npy")
    both = readers.numpy_rows(spark, f"{tmp_path}/b.npz", {"vec": "array<float>", "patch": "string"}).orderBy("row").collect()
    assert [(r.vec, r.patch) for r in both] == list(zip((x + 1).tolist(), names.tolist()))
    assert readers.numpy_rows(spark, f"{tmp_path}/missing", {"vec": "array<float>"}).count() == 0
    np.save(tmp_path / "pickled.npy", np.array([{"a": 1}]), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        readers.numpy_rows(spark, f"{tmp_path}/pickled.npy", {"vec": "string"}).collect()
    np.savez(tmp_path / "odd.npz", vec=x, patch=names[:2])
    with pytest.raises(Exception, match="different length"):
        readers.numpy_rows(spark, f"{tmp_path}/odd.npz", {"vec": "array<float>", "patch": "string"}).collect()


def test_codes_number_distinct_values_without_one_task(spark):
    rows = spark.createDataFrame([(f"v{i * 37 % 500:03d}",) for i in range(2000)] + [(None,)], "v string")
    got = metrics.codes(rows, "v")
    assert sorted((r.code, r.v, r.n) for r in got.collect()) == [(i, f"v{i:03d}", 4) for i in range(500)]
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert metrics.codes(rows.where("v is null"), "v").count() == 0


def test_first_text_that_contains_another(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choices("abc1", k=rng.randint(0, 9))) for _ in range(150)]
    parts = sorted({"".join(rng.choices("abc1", k=rng.randint(0, 6))) for _ in range(120)} | {"", "zzzz"})
    wholes = spark.createDataFrame(list(enumerate(texts)), "pos int, m string").groupBy("m").agg(F.min("pos").alias("pos"))
    got = {r.f: r.m for r in lookup.containing(spark.createDataFrame([(p,) for p in parts], "f string"), "f", wholes, "m", "pos").collect()}
    want = {p: next((t for t in texts if p in t), None) for p in parts}
    assert got == {p: t for p, t in want.items() if t is not None} and len(got) > 40


@pytest.mark.parametrize("p", ["l1", "l2"])
def test_top_pairs_with_a_bound(spark, p):
    import numpy as np

    from cairnmap.operators import knn

    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (400, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(6)
    asked = rows.where("id % 20 = 0")
    d = np.abs(x[::20, None] - x[None]).sum(2) if p == "l1" else np.sqrt(((x[::20, None] - x[None]) ** 2).sum(2))
    for k in (1, 30, 900):
        want = sorted((round(d[i, j], 9), 20 * i, j) for i in range(20) for j in range(400) if 20 * i != j)[:k]
        got = knn.top_pairs(asked, rows, k, p, "id", "id", skip_same_id=True).collect()
        assert [(round(r.score, 9), r.query_id, r.index_id) for r in got] == want
