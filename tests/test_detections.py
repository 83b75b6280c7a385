import pytest

from cairnmap.operators import detections


def test_masks_combine_and_outline(spark):
    a = [[0.9 if 2 <= c < 12 and 2 <= r < 12 else 0.0 for c in range(30)] for r in range(30)]
    b = [[0.8 if 15 <= c < 25 and 15 <= r < 25 else 0.1 for c in range(30)] for r in range(30)]
    low = [[1.0] * 30] * 30
    df = spark.createDataFrame([("t", 0.9, a), ("t", 0.5, b), ("t", 0.49, low), ("u", 0.1, low)], "tile string, score double, mask array<array<double>>")
    m = {r.tile: r.mask for r in detections.combined_mask(detections.confident(df), ["tile"]).collect()}
    assert list(m) == ["t"] and m["t"][5][5] == 0.9 and m["t"][20][20] == 0.8 and m["t"][0][0] == 0.1
    got = detections.to_polygons(df, ["tile"]).collect()
    assert len(got) == 1 and len(got[0].polygons) == 2


def test_query_pool(spark):
    df = spark.createDataFrame([(k, i) for k in "abcde" for i in range(6)], "site string, i int")
    got = detections.query_pool(df, "site", "i", per_key=5, total=12).collect()
    assert sorted({r.site for r in got}) == ["a", "b", "c"] and len(got) == 15


def test_locate_flow(spark):
    from pyspark.sql import functions as F

    import cairnmap

    square = [[0.0, 0.0], [40.0, 3.0], [55.0, 44.0], [4.0, 30.0]]
    kite = [[0.0, 0.0], [60.0, 5.0], [20.0, 33.0], [5.0, 70.0]]
    tiles = spark.createDataFrame([("01", "p0", [0, 0], [square]), ("01", "p1", [500, 100], [kite])], "site string, patch_id string, tl array<int>, polygons array<array<array<double>>>")
    index, patches = cairnmap.build_index(tiles)
    images = spark.createDataFrame([("i", [kite]), ("none", [])], "image string, polygons array<array<array<double>>>")
    queries = cairnmap.image_descriptors(images)
    found = cairnmap.query_images(queries, index, patches, k=1)
    r = found.first()
    assert found.count() == 1 and r.winner == "01/p1" and r.runner_up == 0
    assert cairnmap.query_images(queries, index, patches, top1=True).first().winner == "01/p1"
    assert cairnmap.query_images(queries, index, patches, k=1, weighted=True, p=2).first().winner == "01/p1"
    assert cairnmap.query_top_n_patches(queries, index, patches, n=1, k=1).first().top_n[0].patch == "01/p1"
    shown = cairnmap.truth_and_top(found, spark.createDataFrame([("i", 500.0, 150.0)], "image string, gt_px_x double, gt_px_y double")).collect()
    assert [(x.kind, x.rank, x.error_px) for x in shown[:1]] == [("truth", None, 0.0)] and shown[1].patch == "01/p1" and shown[1].error_px < 100
    sites = spark.createDataFrame([("01", 1000, 1000, 30.0, 114.0, 29.99, 114.01)], "site string, sat_width int, sat_height int, lt_lat double, lt_lon double, rb_lat double, rb_lon double")
    poses = spark.createDataFrame([("i", 29.9985, 114.0053, 450.0, "2023-07-15")], "image string, lat double, lon double, height double, date string")
    at = cairnmap.locate(found.withColumn("site", F.lit("01")), sites, poses).first()
    assert at.season == "summer" and at.alt_band == "400-700" and at.error_m < 60
    assert at.pred_lon == pytest.approx(114.0 + at.pred_px_x / 999 * 0.01)
