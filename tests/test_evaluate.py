"""The stages of an evaluation, over toy sites whose images are copies of tiles."""

import random

import pytest
from pyspark.sql import functions as F

from cairnmap.operators import knn_index, vote
from cairnmap.plans import evaluate, localize
from cairnmap.sources import layout, readers, shared, writers
from cairnmap.streaming import ingest

SITES = "site string, sat_width int, sat_height int, lt_lat double, lt_lon double, rb_lat double, rb_lon double"


def star(rng):
    x, y, n = rng.uniform(60, 400), rng.uniform(60, 400), rng.randint(5, 8)
    from math import cos, pi, sin

    return [[x + (r := rng.uniform(15, 50)) * cos(a := 2 * pi * (i + rng.uniform(0, 0.6)) / n), y + r * sin(a)] for i in range(n)]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(1)
    tiles = [(s, f"t{i}", [500 * (i % 4), 500 * (i // 4)], [star(rng) for _ in range(3)]) for s in ("01", "02") for i in range(8)]
    tiles_df = spark.createDataFrame(tiles, "site string, patch_id string, tl array<int>, polygons array<array<array<double>>>")
    index = shared.saved(localize.build_index(tiles_df)[0], "test-index")
    images = [(s, f"p{s}_{i}.jpg", polygons) for s, i, _, polygons in tiles if i != "t7"] + [("01", "blank.jpg", []), ("02", "lost.jpg", tiles[0][3])]
    poses = []
    for s, i, (x, y), _ in tiles:
        poses.append((f"p{s}_{i}.jpg", "2023-07-15", 30.0 - (y + 250) / 1999 * 0.01, 114.0 + (x + 250) / 1999 * 0.01, 450.0))
    poses.append(("blank.jpg", "2023-07-15", 29.999, 114.001, 800.0))
    return {
        "tiles": tiles_df, "index": index,
        "images": spark.createDataFrame(images, "site string, image string, polygons array<array<array<double>>>"),
        "poses": spark.createDataFrame([(j, *p) for j, p in enumerate(poses)], "position int, filename string, date string, lat double, lon double, height double"),
        "sites": spark.createDataFrame([(s, 2000, 2000, 30.0, 114.0, 29.99, 114.01) for s in ("01", "02")], SITES),
    }


def test_records_of_an_evaluation(spark, world, tmp_path):
    out = layout.Results(str(tmp_path))
    run = lambda batch, images=world["images"], **more: evaluate.evaluate(images, world["index"], world["sites"], world["poses"], out, batch, **more)
    part = world["images"].where("site = '01'")
    run("one", part)
    # The batch was killed after it was written: the same name again gives its records once.
    before = readers.records(spark, out.table("records")).drop("t_preprocess", "t_segment", "t_descriptor", "t_query", "t_total").collect()
    writers.append_records(readers.records(spark, out.table("records")).transform(lambda df: shared.saved(df, "again")), out.table("records"), "one")
    assert sorted(readers.records(spark, out.table("records")).drop("t_preprocess", "t_segment", "t_descriptor", "t_query", "t_total").collect()) == sorted(before)
    new = run("two").collect()
    assert {r.site for r in new} == {"02"} and len(new) == 7  # resumed; what has no pose is left out
    rows = {r.image: r for r in readers.records(spark, out.table("records")).collect()}
    assert len(rows) == 15 and "lost.jpg" not in rows
    for r in rows.values():
        assert (r.variant, r.k, r.season) == ("main", 5, "summer") and r.gt_patch_id is not None
        if r.image == "blank.jpg":
            assert (r.n_descriptors, r.total_votes, r.pred_patch_id, r.error_m, r.t_query) == (0, 0, None, None, 0.0)
            continue
        assert r.n_polygons == 3 and r.total_votes == 5 * r.n_descriptors and r.margin == r.votes - r.second_votes
        assert r.pred_patch_id.startswith(r.site) and r.error_m < 300 and 0 < r.t_total == pytest.approx(r.t_preprocess + r.t_segment + r.t_descriptor + r.t_query, abs=3e-4)
        if r.pred_patch_id == r.gt_patch_id:
            assert (r.gt_patch_votes, r.gt_patch_rank) == (r.votes, 1)
    right = sum(r.pred_patch_id == r.gt_patch_id == f"{r.site}/{r.image[4:-4]}" for r in rows.values())
    assert right >= 12
    assert run("three").count() == 0 and run("noise", part, variant="heading_noise_5", prepare=lambda df: df.withColumn("yaw", 5 * F.col("sign"))).count() == 8

    # The same images in stored indexes, as another variant.
    stored = evaluate.store_sites(world["index"], out)
    again = {r.image: r for r in run("stored", variant="again", stored=stored).collect()}
    assert set(stored) == {"01", "02"} and len(again) == 15
    for name, r in again.items():
        assert (r.pred_patch_id, r.votes, r.second_votes, r.error_m, r.gt_patch_rank) == tuple(rows[name][c] for c in ("pred_patch_id", "votes", "second_votes", "error_m", "gt_patch_rank"))

    found = evaluate.ablate(world["index"], world["sites"], out, ks=(5,), tiles=world["tiles"], caps=(1,)).collect()
    by = {(r.variant, r.site): r for r in found}
    assert {v for v, _ in by} == {"K=5", "Dmax=1", *evaluate.MATCHING} and {s for _, s in by} == {"01", "02", "overall"}
    # The stored descriptors are in single precision here as there: K = 5 is the evaluation again.
    for site in ("01", "02"):
        want = [r.error_m for r in rows.values() if r.site == site and r.error_m is not None]
        assert by["K=5", site].n == len(want) and by["K=5", site]["mean"] == pytest.approx(sum(want) / len(want), abs=0.01)


def test_scalability_is_measured(spark, world):
    queries = localize.image_descriptors(world["images"].where("site = '01'"))
    got = {r.sites: r for r in evaluate.scalability(world["index"], queries, (1,)).collect()}
    assert set(got) == {1, 2} and all(r.build_s > 0 and r.query_s > 0 for r in got.values()) and got[1].n_patches == 8


def test_a_stored_index_locates_alike(spark, world, tmp_path):
    index = world["index"].where("site = '01'")
    patches = vote.patch_centroids(index, "patch", "centroid_x", "centroid_y")
    queries = shared.saved(localize.image_descriptors(world["images"].where("site = '01'")), "queries")
    stored = knn_index.build(index, str(tmp_path / "i"), "descriptor_id", carry=("patch",))
    assert sorted(localize.query_images(queries, stored, patches).drop("all_votes").collect()) == sorted(localize.query_images(queries, index, patches).drop("all_votes").collect())


def test_a_killed_batch_of_a_stream_runs_again(spark, tmp_path):
    """The second batch fails after its records are written, before the stream knows: each image is there once."""
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    schema = spark.createDataFrame([], readers.RECORD).schema
    names = {"site": F.lit("01"), "variant": F.lit("main"), "image": F.col("image")}
    locate = lambda df: df.select(*(names.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))
    writers.append_records(locate(spark.createDataFrame([("old",)], "image string")), out)
    put = lambda n: (src / f"{n}.json").write_text(f'{{"image": "{n}", "polygons": []}}')
    stream = lambda: ingest.locate_stream(ingest.image_stream(spark, str(src)), locate, out, check)
    put("a"), put("old")
    stream().awaitTermination()
    put("b"), (src / "again.json").write_text('{"image": "a", "polygons": []}')
    real = writers.append_records

    def dies(*args):
        real(*args)
        raise RuntimeError("killed")

    writers.append_records = dies
    try:
        with pytest.raises(Exception, match="killed"):
            stream().awaitTermination()
    finally:
        writers.append_records = real
    assert sorted(r.image for r in readers.records(spark, out).collect()) == ["a", "b", "old"]
    put("c")
    stream().awaitTermination()
    stream().awaitTermination()
    assert sorted(r.image for r in readers.records(spark, out).collect()) == ["a", "b", "c", "old"]
