"""Overlapping tiles blended by blocks, against sums over pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmap.operators import detections

KEYS = ["image", "left", "top"]


def by_pixel(tiles, size):
    """{image: blended mask} from (image, left, top, mask) by definition."""
    high = {i: max(t for j, _, t, _ in tiles if j == i) + size for i, *_ in tiles}
    wide = {i: max(x for j, x, _, _ in tiles if j == i) + size for i, *_ in tiles}
    one = 1 - np.abs(2 * np.linspace(0, 1, size) - 1)
    w = np.maximum(np.outer(one, one), 0.001)
    total, weight = ({i: np.zeros((high[i], wide[i])) for i in high} for _ in range(2))
    for i, x, y, m in tiles:
        total[i][y : y + size, x : x + size] += w * np.array(m)
        weight[i][y : y + size, x : x + size] += w
    return {i: np.clip(total[i] / (weight[i] + 1e-6), 0, 1) for i in total}


@pytest.fixture
def tiles():
    rng = np.random.default_rng(0)
    return [(i, x, y, rng.random((12, 12)).astype(np.float32).tolist()) for i in "ab" for y in (0, 8, 16) for x in (0, 8, 12)]


def test_blocks_equal_sums_over_pixels(spark, tiles):
    df = spark.createDataFrame(tiles, "image string, left int, top int, mask array<array<float>>").repartition(5)
    want, got = by_pixel(tiles, 12), {}
    for r in detections.blended_blocks(df, size=12, cell=4).collect():
        got[r.image, r.block_row, r.block_col] = np.array(r["values"]).reshape(4, 4)
    assert len(got) == 2 * 7 * 6
    for (i, r, c), block in got.items():
        assert block == pytest.approx(want[i][4 * r : 4 * r + 4, 4 * c : 4 * c + 4], abs=1e-9)
    for r in detections.windows(detections.blended_blocks(df, size=12, cell=4), df, size=12, cell=4).collect():
        assert np.array(r.mask) == pytest.approx(want[r.image][r.top : r.top + 12, r.left : r.left + 12], abs=1e-9)


def test_tiles_that_do_not_fit(spark, tiles):
    df = spark.createDataFrame(tiles, "image string, left int, top int, mask array<array<float>>")
    with pytest.raises(ValueError):
        detections.blended_blocks(df, size=12, cell=5)
    with pytest.raises(Exception, match="multiples"):
        detections.blended_blocks(df.withColumn("left", F.col("left") + 1), size=12, cell=4).collect()
    nulls = df.withColumn("mask", F.when(F.col("image") == "a", F.col("mask")))
    assert {r.image for r in detections.blended_blocks(nulls, size=12, cell=4).collect()} == {"a"}
    assert detections.blended_blocks(df.limit(0), size=12, cell=4).count() == 0


def test_blocks_do_not_depend_on_steps(spark, tiles, monkeypatch):
    """Blocks that go on from one step, or Arrow batch, to the next; tiles in one place; an image without a name."""
    many = [*tiles, *((i, 8, 8, m) for i, _, _, m in tiles[:5]), *((None, x, y, m) for i, x, y, m in tiles if i == "a")]
    df = spark.createDataFrame(many, "image string, left int, top int, mask array<array<float>>").repartition(4)
    read = lambda: {(r.image, r.block_row, r.block_col): np.array(r["values"]) for r in detections.blended_blocks(df, size=12, cell=4).collect()}
    want = read()
    assert len(want) == 3 * 7 * 6
    monkeypatch.setattr(detections, "STEP", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = read()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    pixels = by_pixel([t for t in many if t[0] == "b"], 12)["b"]
    assert all(v.reshape(4, 4) == pytest.approx(pixels[4 * r : 4 * r + 4, 4 * c : 4 * c + 4], abs=1e-9) for (i, r, c), v in want.items() if i == "b")


def test_blocks_are_not_called_one_by_one(spark, tiles):
    df = spark.createDataFrame(tiles, "image string, left int, top int, mask array<array<float>>")
    assert "FlatMapGroups" not in detections.blended_blocks(df, size=12, cell=4)._jdf.queryExecution().executedPlan().toString()


def test_a_building_across_tiles(spark):
    """Two tiles see halves of a building, one of them with another instance that is not sure."""
    mask = lambda a, b: [[0.9 if a <= c < b and 4 <= r < 14 else 0.0 for c in range(20)] for r in range(20)]
    rows = [("m", 0, 0, 0.9, mask(8, 20)), ("m", 10, 0, 0.8, mask(0, 14)), ("m", 10, 0, 0.3, [[1.0] * 20] * 20), ("m", 10, 0, 0.7, mask(2, 5)), ("n", 0, 0, 0.1, mask(0, 20))]
    df = spark.createDataFrame(rows, "image string, left int, top int, score double, mask array<array<double>>")
    best = {(r.image, r.left): r.mask for r in detections.best_masks(df, KEYS).collect()}
    old = {(r.image, r.left): r.mask for r in detections.combined_mask(detections.confident(df), KEYS).collect()}
    assert set(best) == set(old) == {("m", 0), ("m", 10)} and all(np.array(best[k]) == pytest.approx(np.array(old[k])) for k in old)
    got = {(r.image, r.left): r.polygons for r in detections.blended_polygons(df, KEYS, size=20, cell=10).collect()}
    assert len(got[("m", 0)]) == len(got[("m", 10)]) == 1 and got[("n", 0)] == []
    xs = [p[0] for p in got[("m", 10)][0]]
    assert min(xs) <= 1 and 12 <= max(xs) <= 14
