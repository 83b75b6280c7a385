import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnmap.operators import geometry as g
from cairnmap.operators import many_polygons, polygons

#: Shapes whose angles are known (fixed values).
L_SHAPE = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
C_SHAPE = [(0, 0), (6, 0), (6, 2), (3, 2), (3, 4), (6, 4), (6, 6), (0, 6)]


def test_l_shape_has_interior_triangles_only():
    t = g.interior_triangles(np.array(L_SHAPE, float))
    centres = np.array(L_SHAPE, float)[np.array(t)].mean(1)
    assert len(t) == 4 and g.inside(np.array(L_SHAPE, float), centres).all()


def test_depth_changes_descriptors():
    assert not np.array_equal(g.descriptors(L_SHAPE, 1)[0], g.descriptors(L_SHAPE, 4)[0])


def test_opening_angles_closed_form():
    pts = np.array(L_SHAPE, float)
    e = g.opening_angles(pts, list(range(6)), [3, 0])
    assert e == pytest.approx([90, 180], abs=1e-6)
    assert g.opening_angles(pts, list(range(6))[::-1], [3, 0]) == pytest.approx([90, 180], abs=1e-6)


def test_single_triangle():
    d, c = g.descriptors([(0, 0), (4, 0), (1, 3)])
    assert d.shape == (1, 5) and d[0, 2:].tolist() == [180, 180, 180]
    assert c[0].tolist() == pytest.approx([5 / 3, 1])


def test_growth_never_raises_the_least_angle():
    assert g.descriptors(C_SHAPE, 4)[0][:, 2].min() <= g.descriptors(C_SHAPE, 1)[0][:, 2].min()


def test_cap_zero_is_180():
    assert (g.descriptors(C_SHAPE, 0)[0][:, 2:] == 180).all()


@pytest.mark.parametrize("shape", [[], [(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)], [(1, 1)] * 5, [(0, 0), (float("nan"), 1), (2, 0)]])
def test_degenerate_polygons_are_empty(shape):
    assert g.descriptors(shape)[0].shape == (0, 5)


def test_angles_of_a_zero_side():
    assert g.angles((0, 0), (0, 0), (1, 1)) == [0, 0, 0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=14, unique=True))
def test_delaunay_circles_are_empty(points):
    pts = np.array(points, float)
    for t in g.delaunay(pts):
        a, b, c = pts[list(t)]
        m = 2 * np.array([b - a, c - a])
        centre = np.linalg.solve(m, [(b @ b) - (a @ a), (c @ c) - (a @ a)])
        r = math.dist(centre, a)
        assert all(math.dist(centre, p) >= r - 1e-6 * max(1, r) for p in pts)


def test_simplify_drops_points_on_lines():
    square = [(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10)]
    assert len(g.simplify(square, 1.0)) == 4
    assert len(g.simplify(square, 0.01)) == 5


def test_outlines_and_components():
    mask = np.zeros((10, 12), bool)
    mask[1:4, 1:5] = True
    mask[6:9, 7:11] = True
    assert sorted(abs(g.signed_area(r)) for r in g.outlines(mask)) == [12, 12]
    assert g.component_boxes(mask) == [(1, 1, 5, 4, 12), (7, 6, 11, 9, 12)]
    assert g.outlines(mask, 13) == [] and g.outlines(np.zeros((3, 3))) == []


def test_polygon_rows(spark):
    rows = spark.createDataFrame([("a", 10, 20, [[float(x), float(y)] for x, y in L_SHAPE]), ("b", 0, 0, None), ("c", 0, 0, [[0.0, 0.0]])], "patch_id string, left int, top int, polygon array<array<double>>")
    got = polygons.polygon_descriptors(rows, offset=("left", "top")).toPandas()
    d, c = g.descriptors(L_SHAPE)
    assert got.patch_id.tolist() == ["a"] * 4
    assert got[["alpha1", "alpha2", "e1", "e2", "e3"]].to_numpy() == pytest.approx(d)
    assert got.centroid_x.to_numpy() == pytest.approx(c[:, 0] + 10) and got.centroid_y.to_numpy() == pytest.approx(c[:, 1] + 20)


def test_masks(spark):
    rows = spark.createDataFrame([("a", [[0.0] * 20] * 5 + [[0.0] * 5 + [0.9] * 10 + [0.0] * 5] * 10), ("b", [[0.1]]), ("c", None)], "image string, mask array<array<double>>")
    got = {r.image: r.polygons for r in polygons.masks_to_polygons(rows).collect()}
    assert len(got["a"]) == 1 and len(got["a"][0]) == 4 and got["b"] == [] and got["c"] == []


def test_several_caps_equal_single_ones(spark):
    rows = spark.createDataFrame([("c", [[float(x), float(y)] for x, y in C_SHAPE])], "patch_id string, polygon array<array<double>>")
    got = polygons.polygon_descriptors(rows, cap=(0, 1, 4)).toPandas()
    for cap in (0, 1, 4):
        mine = got[got.cap == cap].sort_values("triangle_idx")
        assert np.array_equal(mine[["alpha1", "alpha2", "e1", "e2", "e3"]].to_numpy(np.float32), g.descriptors(C_SHAPE, cap)[0])


def test_many_polygons_at_once_equal_single_ones():
    """Stars, points anywhere, and points on a lattice, where several triangulations are right."""
    rng = np.random.default_rng(3)
    star = lambda n: (turn := 2 * np.pi * (np.arange(n) + 0.8 * rng.random(n)) / n, rad := rng.uniform(15, 50, n)) and np.stack([200 + rad * np.cos(turn), 90 + rad * np.sin(turn)], 1)
    shapes = [make(n) for n in (*range(3, 11), 19) for make in (star, star, lambda n: rng.random((n, 2)), lambda n: rng.integers(0, 5, (n, 2)).astype(float))]
    shapes += [np.array(L_SHAPE, float), np.zeros((0, 2)), np.array([[0, 0], [np.nan, 1], [2, 0]])]
    of, cap, number, d, centre = many_polygons.descriptors(np.concatenate(shapes), np.array([len(s) for s in shapes]), (0, 2, 4))
    for i, s in enumerate(shapes):
        want, centres = g.described(s, (0, 2, 4))
        for c in range(3):
            mine = (of == i) & (cap == c)
            assert number[mine].tolist() == list(range(len(centres)))
            assert d[mine] == pytest.approx(want[c], abs=1e-9) and np.array_equal(centre[mine], centres)


def test_most_polygons_are_not_taken_one_by_one(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(g, "described", None)
    assert len(many_polygons.descriptors(rng.random((700, 2)), np.full(100, 7), (4,))[0]) > 300


def test_rows_in_double_precision(spark):
    """A centre of 5.0249999...: rounded to hundredths it differs once it has been single precision."""
    corners = [[0.0, 0.0], [15.0, 0.0], [0.07499999, 3.0]]
    rows = spark.createDataFrame([(1, corners)], "vec_id long, polygon array<array<double>>")
    got = polygons.polygon_descriptors(rows, kind="double").first()
    assert got.centroid_x == sum(x for x, _ in corners) / 3 and round(got.centroid_x, 2) == 5.02
    assert polygons.polygon_descriptors(rows).first().centroid_x == np.float32(got.centroid_x)
