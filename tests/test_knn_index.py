"""The stored index gives the rows of the scan, and skips pieces."""

import numpy as np
import pytest

from cairnmap.operators import knn, knn_index


def frame(spark, x, name, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], f"{name} long, vec array<float>, label int")


def rows(df):
    return sorted((r.query_id, r["rank"], r.index_id, round(r.distance, 9)) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(knn_index, "PIECE", 16)
    monkeypatch.setattr(knn_index, "BUFFER", 200)
    monkeypatch.setattr(knn_index, "SAMPLE", 300)
    monkeypatch.setattr(knn_index, "BLOCK", 7)


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("kind", ["clusters", "grid", "equal"])
def test_same_rows_as_the_scan(spark, tmp_path, small, p, kind):
    rng = np.random.default_rng(p)
    x = {"clusters": lambda n: rng.normal(rng.integers(0, 9, (n, 1)) * 20.0, 1, (n, 5)), "grid": lambda n: rng.integers(0, 4, (n, 3)), "equal": lambda n: np.ones((n, 2))}[kind]
    index, asked = frame(spark, x(900), "index_id"), frame(spark, x(40), "query_id")
    stored = knn_index.build(index.repartition(5), f"{tmp_path}/i", carry=("label",))
    assert stored.size().first().n_rows == 900
    for k in (1, 6, 1000):
        assert rows(knn_index.search(asked, stored, k, p)) == rows(knn.knn_join(asked, index, k, p))
    assert {(r.index_id, r.label) for r in knn_index.search(asked, stored, 5, p).collect()} <= {(i, i % 3) for i in range(900)}


def test_most_pieces_are_skipped(spark, tmp_path, small):
    rng = np.random.default_rng(1)
    x = rng.normal(rng.integers(0, 30, (3000, 1)) * 50.0, 1, (3000, 5))
    stored = knn_index.build(frame(spark, x, "index_id"), f"{tmp_path}/i")
    asked = frame(spark, x[::50] + 0.1, "query_id")
    seen = knn_index.visits(asked, stored, 5).first()
    assert seen.all == 60 * stored.size().first().n_pieces and 0 < seen.visited < seen.all / 5


def test_same_id_slices_and_reopening(spark, tmp_path, small):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 180, (500, 5))
    both = frame(spark, x, "id")
    stored = knn_index.build(both, f"{tmp_path}/i", "id", dims=(2, 3))
    stored = knn_index.open_index(spark, stored.path)
    asked = both.where("id % 20 = 0")
    want = rows(knn.knn_join(asked, both, 4, query_id="id", index_id="id", dims=(2, 3), skip_same_id=True))
    assert rows(knn_index.search(asked, stored, 4, query_id="id", dims=(2, 3), skip_same_id=True)) == want


def test_edges(spark, tmp_path, small):
    index = frame(spark, [[0, 0], [1, 1]], "index_id").unionByName(spark.createDataFrame([(9, None, 1)], "index_id long, vec array<float>, label int"))
    stored = knn_index.build(index, f"{tmp_path}/i", carry=("label",))
    asked = frame(spark, [[0, 1]], "query_id")
    assert [r.index_id for r in knn_index.search(asked, stored, 9).orderBy("rank").collect()] == [0, 1]
    assert knn_index.search(asked.limit(0), stored, 3).count() == 0
    empty = knn_index.build(index.limit(0), f"{tmp_path}/e", carry=("label",))
    assert knn_index.search(asked, empty, 3).count() == 0 and empty.size().first().n_pieces == 0
    with pytest.raises(ValueError):
        knn_index.search(asked, stored, 0)
    with pytest.raises(Exception, match="different length"):
        knn_index.search(frame(spark, [[1, 2, 3]], "query_id"), stored, 1).collect()
    with pytest.raises(Exception, match="different length"):
        knn_index.build(index.unionByName(frame(spark, [[1, 2, 3]], "index_id", 20)), f"{tmp_path}/x")


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_rough_distances_lose_no_pair(p, scale):
    """Rows a hair apart from a query, or from each other, and equal ones; bounds that are met exactly."""
    rng = np.random.default_rng(p)
    s = np.repeat(rng.normal(0, 1, (300, 24)), 2, 0)
    s[1::2] += rng.normal(0, 1e-7, (300, 24)) * rng.integers(0, 2, (300, 1))
    s, scaled = (s * scale).astype(np.float32).astype(float), scale
    q = s[::7] + 1e-9 * scaled
    d = knn.distances(q, s, p)
    bound = np.sort(d, 1)[:, 4]
    r, c, far = knn.Near(s, p).within(q, bound, 1000)
    assert set(zip(r.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= bound[:, None]))))
    assert np.array_equal(far, d[r, c])
    ids = np.arange(len(s))
    near = np.sort(knn.Near(s, p).nearest(q, 5, None, ids), 1)
    assert (near >= np.sort(d, 1)[:, :5] * (1 - 1e-12)).all()


def test_neither_side_is_broadcast_and_wide_leaves_are_few(spark, tmp_path, small):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 20))
    index = frame(spark, x, "index_id")
    stored = knn_index.build(index, f"{tmp_path}/i")
    assert len(stored.leaf) <= 600 // (16 * knn_index.WIDE)
    found = knn_index.search(frame(spark, x[::20] + 0.01, "query_id"), stored, 3)
    assert rows(found) == rows(knn.knn_join(frame(spark, x[::20] + 0.01, "query_id"), index, 3))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_query_meets_no_more_of_a_larger_index(spark, tmp_path, monkeypatch):
    """More queries than a block: the rows around a query bound its answer, closer the more rows there are."""
    for name, value in (("PIECE", 32), ("SAMPLE", 1024), ("BLOCK", 100)):
        monkeypatch.setattr(knn_index, name, value)
    met, rng = [], np.random.default_rng(3)
    asked = frame(spark, rng.uniform(0, 1, (400, 3)), "query_id")
    for n in (2048, 16384):
        index = frame(spark, rng.uniform(0, 1, (n, 3)), "index_id")
        stored = knn_index.build(index, f"{tmp_path}/{n}")
        met.append(knn_index.visits(asked, stored, 2).first().visited / 400)
    # Leaves at the border have fewer neighbours, and there are more of those in a small index.
    assert met[1] < 2.2 * met[0]
    assert rows(knn_index.search(asked, stored, 2)) == rows(knn.knn_join(asked, index, 2))


def test_queries_around_equal_rows_and_leaves_of_few(spark, tmp_path, small):
    """A leaf of many pieces, queries of one leaf in several tasks, leaves of fewer rows than k; a row itself left out."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.ones((700, 4)), rng.uniform(0, 50, (300, 4))])
    both = frame(spark, x, "id")
    stored = knn_index.build(both, f"{tmp_path}/i", "id")
    asked = both.where("id % 5 = 0")
    for k in (3, 30):
        want = rows(knn.knn_join(asked, both, k, query_id="id", index_id="id", skip_same_id=True))
        assert rows(knn_index.search(asked, stored, k, query_id="id", skip_same_id=True)) == want
