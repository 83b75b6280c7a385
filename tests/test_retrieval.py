import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmap.functions import distance
from cairnmap.operators import knn, vote


def frame(spark, ids, vectors, name):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], f"{name} long, vec array<float>")


@pytest.mark.parametrize("p", [1, 2, 3])
def test_knn_equals_brute_force(spark, p):
    rng = np.random.default_rng(p)
    q, s = rng.integers(0, 4, (7, 3)), rng.integers(0, 4, (60, 3))
    got = knn.knn_join(frame(spark, range(7), q, "query_id"), frame(spark, range(60), s, "index_id").repartition(5), 6, p).orderBy("query_id", "rank").collect()
    for i in range(7):
        d = (np.abs(q[i] - s) ** p).sum(1) ** (1 / p)
        want = sorted(zip(np.round(d, 9), range(60)))[:6]
        assert [(round(r.distance, 9), r.index_id) for r in got if r.query_id == i] == [(pytest.approx(a), b) for a, b in want]


@pytest.mark.parametrize("wide", [4, 20])
def test_knn_blocks_give_the_same(spark, monkeypatch, wide):
    """More queries than a block: in a stored index, or, in many components, block after block."""
    rng = np.random.default_rng(0)
    q, s = frame(spark, range(20), rng.normal(size=(20, wide)), "query_id"), frame(spark, range(50), rng.normal(size=(50, wide)), "index_id")
    s = s.withColumn("label", F.col("index_id") % 3)
    one = knn.knn_join(q, s, 3, carry=("label",)).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(knn, "BLOCK", 6)
    assert knn.knn_join(q, s, 3, carry=("label",)).orderBy("query_id", "rank").collect() == one


def test_knn_edges(spark):
    q, s = frame(spark, [1], [[0, 0]], "query_id"), frame(spark, [5, 6], [[1, 1], [2, 2]], "index_id")
    assert knn.knn_join(q, s, 9).count() == 2
    assert knn.knn_join(q.limit(0), s, 3).count() == 0 and knn.knn_join(q, s.limit(0), 3).count() == 0
    nulls = spark.createDataFrame([(1, None)], "query_id long, vec array<float>")
    assert knn.knn_join(nulls, s, 3).count() == 0
    with pytest.raises(ValueError):
        knn.knn_join(q, s, 0)
    with pytest.raises(Exception, match="different length"):
        knn.knn_join(q, frame(spark, [7], [[1, 2, 3]], "index_id"), 1).collect()


def test_lower_bound_by_any_component(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b]) for a, b in rng.normal(size=(50, 2, 5))], "a array<double>, b array<double>")
    bad = rows.where(distance.l1(F.col("a"), F.col("b")) + 1e-9 < F.abs(F.col("a")[2] - F.col("b")[2]))
    assert bad.count() == 0


def test_metrics_by_name():
    with pytest.raises(ValueError):
        distance.metric("none")
    with pytest.raises(ValueError):
        distance.von_mises(None, None, 0)
    assert distance.bessel_i0(4.0) == pytest.approx(11.301921952136330)


PAIRS = [("f1", "A", 4.1), ("f1", "A", 5.8), ("f2", "A", 3.2), ("f2", "B", 6.7), ("f3", "A", 2.9), ("f3", "C", 8.1)]


def matches(spark, pairs=PAIRS):
    return spark.createDataFrame([("i", i, i, q, p, d) for i, (q, p, d) in enumerate(pairs)], "image string, index_id int, ordinal int, query_id string, patch string, distance double")


def test_worked_vote_example(spark):
    r = vote.plurality(matches(spark)).first()
    assert (r.winner, r.votes, r.runner_up, r.margin, r.total_votes, r.n_voted) == ("A", 4, 1, 3, 6, 3)
    assert vote.vote_map(matches(spark)).first().all_votes == {"A": 4, "B": 1, "C": 1}


def test_ties(spark):
    m = matches(spark, [("f1", "B", 1.0), ("f1", "A", 2.0)])
    assert vote.plurality(m).first().winner == "A"
    assert vote.plurality_first_seen(m).first().winner == "B"
    assert vote.weighted(m).first().winner == "B"
    assert vote.top_one(m).first().winner == "B"


def test_one_patch_has_no_runner_up(spark):
    r = vote.plurality(matches(spark, [("f1", "A", 1.0)])).first()
    assert (r.runner_up, r.margin) == (0, 1)


def test_weights_are_cut_not_rounded(spark):
    r = vote.weighted(matches(spark, [("f1", "A", 0.1)])).first()
    assert r.shown_votes == 0 and r.weight == pytest.approx(1 / 1.1)


def test_truth_rank(spark):
    m = matches(spark, [("a", "A", 1.0), ("b", "A", 1.0), ("c", "B", 1.0), ("d", "C", 1.0)])
    truth = spark.createDataFrame([("i", "C"), ("i", "Z")], "image string, patch string")
    got = {r.patch: (r.gt_votes, r.gt_rank) for r in vote.truth_rank(m, truth).collect()}
    assert got == {"C": (1, 2), "Z": (0, None)}


def test_no_matches_no_row(spark):
    assert vote.plurality(matches(spark).limit(0)).count() == 0
