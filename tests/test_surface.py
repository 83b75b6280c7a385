"""SQL text against column builders, and order statistics by refinement."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cairnmap.functions import distance, geo, text
from cairnmap.operators import metrics, order
from cairnmap.plans import surface

NAMES = ["a/b/Satellite01.TIF", "x007_12b.jpg", "none", ".hidden", "00", "", None]
DATES = ["2023-07-15", "2023/10/02", "20240105", "09/30/2023", "2023-06-01T10:00:00", "2023:08:08 01:02:03", "soon", None]
HEIGHTS = [399.0, 400.0, 699.9, 700.0, 1200.0, 2000.0, float("nan"), float("inf"), None]


def test_functions_equal_the_column_builders(spark):
    surface.register(spark)
    rng = random.Random(1)
    rows = [([rng.uniform(-400, 400) for _ in range(5)], [rng.uniform(-400, 400) for _ in range(5)], rng.choice(NAMES), rng.choice(DATES), rng.choice(HEIGHTS), rng.uniform(-9, 9)) for _ in range(120)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, n string, d string, h double, x double")
    df.createOrReplaceTempView("surface_rows")
    a, b = F.col("a"), F.col("b")
    builders = {"l1_distance(a, b)": distance.l1(a, b), "l2_distance(a, b)": distance.l2(a, b), "angular_l1(a, b)": distance.angular_l1(a, b), "complex_chord(a, b)": distance.complex_chord(a, b), "circular_mean(a, b)": distance.circular_mean(a, b), "error_metres(x, x, 2, 3)": geo.error_metres(F.col("x"), F.col("x"), 2, 3), "altitude_band(h)": geo.altitude_band(F.col("h")), "season(d)": geo.season(F.col("d")), "normal_name(n)": text.normal_name(F.col("n")), "numeric_id(n)": text.numeric_id(F.col("n"))}
    got = spark.sql("SELECT " + ", ".join(builders) + " FROM surface_rows").collect()
    want = df.select(*builders.values()).collect()
    for g, w in zip(got, want):
        for x, y in zip(g, w):
            assert x == (pytest.approx(y) if isinstance(y, float) else y)
    assert len(builders) == len(surface.FUNCTIONS)


def test_table_functions_at_the_edges(spark):
    surface.register(spark)
    rows = [(0, True, 1, [0.0, 0.0]), (0, False, 7, [1.0, 1.0]), (0, False, 8, None), (0, False, 6, [1.0, 1.0]), (1, True, 1, [0.0, 0.0]), (2, False, 9, [0.0, 0.0])]
    spark.createDataFrame(rows, "part int, asked boolean, id long, vec array<float>").createOrReplaceTempView("surface_knn")
    got = spark.sql("SELECT * FROM nearest(TABLE(surface_knn) PARTITION BY part ORDER BY (asked DESC), 5, 1)").collect()
    assert [tuple(r) for r in got] == [(1, 6, 2.0), (1, 7, 2.0)]
    votes = spark.createDataFrame([(1, 5), (1, 4), (2, 3), (3, None)], "image long, patch long")
    votes.createOrReplaceTempView("surface_votes")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM plurality(TABLE(surface_votes) PARTITION BY image)").collect())
    assert got == [(1, 4, 1, 1, 0, 2, 2), (2, 3, 1, 0, 1, 1, 1)]


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_quantiles_equal_the_definition(spark, accuracy):
    rng = random.Random(accuracy)
    groups = {"one": [4.0], "few": [3.0, 1.0, 2.0], "alike": [7.0] * 900, "two": [1.0] * 500 + [9.0] * 500, "far": [rng.paretovariate(0.2) for _ in range(1500)], "even": [rng.random() for _ in range(1000)], None: [rng.gauss(0, 1) for _ in range(301)]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("one", None), ("one", float("nan")), ("none", float("inf"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for p in (0.0, 0.003, 0.5, 0.995, 1.0):
        got = {r.k: (r.n, r["quantile"]) for r in order.quantile(df, ["k"], "v", p, accuracy=accuracy).collect()}
        assert set(got) == set(groups)
        for k, values in groups.items():
            at = (len(values) - 1) * p
            s, lo = sorted(values), int(at)
            want = s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (at - lo)
            assert got[k] == (len(values), pytest.approx(want)), (k, p)
    assert order.quantile(df.where("k = 'none'"), [], "v", 0.5).count() == 0
    every = [v for values in groups.values() for v in values]
    assert order.quantile(df, [], "v", 0.5, accuracy=accuracy).first()["quantile"] == pytest.approx(statistics.median(every))


def test_caps_and_steps_of_any_values(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice("abc"), rng.paretovariate(1.2) * 10) for _ in range(700)] + [("d", 5.0), ("d", 6.0), (None, 1.0)], "k string, area double")
    plain, refined = (sorted(metrics.quantile_cap(df, "k", "area", 900.0, any_values=x).collect()) for x in (False, True))
    assert [(r.k, r.area) for r in plain] == [(r.k, r.area) for r in refined] and [r.cap for r in plain] == pytest.approx([r.cap for r in refined])
    steps = spark.createDataFrame([("a", float(v)) for v in [1] * 50 + [2] * 3 + [3]], "site string, error_m double")
    want = sorted(metrics.ecdf(steps, "site").collect())
    monkeypatch.setattr(metrics, "STRETCH", 7)
    assert sorted(metrics.ecdf(steps, "site").collect()) == want and len(want) == 54 and want[-1].fraction == 1.0


def test_metrics_of_any_values(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice("abc"), rng.expovariate(0.02)) for _ in range(999)] + [("d", None), (None, 3.0)], "site string, error_m double")
    key = lambda r: r.site
    plain, refined = (sorted(metrics.metrics_by(df, ["site"], any_values=x).collect(), key=key) for x in (False, True))
    assert [r.asDict() for r in refined] == [pytest.approx(r.asDict()) if r.n else r.asDict() for r in plain]
    whole = metrics.metrics_by(df, any_values=True).first()
    assert whole.median == pytest.approx(metrics.metrics_by(df).first().median)
    assert metrics.metrics_by(df.limit(0), any_values=True).first().n == 0
