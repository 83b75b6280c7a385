import pytest

from cairnmap.llm import mixing


def test_water_filling(spark):
    rows = [("a", 100), ("b", 1000), ("c", 1000), ("d", 10), (None, 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert sum(got.values()) == pytest.approx(2110)
    assert got["a"] == 300 and got["d"] == 30 and got[None] == 0
    assert got["b"] / got["c"] == pytest.approx(2)


def test_words_come_near_their_targets_and_reruns_agree(spark, work):
    docs = [(i, " ".join(["w"] * (1 + i % 17)), f"s{i % 7}" if i % 11 else None) for i in range(3000)] + [(9000 + i, "w", "hot") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, work()).collect()
    assert len(got) == len(docs)
    for s in {d[2] for d in docs}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.mix_size * r.mix_copies for r in mine) - mine[0].mix_target) <= 17
        assert max(r.mix_copies for r in mine) - min(r.mix_copies for r in mine) <= 1 and max(r.mix_copies for r in mine) <= 3
    again = mixing.mix_sources(df.repartition(7), work()).collect()
    assert sorted((r.doc_id, r.mix_copies) for r in got) == sorted((r.doc_id, r.mix_copies) for r in again)


def test_weights_change_the_odds(spark, work):
    docs = [(i, "a b c d", "x" if i % 2 else "y", 5.0 if i % 4 < 2 else 1.0) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, good double")
    got = mixing.mix_sources(df, work(), weights=(1, 3), weight="good").collect()
    mean = lambda rows: sum(r.mix_copies for r in rows) / len(rows)
    for s in "xy":
        mine = [r for r in got if r.source == s]
        assert mean([r for r in mine if r.good == 5]) > 2 * mean([r for r in mine if r.good == 1])


def test_odd_rows(spark, work, odd):
    got = mixing.mix_sources(odd, work()).collect()
    assert len(got) == odd.count() and all(0 <= r.mix_copies <= 3 for r in got)
    assert mixing.mix_sources(odd.limit(0), work()).count() == 0


def test_clashing_names(spark, work):
    docs = [(i, "a b c d" * (i % 5), "x" if i % 3 else None, i) for i in range(300)]
    plain = spark.createDataFrame(docs, "doc_id long, text string, source string, n long")
    want = sorted((r.doc_id, r.mix_size, r.mix_copies) for r in mixing.mix_sources(plain, work()).collect())
    names = ["_own", "_key", "_q", "_bin", "_s", "_target", "_plan", "_whole", "_p", "s", "s2", "size", "key", "last", "a.b", "mix_size", "mix_copies"]
    from pyspark.sql import functions as F

    odd = plain.select("*", *(F.lit(7).alias(c) for c in names))
    got = mixing.mix_sources(odd, work())
    assert got.columns == ["doc_id", "text", "source", "n", *(c for c in names if c not in mixing.ADDED), *mixing.ADDED]
    rows = got.collect()
    assert sorted((r.doc_id, r.mix_size, r.mix_copies) for r in rows) == want
    assert all(r[c] == 7 for r in rows for c in names if c not in mixing.ADDED) and all(r.n == r.doc_id for r in rows)
