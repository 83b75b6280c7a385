import pytest

#: What every operator must stand: nulls, empty and blank texts, ties, repeated rows, a long text, clashing extra columns.
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "one two three four five six seven eight nine ten", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \t\n ", "en", "b"),
    (None, "no id here but some words all the same", "en", "b"),
    (None, None, "en", "b"),
    (6, "short", "en", "c"),
    (7, "Ünïcode wörds – ñ ß 漢字 \x00 end", "de", "c"),
    (8, "long " + "word soup with many words " * 20_000, "en", "a"),
    (8, "another text under the same id", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 1, 2.0, "x", [1]) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score double, h string, k array<int>")


@pytest.fixture(scope="session")
def work(spark, tmp_path_factory):
    from cairnmap.llm.work import Work

    return lambda: Work(spark, "test")
