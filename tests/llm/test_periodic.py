"""op13 against a search of all stretches and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from cairnmap.llm import periodic


def by_definition(words, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """Every (start, length, period): a maximal stretch of a period, which is its smallest."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q):
                part = words[i : i + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng: random.Random) -> list[str]:
    words: list[str] = []
    for _ in range(rng.randint(0, 5)):
        kind = rng.random()
        if kind < 0.4:
            words += [rng.choice(["x", "y", "Z", "z"]) for _ in range(rng.randint(0, 40))]
        elif kind < 0.9:
            q = rng.choice([1, 2, 3, 7, 8, 9, 12, 20])
            unit = [rng.choice("abcd") if rng.random() < 0.5 else f"w{rng.randint(0, 99)}" for _ in range(q)]
            n = rng.choice([23, 24, 25, 3 * q - 1, 3 * q, 3 * q + 1, 5 * q, 60])
            words += (unit * n)[:n]
        else:
            words += words[-rng.randint(1, 30) :] * rng.randint(1, 4)
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (10, 4), (2, 3)])
def test_runs_equal_the_definition(least, times):
    rng = random.Random(least)
    texts = [periodic_words(rng) for _ in range(150)]
    found = periodic.runs_of(pa.array([rng.choice([" ", "\n", " \t "]).join(t) for t in texts]), least, times)
    some = 0
    for words, (split, runs) in zip(texts, found):
        assert [w.decode() for w in split] == words
        assert runs == by_definition(words, least, times)
        some += len(runs)
    assert some > 50


def test_two_words_only_and_all_alike():
    rng = random.Random(9)
    fibonacci = ["a"]
    a, b = ["a"], ["a", "b"]
    for _ in range(9):
        a, b = b, b + a
    for words in (["a"] * 500, [rng.choice("ab") for _ in range(900)], b[:400], fibonacci):
        assert periodic.runs_of(pa.array([" ".join(words)]))[0][1] == by_definition(words)


def test_least_overlap():
    for least, times in ((24, 3), (6, 2), (10, 4), (2, 3), (7, 2)):
        assert periodic.overlap(least, times) == min(max(least, times * q) - q for q in range(1, 200))


def test_a_very_long_text_of_one_line():
    (words, runs), = periodic.runs_of(pa.array(["word soup with many words " * 40_000]))
    assert runs == [(0, 200_000, 5)] and periodic.collapsed(words, runs) == words[:5]


def expected(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_definition(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    milli = 1000 * best[1] // best[2] if best else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_by_definition(spark, odd, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(periodic_words(rng)) if i % 3 else " ".join(f"t{rng.randint(0, 400)}" for _ in range(rng.randint(1, 90))), i) for i in range(300)] + [(r.doc_id, r.text, 0) for r in odd.collect() if len(r.text or "") < 1000]
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(d, t) for d, t, _ in rows), key=key)


def test_odd_rows(odd):
    got = periodic.periodic_runs(odd).collect()
    assert len(got) == odd.count() and {r.text for r in got if r.doc_id in (3, 4, 5)} == {""}
    assert [r.runs for r in got if r.doc_id == 8 and r.runs] != [] and periodic.periodic_runs(odd.where("n < 0")).collect() == []
