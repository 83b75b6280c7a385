"""op11 against all pairs, and its fingerprints against Spark's own XXH64."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmap.llm import simhash


def least_reachable(ids, links) -> dict[int, int]:
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        r, s = sorted((top(a), top(b)))
        up[s] = r
    return {d: top(d) for d in up}


def by_all_pairs(prints: list[tuple[int, int]], radius: int) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable; prints: (doc_id, fingerprint)."""
    near = ((a, b) for i, (a, x) in enumerate(prints) for b, y in prints[:i] if (x ^ y).bit_count() <= radius)
    return least_reachable([d for d, _ in prints], near)


def plain_fingerprint(spark, text: str | None, k: int = 4) -> str:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    k = min(k, len(words))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
    if not shingles:
        return "0" * 16
    hashes = [r.h % 2**64 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def test_fingerprints_are_by_definition(spark, odd, work):
    got = {(r.doc_id, r.fingerprint) for r in simhash.simhash_classes(odd, work()).collect()}
    for r in odd.select("doc_id", "text").distinct().collect():
        if len(r.text or "") < 1000:
            assert (r.doc_id, plain_fingerprint(spark, r.text)) in got, r
    assert plain_fingerprint(spark, "One two\x0bthree\tFOUR  five") == f"{simhash.fingerprint(b'one TWO three four five'):016x}"


def test_odd_rows(odd, work):
    rows = sorted(simhash.simhash_classes(odd, work()).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.fingerprint))
    assert len(rows) == odd.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[1] == of[2] == {1} and of[3] == of[4] == of[5] == {3} and of[None] == {None} and of[8] == {8}
    assert [r.kept for r in rows if r.doc_id is None] == [True, True]


def test_repeated_ids_join_what_their_texts_are_linked_with(spark, work):
    rows = [(9, "alpha beta gamma delta epsilon"), (9, "one two three four five six"), (4, "one two three four five six"), (7, "alpha beta gamma delta epsilon")]
    got = simhash.simhash_classes(spark.createDataFrame(rows, "doc_id long, text string"), work()).collect()
    assert {r.component_id for r in got} == {4} and len(got) == 4


def test_empty(spark, work):
    assert simhash.simhash_classes(spark.createDataFrame([], "doc_id long, text string, kept int"), work()).collect() == []


@pytest.mark.parametrize("radius,share", [(0, 1 << 17), (1, 6), (2, 1 << 17), (3, 6), (4, 1 << 17), (4, 6), (5, 1 << 17)])
def test_links_equal_all_pairs(spark, radius, share):
    """Families of near fingerprints at all distances; a small share makes the deal deeper, few variants split the task."""
    rng = np.random.default_rng(radius)
    prints: set[int] = set()
    for _ in range(12):
        at = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(12):
            prints.add(at)
            for b in rng.choice(64, int(rng.integers(1, 8)), replace=False).tolist():
                at ^= 1 << b
    ids = rng.permutation(len(prints)).tolist()
    listed = list(zip(ids, sorted(prints)))
    signed = [(p - 2**64 if p >= 2**63 else p, i) for i, p in listed]
    links = simhash.linked(spark.createDataFrame(signed, "print long, id long"), radius, 6, share)
    assert least_reachable(ids, [(r.a, r.b) for r in links.collect()]) == by_all_pairs(listed, radius)


def test_a_task_that_holds_few_variants_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20, np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in (1, 2, 3, 4, 5, 6))]))
    used = np.zeros(len(prints), np.int64)
    whole = simhash.joined(len(prints), *simhash.stars(prints, used, 64, 4))
    monkeypatch.setattr(simhash, "VARIANTS", 5000)
    parts = simhash.joined(len(prints), *simhash.stars(prints, used, 64, 4))
    want = by_all_pairs([(i, int(p)) for i, p in enumerate(prints)], 4)
    assert whole.tolist() == parts.tolist() == [want[i] for i in range(len(prints))]


def test_whole_documents_against_all_pairs(spark, sf_dir, work):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in simhash.op11_simhash_near_dedup(spark, sf_dir).collect()}
    prints = [(r.doc_id, simhash.fingerprint((r.text or "").encode())) for r in docs.collect()]
    assert {d: int(got[d].fingerprint, 16) for d, _ in prints} == dict(prints)
    assert {d: r.component_id for d, r in got.items()} == by_all_pairs(prints, 4)
