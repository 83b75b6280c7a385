"""op12 against distances of all pairs."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairnmap.llm import name_join


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance by the textbook, whole table."""
    far, last = len(a) + len(b), {}
    t = {(-1, j): far for j in range(-1, len(b) + 1)} | {(i, -1): far for i in range(-1, len(a) + 1)}
    t |= {(0, j): j for j in range(len(b) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), column
            if a[i - 1] == b[j - 1]:
                column = j
            t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (a[i - 1] != b[j - 1]), t[k - 1, m - 1] + i - k - 1 + 1 + j - m - 1)
            t[i, j] = t[i, j] if k and m else min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        last[a[i - 1]] = i
    return t[len(a), len(b)]


def near_names(n: int, seed: int) -> list[str]:
    rng, names = random.Random(seed), ["ab", "ba", "a", "ca", "abc", "öß漢", "ößa漢", "aaaa", "aaa"]
    while len(names) < n:
        s = list(rng.choice(names))
        for _ in range(rng.randint(1, 2)):
            at = rng.randint(0, len(s))
            s[at : at + rng.randint(0, 2)] = rng.sample("abcö", rng.randint(0, 2))
        names.append("".join(s[:12]))
    return names


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_pairs_equal_all_pairs(spark, most):
    left, right = near_names(60, 1), near_names(50, 2)
    got = name_join.name_pairs(spark.createDataFrame([(x,) for x in left], "left string"), spark.createDataFrame([(x,) for x in right], "right string"), most).collect()
    want = {(a, b, distance(a, b)) for a in left for b in right if a and b and distance(a, b) <= most}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_ca_and_abc_are_two_apart():
    assert distance("ca", "abc") == 2
    import pyarrow as pa

    a, n = name_join._codes(pa.array(["ca", "a cat", ""]))
    b, m = name_join._codes(pa.array(["abc", "an act", ""]))
    assert name_join.distances(a, n, b, m, 3).tolist() == [2, 2, 0]


def misspelt(name: str, key: int) -> str:
    h = zlib.crc32(str(key).encode())
    if h % 2 == 0 and len(name) >= 2:
        at = h % (len(name) - 1)
        name = name[:at] + name[at + 1] + name[at] + name[at + 2 :]
    return name


def form(name: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in name if c not in " \t\n\x0b\x0c\r")


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(5)
    names = [x.replace("a", "A", 1) + rng.choice(["", " ", "\t x"]) for x in near_names(120, 7)] + [None, "", " \n", "ab", "ab"]
    clients = [(i, x, 1) for i, x in enumerate(names)] + [(None, "ab", 1), (3, names[3], 1)]
    vendors = [(i * 7, x, "n") for i, x in enumerate(near_names(40, 7) + [None, "", "  ", "K"])] + [(None, "ab", "n")]
    spark.createDataFrame(clients, "client_id long, name string, distance int").write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame(vendors, "vendor_id long, name string, id string").write.parquet(f"{tmp_path}/vendors.parquet")
    want = {}
    for v, name, _ in vendors:
        t = form(misspelt(name or "", v)) if v is not None else ""
        for c, s in {(c, form(s or "")) for c, s, _ in clients if c is not None}:
            if s and t and (d := distance(s, t)) <= 1:
                n, least, crc = want.get((v, d), (0, c, 0))
                want[v, d] = n + 1, min(least, c), crc + zlib.crc32(str(c).encode())
    got = name_join.op12_name_edit_join(spark, str(tmp_path))
    assert got.columns == ["vendor_id", "distance", "n_clients", "first_client_id", "clients_crc"]
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == want and len(want) > 30


def test_odd_rows(spark, odd, work):
    named = odd.select(F.col("doc_id").alias("id"), F.when(F.length("text") < 1000, F.col("text")).alias("name"), "n", "score")
    got = {(r.id, r.distance): r for r in name_join.name_join(named, named, work(), 1).collect()}
    assert got[1, 0].n_left == got[2, 0].n_left == 2 and got[2, 0].first_left == 1 and got[6, 0].n_left == 1
    assert None not in {k[0] for k in got} and 4 not in {k[0] for k in got}
    empty = named.where("id < 0")
    assert name_join.name_join(empty, named, work()).collect() == name_join.name_join(named, empty, work()).collect() == []


def test_a_very_long_name(spark, work):
    long = "".join(random.Random(1).choices("abcdefgh", k=3000))
    left = spark.createDataFrame([(1, long), (2, long[:1500] + long[1501:]), (3, long[:-2])], "id long, name string")
    right = spark.createDataFrame([(5, long)], "id long, name string")
    assert [(r.distance, r.n_left) for r in name_join.name_join(left, right, work()).orderBy("distance").collect()] == [(0, 1), (1, 1)]
