"""Edit-distance join of names: symmetric deletion neighbourhoods, then exact banded distance.

If at most d edits (insertions, deletions, substitutions, exchanges of adjacent code points) turn one name into another,
deleting at most d code points from either leaves the same text: an edit costs either side one code point at most.  So each
distinct name of both sides emits all its variants with up to d deletions; equal variants meet in an equi-join of hashes,
pairs are told apart, and each is verified by its unrestricted Damerau-Levenshtein distance, computed in a band.

Rows of equal names meet as one name, so a common name is no hot group; their ids are counted before and joined after.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import CRC, Work, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs whose distances are computed at a time.
PAIRS = 4096


def form(name: str | Column) -> Column:
    """A name with A-Z lower-cased and without white space; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.translate(name, UPPER, LOWER), r"[\x20\x09-\x0D]+", ""), F.lit(""))


def variants(names: DataFrame, name: str, deletions: int) -> DataFrame:
    """names with a column ``key``: a row for each way to delete up to ``deletions`` code points, with the hash of what is
    left.  Row by row, so that a very long name never stands there in all its variants at once."""
    level, found = names.withColumn("_v", F.col(name)), None
    for step in range(deletions + 1):
        part = level.withColumn("key", F.xxhash64("_v")).drop("_v")
        found = part if found is None else found.unionByName(part)
        if step < deletions:
            level = level.where("_v <> ''").select("*", F.explode(F.sequence(F.lit(1), F.length("_v"))).alias("_i"))
            level = level.withColumn("_v", F.expr("concat(substring(_v, 1, _i - 1), substring(_v, _i + 1))")).drop("_i")
    return found


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, a row each (0 after the end), and their numbers."""
    raw = [np.frombuffer(t.encode("utf-32-le"), np.int32) for t in texts.to_pylist()]
    lengths = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), int(lengths.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.concatenate(raw) if raw else 0
    return out, lengths


def distances(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: int) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of each pair of rows of code points (of n and m), ``most + 1`` where it is
    larger.  Lowrance and Wagner's recurrence over all pairs at once, in the band |i - j| <= most.

    ``at(i, j)``: distance of the first i and the first j; the last exchange ends in the last place before i whose code
    point is b's j-th, and the last before j whose code point is a's i-th; what lies between is deleted and inserted.  Only
    the band is kept: place j - i + most + 1 of row i, with a place too far on either side."""
    count, wide, high = len(a), b.shape[1], most + 1
    at = np.full((a.shape[1] + 1, 2 * most + 3, count), high, np.int32)
    for e in range(most + 1):
        at[0, e + most + 1] = e
        if e <= a.shape[1]:
            at[e, most + 1 - e] = e
    row_of, every = np.zeros((wide + 1, count), np.int64), np.arange(count)
    for i in range(1, a.shape[1] + 1):
        column, lo = np.zeros(count, np.int64), max(1, i - most)
        # A last match further left than this costs too much.
        for j in range(max(1, lo - most - 1), min(lo, wide + 1)):
            column = np.where(a[:, i - 1] == b[:, j - 1], j, column)
        for j in range(lo, min(wide, i + most) + 1):
            equal, k, row = a[:, i - 1] == b[:, j - 1], j - i + most + 1, row_of[j]
            best = np.minimum(np.minimum(at[i - 1, k + 1], at[i, k - 1]) + 1, at[i - 1, k] + ~equal)
            before = at[np.maximum(row - 1, 0), np.clip(column - row + most + 1, 0, 2 * most + 2), every]
            swap = np.where((row > 0) & (column > 0), before + (i - row) + (j - column - 1), high)
            at[i, k] = np.minimum(np.minimum(best, swap), high)
            column = np.where(equal, j, column)
        for j in range(max(1, i - 2 * most - 1), min(wide, i + 2 * most + 1) + 1):
            row_of[j] = np.where(a[:, i - 1] == b[:, j - 1], i, row_of[j])
    off = m - n + most + 1
    return np.where(np.abs(m - n) <= most, at[n, np.clip(off, 0, 2 * most + 2), every], high)


def verifier(most: int):
    """mapInArrow function: (left, right) -> the pairs at a distance of at most ``most``, with it."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(lo, PAIRS)
                a, n = _codes(batch.column(0))
                b, m = _codes(batch.column(1))
                # Pairs of alike lengths are computed together, so that a long name costs no short ones.
                order, found = np.argsort(np.maximum(n, m), kind="stable"), np.full(len(n), most + 1, np.int64)
                for part in np.array_split(order, max(1, -(-len(order) * int(max(n.max(initial=0), m.max(initial=0)) + 1) * (2 * most + 3) // (8 << 20)))):
                    if len(part):
                        wide, other = int(n[part].max()), int(m[part].max())
                        found[part] = distances(a[part, :wide], n[part], b[part, :other], m[part], most)
                keep = np.flatnonzero(found <= most)
                rows = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found[keep], pa.int32())], names=["left", "right", "distance"])

    return run


def name_pairs(left: DataFrame, right: DataFrame, most: int = 1) -> DataFrame:
    """left (left string), right (right string) -> left, right, distance: every pair of different texts of either side at a
    distance of at most ``most``, once.  Nulls and empty texts take no part; repeated rows count once; an empty side gives
    no rows.  A name of L code points has about L ** most variants, made one by one; only hashes of them move.
    """
    sides, met = [], None
    for df, name in ((left, "left"), (right, "right")):
        sides.append(df.where(F.col(name) != "").select(name).distinct().select(name, F.xxhash64(name).alias(f"{name}_lo"), F.xxhash64(F.lit(1), name).alias(f"{name}_hi")))
        each = variants(sides[-1].withColumn(f"{name}_n", F.length(name)), name, most).drop(name)
        met = each if met is None else met.join(each.hint("merge"), "key").where(F.abs(F.col("left_n") - F.col("right_n")) <= most)
    pairs = met.select("left_lo", "left_hi", "right_lo", "right_hi").distinct()
    for side, name in zip(sides, ("left", "right")):
        pairs = pairs.join(side.hint("merge"), [f"{name}_lo", f"{name}_hi"])
    return pairs.select("left", "right").mapInArrow(verifier(most), "left string, right string, distance int")


def name_join(left: DataFrame, right: DataFrame, work: Work, most: int = 1) -> DataFrame:
    """left (id long, name string) and right (id, name), names as they are to be compared -> id (of right), distance,
    n_left, first_left, left_crc: how many left ids lie at each distance, the smallest, and the sum of the unsigned crc32 of
    their decimals.

    Rows without id or name (null, empty) take no part.  An id counts once for each name it has; the names of a right id add
    up.  No row for a right id without partner.  Nothing is collected, and no table is broadcast.
    """
    known = lambda df: df.select(F.col("id").cast("long").alias("id"), "name").where("id is not null and name <> ''").distinct()
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    per_name = work.save(known(left).groupBy("name").agg(F.count("*").alias("n_left"), F.min("id").alias("first_left"), F.sum(crc).alias("left_crc")), "left")
    theirs = known(right)
    pairs = name_pairs(per_name.select(F.col("name").alias("left")), theirs.select(F.col("name").alias("right")), most)
    counted = pairs.join(per_name.withColumnRenamed("name", "left").hint("merge"), "left")
    counted = counted.groupBy("right", "distance").agg(F.sum("n_left").alias("n_left"), F.min("first_left").alias("first_left"), F.sum("left_crc").alias("left_crc"))
    met = theirs.withColumnRenamed("name", "right").hint("merge").join(counted, "right")
    return work.only(met.groupBy("id", "distance").agg(*(f(c).alias(c) for f, c in ((F.sum, "n_left"), (F.min, "first_left"), (F.sum, "left_crc")))), "joined")


def misspelt(name: str, key: str) -> Column:
    """``name`` with two adjacent code points exchanged, if the crc32 h of the decimal key is even: those at h mod (L - 1)."""
    swap = "concat(substring(`{0}`, 1, at), substring(`{0}`, at + 2, 1), substring(`{0}`, at + 1, 1), substring(`{0}`, at + 3))".format(name)
    h = f"crc32(cast(cast(`{key}` as string) as binary))"
    return F.expr(f"if({h} % 2 = 0 and length(`{name}`) >= 2, transform(array(cast({h} % (length(`{name}`) - 1) as int)), at -> {swap})[0], `{name}`)")


def op12_name_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vendor, whose name is misspelt first, and each distance up to 1: the clients of such names."""
    clients = table(spark, sf_dir, "clients").select(F.col("client_id").alias("id"), form("name").alias("name"))
    vendors = table(spark, sf_dir, "vendors").select(F.col("vendor_id").alias("id"), form(misspelt("name", "vendor_id")).alias("name"))
    found = name_join(clients, vendors, Work(spark, "name-join"), 1)
    return found.select(F.col("id").alias("vendor_id"), "distance", F.col("n_left").alias("n_clients"), F.col("first_left").alias("first_client_id"), F.col("left_crc").alias("clients_crc"))


FORM = rf"regexp_replace(translate({{0}}, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', '', 'g')"
CUT = "left({0}, i) || substr({0}, i + 2)"
ORACLE = {
    "op12_name_edit_join": f"""
WITH c AS (SELECT DISTINCT client_id AS id, {FORM.format("name")} AS s, {CRC.format("client_id")} AS crc FROM clients WHERE client_id IS NOT NULL AND name IS NOT NULL),
h AS (SELECT vendor_id AS id, name, {CRC.format("vendor_id")} AS h FROM vendors WHERE vendor_id IS NOT NULL AND name IS NOT NULL),
p AS (SELECT id, name, CASE WHEN h % 2 = 0 AND length(name) >= 2 THEN h % (length(name) - 1) END AS pos FROM h),
v AS (SELECT DISTINCT id, {FORM.format("CASE WHEN pos IS NULL THEN name ELSE left(name, pos) || substr(name, pos + 2, 1) || substr(name, pos + 1, 1) || substr(name, pos + 3) END")} AS t FROM p),
s AS (SELECT DISTINCT s FROM c WHERE s <> ''), t AS (SELECT DISTINCT t FROM v WHERE t <> ''),
sc AS (SELECT s, i, {CUT.format("s")} AS x FROM (SELECT s, unnest(range(length(s))) AS i FROM s)),
tc AS (SELECT t, i, {CUT.format("t")} AS x FROM (SELECT t, unnest(range(length(t))) AS i FROM t)),
sw AS (SELECT t, left(t, i) || substr(t, i + 2, 1) || substr(t, i + 1, 1) || substr(t, i + 3) AS x FROM tc WHERE i < length(t) - 1),
one AS (SELECT s, t FROM sc JOIN tc USING (i, x) UNION SELECT s, t FROM sc JOIN t ON x = t UNION SELECT s, t FROM s JOIN tc ON s = x UNION SELECT s, t FROM s JOIN sw ON s = x),
d AS (SELECT s, s AS t, 0 AS distance FROM s JOIN t ON s = t UNION ALL SELECT s, t, 1 FROM one WHERE s <> t)
SELECT v.id AS vendor_id, CAST(distance AS INTEGER) AS distance, count(*) AS n_clients, min(c.id) AS first_client_id, CAST(sum(crc) AS BIGINT) AS clients_crc
FROM d JOIN c USING (s) JOIN v USING (t) GROUP BY ALL""",
}
QUERIES = {"op12_name_edit_join": op12_name_edit_join}
