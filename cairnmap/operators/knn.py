"""Exact K-nearest-neighbour join of a stated query set against an index table of any size.

Queries go out in blocks of bounded size; each task scans its part of the index once per block, keeps the k best of each
query, with the columns that they carry, and emits only those, so the shuffle has ``k`` rows for each query and task.  The
last choice is a ranked window that Spark also cuts to k rows before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..sources import shared

#: Queries of one block; with 64 single-precision components, 4 MB.
BLOCK = 16_384
#: Components up to which boxes leave most of an index out.
NARROW = 16
#: A piece of distances stays in a core's cache.
_ROWS, _QUERIES = 1_024, 64


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(lengths) > 1 or (dim is not None and len(lengths) and lengths[0] != dim):
        raise ValueError(f"vectors of different length: {lengths.tolist()}, wanted {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(q: np.ndarray, s: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances of all rows of q to all rows of s, summed component by component in double precision."""
    total, d = np.zeros((len(q), len(s))), np.empty((len(q), len(s)))
    across = np.ascontiguousarray(s.T)
    for j in range(q.shape[1]):
        np.subtract(q[:, j, None], across[j], out=d)
        if p == 2:
            np.multiply(d, d, out=d)
        else:
            np.abs(d, out=d)
            if p > 2:
                np.power(d, p, out=d)
        total += d
    return total if p == 1 else np.sqrt(total) if p == 2 else total ** (1 / p)


def _apart(q: np.ndarray, s: np.ndarray, p: int) -> np.ndarray:
    """Distances of row n of q to row n of s, as distances() sums them."""
    total = np.zeros(len(q))
    for a, b in zip(q.T, s.T):
        d = np.abs(a - b)
        total += d if p == 1 else d * d if p == 2 else np.power(d, p)
    return total if p == 1 else np.sqrt(total) if p == 2 else total ** (1 / p)


class Near:
    """Rows s to which queries are compared.  What is surely farther than a query's bound is found out by a cheaper sum: a
    matrix product for p = 2, and for p = 1 |a - b| = 2 max(a, b) - a - b in single precision.  Its rounding is allowed for,
    and pairs that may count get their distance as distances() sums it."""

    def __init__(self, s: np.ndarray, p: int):
        self.s, self.p = s, p
        if p == 2:
            self.norm = (s * s).sum(1)
        elif p == 1:
            self.across = np.ascontiguousarray(s.T, np.float32)
            self.sum, self.size = s.sum(1), np.abs(s).sum(1).max(initial=0)

    def _rough(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rough distances (squared for p = 2) and by how much they may be wrong, for each query."""
        if self.p == 2:
            norm = (q * q).sum(1)
            return norm[:, None] + self.norm - 2 * (q @ self.s.T), 1e-14 * (8 + q.shape[1]) * (norm + self.norm.max(initial=0))
        total, d = np.zeros((len(q), len(self.s)), np.float32), np.empty((len(q), len(self.s)), np.float32)
        for a, b in zip(q.T.astype(np.float32), self.across):
            np.maximum(a[:, None], b, out=d)
            total += d
        return 2 * total - q.sum(1)[:, None] - self.sum, 3e-7 * (8 + q.shape[1]) * (np.abs(q).sum(1) + self.size)

    def nearest(self, q: np.ndarray, k: int, own: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
        """The k smallest distances of each query (fewer for fewer rows), each more than it is by a hair at most, never less.
        Rows that have the id a query has in ``own`` are left out."""
        rough, wrong = self._rough(q) if self.p < 3 else (distances(q, self.s, self.p), np.zeros(len(q)))
        if own is not None:
            rough[own[:, None] == ids[None, :]] = np.inf
        far = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, :k].astype(np.float64) + wrong[:, None]
        return np.sqrt(np.maximum(far, 0)) if self.p == 2 else far

    def within(self, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of pairs within the query's bound: all of them, or the k nearest of each query and more."""
        if self.p < 3 and np.isfinite(bound).all():
            rough, wrong = self._rough(q)
            # A NaN is not surely far.
            r, c = np.nonzero(~(rough > ((bound * bound if self.p == 2 else bound) * (1 + 1e-12) + wrong)[:, None]))
            if len(r) <= rough.size // 16 and (wrong < 1e25).all():
                far = _apart(q[r], self.s[c], self.p)
                some = far <= bound[r]
                return r[some], c[some], far[some]
        d = distances(q, self.s, self.p)
        if d.shape[1] >= k:
            bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero((d <= bound[:, None]) & (d < np.inf))
        return r, c, d[r, c]


def _best(rows: list[tuple], k: int) -> tuple:
    """Of (query number, distance, index id, carried Arrow arrays) the k best of each query, in order."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), None
    q, d, i = (np.concatenate([r[n] for r in rows]) for n in range(3))
    order = np.lexsort((i, d, q))
    at = q[order]
    order = order[np.arange(len(q)) - np.searchsorted(at, at) < k]
    carried = [pa.concat_arrays([r[3][n] for r in rows]).take(pa.array(order)) for n in range(len(rows[0][3]))]
    return q[order], d[order], i[order], carried


def knn_join(queries: DataFrame, index: DataFrame, k: int, p: int = 1, query_id: str = "query_id", index_id: str = "index_id", vec: str = "vec", dims: tuple[int, int] | None = None, carry: Sequence[str] = (), skip_same_id: bool = False) -> DataFrame:
    """(query_id, index_id, *carry, distance, rank): for each query the k nearest index rows under the Minkowski metric p,
    by distance, then index_id.  ``dims`` = (start, length), 0-based, compares a slice.  Rows without a vector take no part;
    fewer index rows than k give all of them; an empty side gives no rows.  ``skip_same_id`` leaves a row itself out.

    More queries than a block, in NARROW components of single precision at most, are searched in a stored index
    (knn_index), to whose leaves they move; in many components, where few leaves can be left out, block after block.
    """
    if k < 1 or p < 1:
        raise ValueError("k and p must be positive")
    part = F.slice(vec, dims[0] + 1, dims[1]) if dims else F.col(vec)
    asked = queries.where(F.col(vec).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), part.alias("vec"))
    scanned = index.where(F.col(vec).isNotNull()).select(F.col(index_id).cast("long").alias("index_id"), part.alias("vec"), *carry)
    schema = scanned.drop("vec").schema
    types = dict(zip(carry, to_arrow_schema(scanned.select(*carry).schema).types)) if carry else {}
    spark, blocks = queries.sparkSession, 1 + asked.count() // BLOCK
    if blocks > 1:
        wide = scanned.select(F.size("vec")).first()
        if wide and wide[0] <= NARROW and dict(scanned.dtypes)["vec"] == "array<float>":
            from . import knn_index

            stored = knn_index.build(scanned, shared.fresh(spark, "index"), carry=tuple(carry))
            return knn_index.search(asked, stored, k, p, skip_same_id=skip_same_id)
        # Each block is a filter over them, so they are made once.
        asked = shared.saved(asked, "queries")
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows and blocks > 1:
            continue
        ids = block.column(0).to_numpy()
        vectors = _matrix(block.column(1).combine_chunks()) if block.num_rows else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast((ids, vectors))

        def run(batches, sent=sent):
            ids, q = sent.value
            kept: list[tuple] = []
            # No row beyond the k-th distance found so far can count; ties with it still can, by id.
            size, bound = 0, np.full(len(ids), np.inf)
            for batch in batches if len(ids) else ():
                for lo in range(0, batch.num_rows, _ROWS):
                    piece = batch.slice(lo, _ROWS)
                    own, s = piece.column(0).to_numpy(), _matrix(piece.column(1), q.shape[1])
                    for a in range(0, len(q), _QUERIES):
                        d = distances(q[a : a + _QUERIES], s, p)
                        if skip_same_id:
                            d[ids[a : a + _QUERIES, None] == own[None, :]] = np.inf
                        limit = bound[a : a + _QUERIES]
                        if d.shape[1] >= k and np.isinf(limit).any():
                            limit = bound[a : a + _QUERIES] = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                        r, c = np.nonzero((d <= limit[:, None]) & (d < np.inf))
                        kept.append((r + a, d[r, c], own[c], [piece.column(n).take(pa.array(c)) for n in carry]))
                        size += len(r)
                    if size > 4 * k * len(q):
                        kept = [_best(kept, k)]
                        at, far = kept[0][0], kept[0][1]
                        full = np.flatnonzero(np.bincount(at, minlength=len(ids)) == k)
                        bound[full] = np.minimum(bound[full], far[np.searchsorted(at, full, "right") - 1])
                        size = len(at)
            r, d, i, carried = _best(kept, k)
            carried = carried or [pa.array([], types[n]) for n in carry]
            yield pa.RecordBatch.from_arrays([pa.array(i), *carried, pa.array(ids[r] if len(ids) else r), pa.array(d)], names=["index_id", *carry, "query_id", "distance"])

        near = scanned.mapInArrow(run, StructType([*schema.fields, StructField("query_id", LongType()), StructField("distance", DoubleType())]))
        found = near if found is None else found.unionByName(near)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "index_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "index_id", *carry, "distance", "rank")


def nearest_one(points: DataFrame, candidates: DataFrame, key: str, px: str, py: str, cx: str, cy: str, name: str, order: str) -> DataFrame:
    """For each row of points its nearest candidate of the same key in the plane; on a tie the first by ``order``."""
    both = points.join(candidates, key)
    d2 = (F.col(px) - F.col(cx)) ** 2 + (F.col(py) - F.col(cy)) ** 2
    return both.groupBy(key, px, py).agg(F.min_by(name, F.struct(d2, order)).alias(name), F.sqrt(F.min(d2)).alias("distance"))


def nearest_point(points: DataFrame, candidates: DataFrame, point_id: str, at: tuple[str, str], candidate_id: str, there: tuple[str, str]) -> DataFrame:
    """(point_id, candidate_id, distance): for each point its nearest candidate in the plane; on a tie the smallest id.  The
    candidates are scanned once for each block of points, never paired with all of them in a shuffle."""
    asked = points.select(F.col(point_id).alias("query_id"), F.array(*(F.col(c).cast("double") for c in at)).alias("vec"))
    rows = candidates.select(F.col(candidate_id).alias("index_id"), F.array(*(F.col(c).cast("double") for c in there)).alias("vec"))
    return knn_join(asked, rows, 1, 2).select(F.col("query_id").alias(point_id), F.col("index_id").alias(candidate_id), "distance")


def _within(block: pa.Table, k: int, p: int, sample: tuple[np.ndarray, np.ndarray], skip_same_id: bool):
    """mapInArrow function: (index_id, vec) -> the task's k best pairs.  The k-th score among the queries and a sample of the
    index bounds the answer before the first row; the bound falls as pairs are found, and only pairs under it are kept."""
    ids = block.column(0).to_numpy()
    q = _matrix(block.column(1).combine_chunks()) if block.num_rows else np.zeros((0, 0))

    def best(found, k):
        score, a, b = (np.concatenate([f[n] for f in found]) for n in range(3))
        order = np.lexsort((b, a, score))[:k]
        return score[order], a[order], b[order]

    def closest(own, s, bound, found, size):
        for lo in range(0, len(q), _QUERIES):
            d = distances(q[lo : lo + _QUERIES], s, p)
            if skip_same_id:
                d[ids[lo : lo + _QUERIES, None] == own[None, :]] = np.inf
            r, c = np.nonzero((d <= bound) & (d < np.inf))
            found.append((d[r, c], ids[r + lo], own[c]))
            size += len(r)
            if size >= 4 * k:
                found[:] = [best(found, k)]
                size, bound = k, min(bound, found[0][0][-1])
        return bound, size

    def run(batches):
        bound, found, size = np.inf, [], 0
        if len(ids) and len(sample[0]):
            first: list = []
            for lo in range(0, len(sample[0]), _ROWS):
                bound, size = closest(sample[0][lo : lo + _ROWS], sample[1][lo : lo + _ROWS], bound, first, size)
            score = best(first, k)[0] if first else []
            # Sums in another order may differ by a hair.
            bound = score[-1] * (1 + 1e-12) + 1e-12 if len(score) == k else np.inf
        size = 0
        for batch in batches if len(ids) else ():
            for lo in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(lo, _ROWS)
                bound, size = closest(piece.column(0).to_numpy(), _matrix(piece.column(1), q.shape[1]), bound, found, size)
        score, a, b = best(found, k) if found else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], names=["query_id", "index_id", "score"])

    return run


def top_pairs(queries: DataFrame, index: DataFrame, k: int, metric, query_id: str = "query_id", index_id: str = "index_id", vec: str = "vec", skip_same_id: bool = False) -> DataFrame:
    """The k closest pairs of a query and an index row overall, by score, then ids.  l1 and l2 by name run in blocks of
    queries, one scan of the index each; a task emits k pairs at most, those under a bound that a sample of the index and
    the pairs it has seen set.  Any other metric, a function of two array columns, scores each query of a stated set
    against all rows."""
    if k < 1:
        raise ValueError("k must be positive")
    near = None
    if metric in ("l1", "l2"):
        asked = queries.where(F.col(vec).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(vec).alias("vec"))
        scanned = index.where(F.col(vec).isNotNull()).select(F.col(index_id).cast("long").alias("index_id"), F.col(vec).alias("vec"))
        some = scanned.orderBy(F.xxhash64("index_id"), "index_id").limit(_ROWS).toArrow()
        sample = (some.column(0).to_numpy(), _matrix(some.column(1).combine_chunks()) if some.num_rows else np.zeros((0, 0)))
        blocks = 1 + asked.count() // BLOCK
        for b in range(blocks):
            block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
            part = scanned.mapInArrow(_within(block, k, 1 if metric == "l1" else 2, sample, skip_same_id), "query_id long, index_id long, score double")
            near = part if near is None else near.unionByName(part)
    else:
        left = queries.select(F.col(query_id).alias("query_id"), F.col(vec).alias("_q"))
        right = index.select(F.col(index_id).alias("index_id"), F.col(vec).alias("_s"))
        blocks = 1 + left.count() // BLOCK
        for b in range(blocks):
            # A block of the stated queries is bounded, so it goes to all rows; each keeps its own k best.
            block = left.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            part = right.join(F.broadcast(block), how="cross").select("query_id", "index_id", metric(F.col("_q"), F.col("_s")).alias("score")).orderBy("score", "query_id", "index_id").limit(k)
            near = part if near is None else near.unionByName(part)
    return near.orderBy("score", "query_id", "index_id").limit(k)
