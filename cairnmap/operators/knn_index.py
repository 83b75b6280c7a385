"""A stored index for exact K-nearest-neighbour search that skips what cannot hold a neighbour.

``build`` cuts the vectors' space into leaves by medians (fitted on a bounded sample, which decides speed alone), deals all
rows to their leaves and stores them in pieces: rows of one leaf that lie close together, with the box around them.

``search`` bounds a query's answer by its k-th distance to some rows of the index; the query goes to the leaves whose boxes
reach within that bound, and meets their pieces in an equi-join on the leaf; a piece out of reach is not compared.  A block of
queries, and many components, take the stored sample for these rows.  More queries in few components take the rows around
them, PIECE or so of the leaf that a query itself falls into: a bound that gets closer as the index grows, which the
sample's does not.  Boxes and bounds hold for every Minkowski metric.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .knn import NARROW, Near, _best, _matrix

#: Rows of a piece, and of the sample that is fitted and stored; leaves at most (their boxes go to all tasks: 64 components
#: make 4 MB).
PIECE, SAMPLE, LEAVES = 2_048, 16_384, 4_096
#: Pieces of a leaf of many components, where nearly all leaves are in reach: queries travel to each, so leaves are fewer.
WIDE = 4
#: Rows that are cut into pieces together; queries of one row that travels; leaves that are ruled out by one box.
BUFFER, BLOCK, GROUP = 1 << 17, 4_096, 64


def lower_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: int) -> np.ndarray:
    """Least possible distance of each query (rows) to each box (columns)."""
    total = np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, j] - q[:, None, j], q[:, None, j] - hi[None, :, j]), 0)
        total += gap if p == 1 else gap**p
    return total if p == 1 else total ** (1 / p)


def halved(x: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in groups of ``most`` at most, by medians of the widest component."""
    todo, done = [rows], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        wide = int(np.argmax(x[part].max(0) - x[part].min(0)))
        order, mid = np.argsort(x[part, wide], kind="stable"), len(part) // 2
        todo += [part[order[:mid]], part[order[mid:]]]
    return done


@dataclass(frozen=True)
class Tree:
    """Inner nodes: component and threshold of each; children are nodes, or leaves as -1 - number."""

    component: np.ndarray
    threshold: np.ndarray
    child: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int) -> Tree:
        component, threshold, child, n = [], [], [], 0
        todo: list[tuple[np.ndarray, int, tuple[int, int] | None]] = [(np.arange(len(x)), leaves, None)]
        while todo:
            rows, want, above = todo.pop()
            spread = x[rows].max(0) - x[rows].min(0) if len(rows) else np.zeros(1)
            if want < 2 or len(rows) < 2 or not spread.max() > 0:
                node, n = -1 - n, n + 1
            else:
                node, wide = len(component), int(spread.argmax())
                values = np.sort(x[rows, wide])
                cut = values[len(values) // 2]
                cut = cut if cut > values[0] else values[values > values[0]][0]
                component.append(wide), threshold.append(cut), child.append([0, 0])
                left = x[rows, wide] < cut
                todo += [(rows[left], want // 2, (node, 0)), (rows[~left], want - want // 2, (node, 1))]
            if above:
                child[above[0]][above[1]] = node
        return cls(np.array(component, np.int64), np.array(threshold), np.array(child, np.int64).reshape(-1, 2))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.component) else np.full(len(x), -1)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            at[inner] = self.child[node, (x[inner, self.component[node]] >= self.threshold[node]).astype(int)]
        return -1 - at


@dataclass(frozen=True)
class Index:
    """A stored index: its folder, the columns it carries, its leaves in order (number, rows, box), its tree and its sample."""

    spark: SparkSession
    path: str
    carry: tuple[str, ...]
    tree: Tree
    leaf: np.ndarray
    rows: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    ids: np.ndarray
    sample: np.ndarray

    @property
    def pieces(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/pieces")

    def size(self) -> DataFrame:
        """(n_rows, n_pieces)."""
        return self.pieces.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_pieces"))


def _packer(carry: Sequence[str], schema: pa.Schema):
    """mapInArrow function: rows (leaf, index_id, vec, *carry), those of a leaf in a row -> pieces with their boxes."""

    def pieces(rows: pa.Table):
        x = _matrix(rows.column("vec").combine_chunks()).astype(np.float32)
        for part in halved(x, np.arange(len(x)), PIECE):
            some = rows.take(pa.array(part))
            one = [[rows.column("leaf")[0].as_py()], [len(part)], [x[part].min(0).tolist()], [x[part].max(0).tolist()], [some.column("index_id").to_pylist()], [x[part].tobytes()], *([some.column(c).to_pylist()] for c in carry)]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(one, schema)], schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            leaves = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if held and (held[0].column(0)[0] != batch.column(0)[a] or sum(h.num_rows for h in held) >= BUFFER):
                    yield from pieces(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from pieces(pa.Table.from_batches(held))

    return run


def build(index: DataFrame, path: str, index_id: str = "index_id", vec: str = "vec", dims: tuple[int, int] | None = None, carry: Sequence[str] = ()) -> Index:
    """Stores index rows (index_id, vec, *carry) under ``path`` and opens them.  ``dims`` = (start, length), 0-based, indexes a
    slice.  Vectors are stored in single precision, as floats or doubles of that precision come.  Rows without a vector
    are left out; vectors of different length are an error; an empty index is one without pieces.

    A leaf of many rows is dealt over several tasks; equal vectors, which no median parts, fill pieces like any others.
    """
    spark = index.sparkSession
    part = F.slice(vec, dims[0] + 1, dims[1]) if dims else F.col(vec)
    rows = index.where(F.col(vec).isNotNull()).select(F.col(index_id).cast("long").alias("index_id"), part.cast("array<float>").alias("vec"), *carry)
    n = rows.count()
    taken = rows.select("index_id", "vec").orderBy(F.xxhash64("index_id"), "index_id").limit(SAMPLE).toArrow()
    x = _matrix(taken.column("vec").combine_chunks()) if taken.num_rows else np.zeros((0, 1))
    most = PIECE * (WIDE if x.shape[1] > NARROW else 1)
    tree = Tree.fit(x, int(min(LEAVES, max(1, n // most), max(1, len(x) // 2))))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches):
        for b in batches:
            # In the order of the columns of ``rows``; _matrix refuses vectors of another length than the sample's.
            leaf = shared.value.leaf(_matrix(b.column(1), x.shape[1])) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *b.columns], names=["leaf", *b.schema.names])

    kinds = rows.schema
    dealt = rows.mapInArrow(assign, StructType([StructField("leaf", spark.createDataFrame([], "leaf int").schema[0].dataType), *kinds.fields]))
    tasks = max(1, n // BUFFER)
    sorted_ = dealt.withColumn("_o", F.xxhash64("index_id")).repartitionByRange(tasks, "leaf", "_o").sortWithinPartitions("leaf").drop("_o")
    lists = ", ".join(f"`{c}` array<{kinds[c].dataType.simpleString()}>" for c in carry)
    ddl = "leaf int, n int, lo array<float>, hi array<float>, ids array<long>, vecs binary" + (f", {lists}" if carry else "")
    stored = StructType.fromDDL(ddl)
    sorted_.mapInArrow(_packer(carry, to_arrow_schema(stored)), stored).write.mode("overwrite").parquet(f"{path}/pieces")
    taken = spark.createDataFrame(taken).withColumn("vec", F.col("vec").cast("array<float>")) if taken.num_rows else rows.select("index_id", "vec").limit(0)
    taken.coalesce(1).write.mode("overwrite").parquet(f"{path}/sample")
    nodes = pa.table({"node": np.arange(len(tree.component)), "component": tree.component, "threshold": tree.threshold, "below": tree.child[:, 0], "above": tree.child[:, 1]})
    spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")
    boxes = spark.read.parquet(f"{path}/pieces").select("leaf", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "b")).groupBy("leaf", "i").agg(F.sum("n").alias("n"), F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    boxes = boxes.groupBy("leaf").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("b")).select("leaf", "n", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
    boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/leaves")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index.  What is read here is bounded: LEAVES boxes, as many nodes, and SAMPLE vectors."""
    leaves, nodes, sample = (spark.read.parquet(f"{path}/{name}").toArrow() for name in ("leaves", "tree", "sample"))
    leaves, nodes = leaves.sort_by("leaf"), nodes.sort_by("node")
    tree = Tree(nodes.column("component").to_numpy(), nodes.column("threshold").to_numpy(), np.stack([nodes.column(c).to_numpy() for c in ("below", "above")], 1))
    carry = tuple(c for c in spark.read.parquet(f"{path}/pieces").columns if c not in ("leaf", "n", "lo", "hi", "ids", "vecs"))
    boxes = [_matrix(leaves.column(c).combine_chunks()) if leaves.num_rows else np.zeros((0, 1)) for c in ("lo", "hi")]
    vectors = _matrix(sample.column("vec").combine_chunks()) if sample.num_rows else np.zeros((0, 1))
    return Index(spark, path, carry, tree, leaves.column("leaf").to_numpy(), leaves.column("n").to_numpy(), *boxes, sample.column("index_id").to_numpy(), vectors)


def _parts(ids: np.ndarray, rows: np.ndarray, p: int) -> list[tuple[np.ndarray, Near]]:
    return [(ids[b : b + 1024], Near(rows[b : b + 1024], p)) for b in range(0, len(rows), 1024)]


def _kth(parts: list[tuple[np.ndarray, Near]], own: np.ndarray, q: np.ndarray, k: int, skip_same_id: bool) -> np.ndarray:
    """The k-th distance of each query to the rows of ``parts``, infinite for fewer rows."""
    bound = np.full(len(q), np.inf)
    for a in range(0, len(q), 64):
        best = np.full((len(q[a : a + 64]), k), np.inf)
        for ids, part in parts:
            far = part.nearest(q[a : a + 64], k, own[a : a + 64] if skip_same_id else None, ids)
            best = np.sort(np.concatenate([best, far], axis=1), axis=1)[:, :k]
        bound[a : a + 64] = best[:, -1]
    return bound


def _blocks(own: np.ndarray, q: np.ndarray, bound: np.ndarray, leaf: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: int):
    """Blocks of queries for each leaf in reach, each query with its bound.  Leaves with numbers in a row lie close together,
    so a box around GROUP of them comes first."""
    # Sums of rounded numbers: a hair is added, so that equality on paper is reach.
    bound = bound + 1e-9 * np.maximum(1, bound)
    for g in range(0, len(leaf), GROUP):
        low, high = lo[g : g + GROUP], hi[g : g + GROUP]
        some = np.flatnonzero(lower_bounds(q, low.min(0)[None], high.max(0)[None], p)[:, 0] <= bound)
        reach = np.concatenate([lower_bounds(q[x], low, high, p) <= bound[x, None] for x in np.split(some, range(256, len(some), 256))])
        for j in np.flatnonzero(reach.any(0)).tolist():
            rows = some[reach[:, j]]
            yield pa.RecordBatch.from_arrays([pa.array([leaf[g + j]], pa.int32()), pa.array([own[rows].tolist()], pa.list_(pa.int64())), pa.array([q[rows].tobytes()], pa.binary()), pa.array([bound[rows].tolist()], pa.list_(pa.float64()))], names=["leaf", "query_ids", "queries", "bounds"])


def _router(shared, k: int, p: int, skip_same_id: bool):
    """mapInArrow function: (query_id, vec) -> blocks of queries for each leaf in reach, bounded by the sample."""

    def run(batches):
        leaf, lo, hi, ids, sample = shared.value
        parts = _parts(ids, sample, p)
        for whole in batches if len(leaf) else ():
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                own, q = batch.column(0).to_numpy(), _matrix(batch.column(1), lo.shape[1])
                yield from _blocks(own, q, _kth(parts, own, q, k, skip_same_id), leaf, lo, hi, p)

    return run


#: Rows around queries, and queries: the leaf they fall into, ids, vectors (in single and in double precision), which it is.
_AROUND = "leaf int, ids array<long>, vecs binary, asks boolean"


def _around(leaf: np.ndarray, ids: list, vecs: list, asks: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(vecs, pa.binary()), pa.array([asks] * len(ids), pa.bool_())], names=["leaf", "ids", "vecs", "asks"])


def _thinner(shared):
    """mapInArrow function: (leaf, ids, vecs) of pieces -> PIECE or so rows of each leaf, evenly from its pieces."""

    def run(batches):
        step = dict(zip(*shared.value))
        for batch in batches:
            for i in range(batch.num_rows):
                own, n = batch.column(1)[i].values.to_numpy(), step[batch.column(0)[i].as_py()]
                s = np.frombuffer(batch.column(2)[i].as_buffer(), np.float32).reshape(len(own), -1)
                yield _around(batch.column(0)[i : i + 1].to_numpy(), [own[::n].tolist()], [s[::n].tobytes()], False)

    return run


def _homes(shared, dim: int):
    """mapInArrow function: (query_id, vec) -> the query in the leaf that it falls into."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column(1), dim)
                yield _around(shared.value.leaf(q), [[x] for x in batch.column(0).to_pylist()], [x.tobytes() for x in q], True)

    return run


def _near_router(shared, k: int, p: int, skip_same_id: bool):
    """mapInArrow function: rows of _AROUND, by leaf, those of the index first -> blocks as those of _router, bounded by the
    rows of the query's leaf.  Queries of a leaf that a task before began with, and of a leaf of under k rows, are bounded by
    the sample."""

    def run(batches):
        leaf, lo, hi, ids, sample = shared.value
        parts, here, around, seen, held = _parts(ids, sample, p), None, [], [], []
        for batch in batches:
            at, asks = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if at[a] != here:
                    here, around, seen = at[a], [], []
                own = batch.column(1).slice(a, b - a).flatten().to_numpy()
                x = np.frombuffer(b"".join(batch.column(2).slice(a, b - a).to_pylist()), np.float64 if asks[a] else np.float32).reshape(len(own), -1)
                if not asks[a]:
                    seen.append((own, x.astype(np.float64)))
                    continue
                if seen:
                    around, seen = _parts(*(np.concatenate(v) for v in zip(*seen)), p), []
                bound = _kth(around, own, x, k, skip_same_id)
                open_ = np.isinf(bound)
                bound[open_] = _kth(parts, own[open_], x[open_], k, skip_same_id)
                held.append((own, x, bound))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    yield from _blocks(*(np.concatenate(v) for v in zip(*held)), leaf, lo, hi, p)
                    held = []
        if held:
            yield from _blocks(*(np.concatenate(v) for v in zip(*held)), leaf, lo, hi, p)

    return run


def _comparer(k: int, p: int, skip_same_id: bool, n_carry: int, names: list[str]):
    """mapInArrow function: (piece, block of queries) -> candidates: of each query the k best of the piece within its bound."""

    def run(batches):
        tight: dict[int, float] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i]  # noqa: E731, B023
                asked, bound = cell(5).values.to_numpy(), cell(7).values.to_numpy().copy()
                q = np.frombuffer(cell(6).as_buffer(), np.float64).reshape(len(asked), -1)
                lo, hi = (cell(c).values.to_numpy(zero_copy_only=False).astype(np.float64)[None] for c in (1, 2))
                bound = np.minimum(bound, [tight.get(x, np.inf) for x in asked.tolist()])
                near = np.flatnonzero(lower_bounds(q, lo, hi, p)[:, 0] <= bound)
                if not len(near):
                    continue
                own = cell(3).values.to_numpy()
                s = np.frombuffer(cell(4).as_buffer(), np.float32).reshape(len(own), -1).astype(np.float64)
                found, piece = [], Near(s, p)
                for a in range(0, len(near), 64):
                    rows = near[a : a + 64]
                    r, c, d = piece.within(q[rows], bound[rows], k + skip_same_id)
                    some = (asked[rows[r]] != own[c]) | (not skip_same_id)
                    r, c, d = r[some], c[some], d[some]
                    found.append(_best([(rows[r], d, own[c], [pa.array(c)])], k))
                at, far, ids, picked = _best(found, k)
                full = np.flatnonzero(np.bincount(at, minlength=len(asked)) == k)
                for x, b in zip(asked[full].tolist(), far[np.searchsorted(at, full, "right") - 1].tolist()):
                    tight[x] = min(b, tight.get(x, np.inf))
                if len(tight) > 1 << 20:  # bounds only save work
                    tight = {}
                carried = [cell(8 + n).values.take(picked[0]) for n in range(n_carry)]
                yield pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(ids), *carried, pa.array(far)], names=names)

    return run


def routed(queries: DataFrame, index: Index, k: int, p: int = 1, query_id: str = "query_id", vec: str = "vec", dims: tuple[int, int] | None = None, skip_same_id: bool = False) -> DataFrame:
    """(leaf, query_ids, queries, bounds): the queries, packed, for each leaf that can hold a neighbour."""
    part = F.slice(vec, dims[0] + 1, dims[1]) if dims else F.col(vec)
    asked = queries.where(F.col(vec).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), part.alias("vec"))
    shared = index.spark.sparkContext.broadcast((index.leaf, index.lo, index.hi, index.ids, index.sample))
    # A piece travels once for each block of its leaf, so blocks are filled.
    tasks = 1 + asked.count() // BLOCK
    blocks = "leaf int, query_ids array<long>, queries binary, bounds array<double>"
    if tasks > 1 and len(index.leaf) and index.lo.shape[1] <= NARROW:
        # Queries of one part of the space come together, with rows of the index around them; so blocks are few, too.
        tree, step = (index.spark.sparkContext.broadcast(x) for x in (index.tree, (index.leaf.tolist(), (-(-index.rows // PIECE)).tolist())))
        rows = index.pieces.select("leaf", "ids", "vecs").mapInArrow(_thinner(step), _AROUND)
        both = rows.unionByName(asked.mapInArrow(_homes(tree, index.lo.shape[1]), _AROUND)).withColumn("_o", F.xxhash64("ids"))
        both = both.repartitionByRange(tasks, "leaf", "asks", "_o").sortWithinPartitions("leaf", "asks").drop("_o")
        return both.mapInArrow(_near_router(shared, k, p, skip_same_id), blocks)
    asked = asked.coalesce(1) if tasks == 1 else asked.repartition(tasks)
    return asked.mapInArrow(_router(shared, k, p, skip_same_id), blocks)


def search(queries: DataFrame, index: Index, k: int, p: int = 1, query_id: str = "query_id", vec: str = "vec", dims: tuple[int, int] | None = None, skip_same_id: bool = False) -> DataFrame:
    """(query_id, index_id, *carry, distance, rank): the rows of knn_join over the indexed rows, in one scan of the pieces in
    reach, for any number of queries: they move to the leaves by a shuffle, nothing is collected."""
    if k < 1 or p < 1:
        raise ValueError("k and p must be positive")
    blocks = routed(queries, index, k, p, query_id, vec, dims, skip_same_id)
    # Neither side is ever gathered in the driver to be broadcast.
    both = index.pieces.drop("n").join(blocks.hint("merge"), "leaf")
    both = both.select("leaf", "lo", "hi", "ids", "vecs", "query_ids", "queries", "bounds", *index.carry)
    types = {f.name: f.dataType.elementType for f in index.pieces.schema if f.name in index.carry}
    schema = StructType([StructField("query_id", LongType()), StructField("index_id", LongType()), *(StructField(c, types[c]) for c in index.carry), StructField("distance", DoubleType())])
    found = both.mapInArrow(_comparer(k, p, skip_same_id, len(index.carry), schema.names), schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "index_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "index_id", *index.carry, "distance", "rank")


def visits(queries: DataFrame, index: Index, k: int, p: int = 1, **more) -> DataFrame:
    """(visited, all): pairs of a query and a piece of a leaf in its reach, and all such pairs."""
    blocks = routed(queries, index, k, p, **more).groupBy("leaf").agg(F.sum(F.size("query_ids")).alias("q"))
    per_leaf = index.pieces.groupBy("leaf").agg(F.count("*").alias("n"))
    seen = per_leaf.join(blocks, "leaf", "left").agg(F.coalesce(F.sum(F.col("n") * F.col("q")), F.lit(0)).alias("visited"), F.sum("n").alias("pieces"))
    asked = queries.where(F.col(more.get("vec", "vec")).isNotNull()).agg(F.count("*").alias("asked"))
    return seen.crossJoin(asked).select("visited", (F.coalesce("pieces", F.lit(0)) * F.col("asked")).alias("all"))
