"""Near-duplicate documents: MinHash with tensored banding, then exact verification.

Tensored banding (Andoni-Indyk; Christiani 2019): instead of computing ``tables * r`` minhashes, compute two small
collections of ``m`` half keys (``m * r/2`` minhashes each); table (i, j) is keyed by half key i of the first collection
joined with half key j of the second, so ``m * r`` minhashes serve ``m * m`` tables.  A pair of similarity s meets in
some table with probability ``(1 - (1 - s^(r/2))^m)^2``: 0.9998 at s = 0.8 with the defaults (m = 9, r = 4).

Links are confirmed on full shingle sets.  Within a bucket no all-pairs join takes place: texts with equal sets are one
node, nodes are first compared with one hub each and what that connects is merged.  Nodes of buckets that still hold several
components are then compared where a prefix filter, which loses no link, allows similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .work import Work, table

HALVES, HALF_ROWS = 9, 2
BITS = 1024
#: Bytes of text whose signatures and packed texts make one bucket, about; pairs with one hub that a task verifies, about.
BUCKET, SHARE = 32 << 20, 4096


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signatures(k: int, halves: int, half_rows: int):
    """mapInArrow function: (doc_id, text) -> size and 128-bit fingerprint of the shingle set, half keys, packed text."""

    def run(batches):
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        mul, add = _coefficients(2 * halves * half_rows)
        for whole in batches:
            for lo, hi in tokens.slices(tokens.byte_lengths(whole.column(1)), 4 << 20):
                batch = whole.slice(lo, hi - lo)
                sets = tokens.shingle_sets(*tokens.word_hashes(batch.column(1), 0), k)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                full = sizes > 0
                fp = [np.zeros(len(sets), np.uint64) for _ in range(2)]
                keys = np.zeros((2 * halves, len(sets)), np.uint64)
                if full.any():
                    first = at[full]
                    flat[-1] = 0
                    body = flat[:-1]
                    for j, salt in enumerate((0x5BD1E995, 0xC2B2AE3D27D4EB4F)):
                        fp[j][full] = np.add.reduceat(tokens.mix(body ^ np.uint64(salt)), first)
                    for half in range(2 * halves):
                        key = np.full(len(first), half + 1, np.uint64)
                        for i in range(half * half_rows, (half + 1) * half_rows):
                            value = body * mul[i] + add[i]
                            value ^= value >> np.uint64(32)
                            key = tokens.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, first))
                        keys[half][full] = key
                signed = keys.T.copy().view(np.int64)
                lists = lambda block: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(block).ravel()), halves).cast(pa.list_(pa.int64()))
                data, offs = tokens.buffer_of(batch.column(1))
                blobs = [zip_.compress(data[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), lists(signed[:, :halves]), lists(signed[:, halves:]), pa.array(blobs, pa.binary())],
                    names=["doc_id", "n", "lo", "hi", "a", "b", "blob"],
                )

    return run, "doc_id long, n long, lo long, hi long, a array<long>, b array<long>, blob binary"


def exploder(k: int):
    """mapInArrow function: (id, c, blob) -> the shingle set of each text, and which of BITS cells its shingles hit."""

    def run(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, comps, blobs = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                found = tokens.shingle_sets(*tokens.word_hashes(pa.array([unzip.decompress(blobs[i].as_buffer())], pa.binary()).cast(pa.string())), k)[0]
                cells = np.zeros(BITS, bool)
                cells[(found % np.uint64(BITS)).astype(np.int64)] = True
                bits = np.packbits(cells).view(np.int64)
                yield pa.RecordBatch.from_pydict({"id": ids.slice(i, 1), "c": comps.slice(i, 1), "n": pa.array([len(found)], pa.int32()), "bits": pa.array([bits], pa.list_(pa.int64())), "gs": pa.array([found.view(np.int64)], pa.list_(pa.int64()))})

    return run


def verifier(k: int, percent: int):
    """mapInArrow function: (a, b, blob_a, blob_b) -> the pairs whose full shingle sets are similar enough."""

    def run(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()

        def shingles(blob: bytes) -> np.ndarray:
            text = pa.array([unzip.decompress(blob)], pa.binary()).cast(pa.string())
            return tokens.shingle_sets(*tokens.word_hashes(text), k)[0]

        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep, known = [], (None, None)
            for i in range(batch.num_rows):
                hub = right[i].as_buffer().to_pybytes()
                if known[0] != hub:
                    known = (hub, shingles(hub))
                mine, other = shingles(left[i].as_buffer().to_pybytes()), known[1]
                if 100 * min(len(mine), len(other)) < percent * max(len(mine), len(other)):
                    continue
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both and 100 * both >= percent * (len(mine) + len(other) - both):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, work: Work, k: int = 5, percent: int = 80, halves: int = HALVES, half_rows: int = HALF_ROWS) -> DataFrame:
    """(doc_id long, text) -> doc_id, n_shingles, component_id, kept; one row per input row.

    Empty, blank and null texts have no shingles and no link.  A row without doc_id takes part in no link: its component_id
    is null and it is kept.  Rows that repeat a doc_id count as one document.  Rows with equal texts get equal results.  A
    very long text is compared whole; memory follows its number of words.  An empty table gives an empty result.  Columns
    other than doc_id and text are not read.

    Packed texts are dealt into buckets by doc_id once; whatever number of them is asked for later, only the ids move.
    """
    run, schema = signatures(k, halves, half_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = 8 + (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET
    sig = work.bucketed(own.where("doc_id is not null").mapInArrow(run, schema), "sig", "doc_id", buckets)
    linked = sig.where("n > 0")
    nodes = work.save(linked.groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("id"), F.first("a").alias("a"), F.first("b").alias("b")).repartition(buckets, "id"), "nodes")
    keys = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(x, y, i * halves + j))))
    rows = nodes.select("id", F.col("n").cast("int").alias("n"), F.explode(keys).alias("key"))
    hubs = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("h"), F.max("id").alias("top")).where("h.id <> top").select("key", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n"))
    active = work.save(rows.join(hubs, "key"), "active", split=8 << 20)
    fits = f"100L * least({{0}}, {{1}}) >= {percent}L * greatest({{0}}, {{1}})".format
    stars = active.where("id <> hub").where(fits("n", "hub_n")).groupBy("id", "hub").agg(F.count("*").alias("votes"))
    best = work.save(stars.groupBy("id").agg(F.max_by("hub", F.struct("votes", -F.col("hub"))).alias("hub")).select(F.col("id").alias("a"), F.col("hub").alias("b")), "best")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(doc_id, blob) of the ids: they are dealt like the buckets and meet them, in memory that the ids of a bucket bound."""
        dealt = ids.select(F.col("id").alias("doc_id")).repartition(buckets, "doc_id").distinct()
        return linked.select("doc_id", "blob").join(dealt.hint("shuffle_hash"), "doc_id", "left_semi")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar.  Pairs with one hub are dealt over several tasks, each with a copy of the hub."""
        shares = pairs.groupBy("b").agg((F.floor(F.count("*") / SHARE) + 1).cast("int").alias("shares"))
        dealt = pairs.join(shares.hint("merge"), "b").select("a", "b", F.pmod(F.xxhash64("a"), "shares").cast("int").alias("share"))
        with_a = dealt.hint("merge").join(texts_of(pairs.select(F.col("a").alias("id"))).select(F.col("doc_id").alias("a"), F.col("blob").alias("blob_a")), "a")
        hub = shares.hint("merge").join(texts_of(pairs.select(F.col("b").alias("id"))).select(F.col("doc_id").alias("b"), F.col("blob").alias("blob_b")), "b")
        hub = hub.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("b", "share", "blob_b")
        return with_a.join(hub.hint("merge"), ["b", "share"]).select("a", "b", "blob_a", "blob_b").mapInArrow(verifier(k, percent), "a long, b long")

    edges = work.save(confirmed(best), "edges-1")
    labels = components(edges, work, "c1")

    def labelled(df: DataFrame, column: str, to: str) -> DataFrame:
        return df.join(labels.select(F.col("id").alias(column), F.col("component").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))

    # Nodes of buckets that still hold several components.  Of these, two sets of the wanted similarity share a shingle
    # among the rarest n - ceil(n * percent / 100) + 1 of each (prefix filter), so no link is lost and no bucket is squared.
    open_ = labelled(active.select("key", "id", "n"), "id", "c")
    mixed = open_.groupBy("key").agg(F.min("c").alias("u"), F.max("c").alias("v")).where("u <> v").select("key")
    open_ = work.save(open_.join(mixed, "key").select("id", "c").distinct(), "open")
    sets = work.save(open_.hint("merge").join(texts_of(open_).withColumnRenamed("doc_id", "id"), "id").select("id", "c", "blob").mapInArrow(exploder(k), "id long, c long, n int, bits array<long>, gs array<long>"), "sets")
    each = sets.select("id", "c", "n", F.explode("gs").alias("g"))
    shared = each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles of one node only come first in the order, so the place r of the others follows from their number.
    by_rarity = Window.partitionBy("id", "n").orderBy("df", "g")
    ranked = each.join(shared, "g").withColumns({"r": F.row_number().over(by_rarity), "m": F.count("*").over(Window.partitionBy("id", "n"))}).withColumn("r", F.expr("n - m + r"))
    prefix = ranked.where(f"r <= n - ceil(n * {percent} / 100) + 1").select("g", "id", "c", "n", "r")
    prefix = work.save(prefix.join(sets.select("id", "n", "bits"), ["id", "n"]), "prefix")
    # What two sets share is bounded by what follows their first common shingle, and by the cells that only one of them hits.
    need = f"{percent} * (x.n + y.n) <= {100 + percent} * "
    missed = "aggregate(zip_with({}.bits, {}.bits, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v)".format
    bound = f"{need} (least(x.n - x.r, y.n - y.r) + 1) and {need} least(x.n - {missed('x', 'y')}, y.n - {missed('y', 'x')})"
    third = prefix.alias("x").join(prefix.alias("y"), F.expr(f"x.g = y.g and x.id > y.id and x.c <> y.c and {fits('x.n', 'y.n')} and {bound}")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    third = work.save(third.join(best, ["a", "b"], "left_anti"), "pairs-2")
    found = work.save(confirmed(third), "edges-2")
    if found.take(1):
        labels = components(edges.unionByName(found), work, "c2")

    work.drop("active", "best", "edges-1", "edges-2", "open", "sets", "prefix", "pairs-2")
    out = sig.select("doc_id", "n", "lo", "hi").join(nodes.select("lo", "hi", "n", "id"), ["lo", "hi", "n"], "left")
    out = labelled(out.withColumn("id", F.coalesce("id", "doc_id")), "id", "component_id").select("doc_id", "n", "component_id")
    without_id = own.where("doc_id is null").mapInArrow(run, schema).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return work.only(out.unionByName(without_id).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "classes")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of two-word shingles and its class at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), Work(spark, "near-dup"), k=2)


WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""
ORACLE = {
    "op6_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
r AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS f, s FROM s),
nodes AS (SELECT f, n, min(doc_id) AS id, any_value(s) AS s FROM r WHERE n > 0 GROUP BY f, n),
e AS (SELECT id, n, unnest(s) AS g FROM nodes),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.id WHERE reach.c < l.b),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT r.doc_id, CAST(r.n AS BIGINT) AS n_shingles, coalesce(comp.c, r.doc_id) AS component_id, r.doc_id = coalesce(comp.c, r.doc_id) AS kept
FROM r LEFT JOIN nodes ON r.f = nodes.f AND r.n = nodes.n AND r.n > 0 LEFT JOIN comp ON comp.id = nodes.id""",
}
QUERIES = {"op6_minhash_near_dedup": op6_minhash_near_dedup}
