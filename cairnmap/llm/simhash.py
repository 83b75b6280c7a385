"""SimHash near-duplicates: meet-in-the-middle ball hashing of 64-bit fingerprints.

Two fingerprints at a distance of at most ``radius`` bits have a word in the middle, at most half the radius from either.
So each distinct fingerprint emits all its variants within half the radius, variants are shuffled, and those that two
fingerprints emit link them.  2,081 variants of 8 bytes a fingerprint would move several times the text, so variants move
in bundles: a fingerprint goes once to each value that the first ``PREFIX`` bits of its variants take (79 of them for radius
4), and the task of that value writes out the variants with it.  Nothing is left out: the bundles hold each variant once.

All fingerprints that emit one variant are linked with each other, so a star joins them; a task returns the components of
its stars, a row for each fingerprint at most, and never a pair of each two members of a family.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .work import Work, table

K, RADIUS, SEED = 4, 4, 42
#: Bits of the first deal; a value with more than about SHARE fingerprints is dealt by further bits, at most DEEPEST.
PREFIX, SHARE, DEEPEST = 12, 1 << 17, 24
#: Variants that a task holds at a time, about; more are worked by further bits, one value after the other.
VARIANTS = 4 << 20


def fingerprint(text: bytes, k: int = K, seed: int = SEED) -> int:
    """SimHash of a text: a bit is 1 if it is in over half the XXH64 hashes of its k-word shingles, repeats included."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and parts at \x20 and \x09-\x0D
    if not words:
        return 0
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(starts), 1 << 15):
        hashes = np.array([hash_(joined[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 15)], ends[lo : lo + (1 << 15)])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(k: int, seed: int):
    """mapInArrow function: (doc_id, text) -> doc_id and the fingerprint's bits as a long."""

    def run(batches):
        for batch in batches:
            data, offsets = tokens.buffer_of(batch.column(1))
            prints = np.array([fingerprint(data[a:b].tobytes(), k, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


@functools.cache
def masks(bits: int, weight: int) -> np.ndarray:
    """All words of ``bits`` bits of which ``weight`` are set."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(bits), weight)], np.uint64)


def stars(prints: np.ndarray, used: np.ndarray, low: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place) among fingerprints that agree in all but ``low`` bits up to ``used`` flips: for each variant of
    several fingerprints, one within half the radius (rounded down) with all the others, each pair verified."""
    half, most = radius - radius // 2, radius // 2
    at = [np.flatnonzero(used == u) for u in range(half + 1)]
    n_masks = [len(m) for m in (masks(low, w) for w in range(half + 1))]
    if sum(len(rows) * sum(n_masks[: half - u + 1]) for u, rows in enumerate(at)) > VARIANTS and low:
        step, found = min(low, 4), []
        here = (prints >> np.uint64(low - step)) & np.uint64((1 << step) - 1)
        for value in range(1 << step):
            now = used + np.bitwise_count(here ^ np.uint64(value))
            rows = np.flatnonzero(now <= half)
            a, b = stars(prints[rows], now[rows], low - step, radius)
            found.append((rows[a], rows[b]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    kept = prints & np.uint64((1 << low) - 1)
    blocks = [(rows, w, u + w) for u, rows in enumerate(at) for w in range(half - u + 1) if len(rows) and n_masks[w]]
    variants = [(kept[rows][:, None] ^ masks(low, w)[None, :]).ravel() for rows, w, _ in blocks]
    none = np.zeros(0, np.int64)
    if not variants:
        return none, none
    ordered = np.sort(np.concatenate(variants))
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(shared):
        return none, none
    # A bitmap sets most of the variants aside, a search among the shared ones settles the rest.
    size = max(12, int(8 * len(shared)).bit_length())
    place = lambda v: ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)).astype(np.int64)
    bitmap = np.zeros(1 << size, bool)
    bitmap[place(shared)] = True
    which, who, weight = [], [], []
    for (rows, w, total), values in zip(blocks, variants):
        maybe = np.flatnonzero(bitmap[place(values)])
        found = np.minimum(np.searchsorted(shared, values[maybe]), len(shared) - 1)
        real = shared[found] == values[maybe]
        which.append(found[real])
        who.append(rows[maybe[real] // n_masks[w]])
        weight.append(np.full(int(real.sum()), total))
    which, who, weight = (np.concatenate(x) for x in (which, who, weight))
    order = np.lexsort((who, weight > most, which))
    which, who, weight = which[order], who[order], weight[order]
    first = np.searchsorted(which, which)
    hub, spoke = who[first], who
    real = (weight[first] <= most) & (hub != spoke) & (np.bitwise_count(prints[hub] ^ prints[spoke]) <= radius)
    pairs = np.unique(hub[real] * len(prints) + spoke[real])
    return pairs // len(prints), pairs % len(prints)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first member of each of n places' component under the links (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def meeting(radius: int):
    """applyInArrow function: the fingerprints of one bundle (bits, print, used, id) -> links (a, b) that join them."""

    def run(group: pa.Table) -> pa.Table:
        bits, prints, used, ids = (group.column(c).to_numpy() for c in ("bits", "print", "used", "id"))
        a, b = stars(prints.view(np.uint64), used.astype(np.int64), 64 - int(bits[0]), radius)
        label = joined(len(ids), a, b)
        rest = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[rest], "b": ids[label[rest]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def linked(nodes: DataFrame, radius: int = RADIUS, prefix: int = PREFIX, share: int = SHARE) -> DataFrame:
    """(print long, distinct; id long) -> links (a, b) of ids whose components are those of all pairs of fingerprints that
    differ in ``radius`` bits at most."""
    spark, half = nodes.sparkSession, radius - radius // 2
    flips = [int(m) for w in range(half + 1) for m in masks(prefix, w)]
    head = F.shiftrightunsigned("print", 64 - prefix).cast("int")
    spread = F.explode(F.array(*(F.lit(m) for m in flips)).cast("array<int>")).alias("flip")
    own = nodes.groupBy(head.alias("head")).agg(F.count("*").alias("n"))
    # At most 2^PREFIX rows: how many bits more a value is dealt by, so that neither growth nor a family fills one task.
    full = own.select("head", "n", spread).groupBy(F.col("head").bitwiseXOR(F.col("flip")).alias("bucket")).agg(F.sum("n").alias("n"))
    deeper = full.where(F.col("n") > share).select("bucket", F.least(F.ceil(F.log2(F.col("n") / share)), F.lit(min(DEEPEST, 63 - prefix))).cast("int").alias("deep"))
    further = [(d, int(m), w) for d in range(min(DEEPEST, 63 - prefix) + 1) for w in range(half + 1) for m in masks(d, w)]
    further = spark.createDataFrame(further, "deep int, more long, flips int")
    rows = nodes.select("print", "id", head.alias("head"), spread).select("print", "id", F.col("head").bitwiseXOR(F.col("flip")).alias("bucket"), F.bit_count("flip").cast("int").alias("used"))
    rows = rows.join(F.broadcast(deeper), "bucket", "left").withColumn("deep", F.coalesce("deep", F.lit(0)))
    rows = rows.join(F.broadcast(further), "deep").where(F.col("used") + F.col("flips") <= half)
    after = F.expr(f"shiftrightunsigned(shiftleft(print, {prefix}), 1) >> (63 - deep)")
    rows = rows.select("bucket", after.bitwiseXOR(F.col("more")).alias("sub"), "print", "id", (F.col("used") + F.col("flips")).cast("byte").alias("used"), (F.col("deep") + prefix).cast("byte").alias("bits"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    return rows.repartition(tasks, "bucket", "sub").groupBy("bucket", "sub").applyInArrow(meeting(radius), "a long, b long")


def simhash_classes(docs: DataFrame, work: Work, k: int = K, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id long, text) -> doc_id, fingerprint (16 hexadecimal digits), component_id, kept; one row per input row.

    Rows whose fingerprints differ in ``radius`` bits at most are linked; component_id is the smallest doc_id reachable.
    Texts of fewer than k words are one shingle; null, empty and blank texts have fingerprint zero and are linked like any
    other.  Rows that repeat a doc_id are one document: what either text is linked with is linked.  A row without doc_id
    takes part in no link: its component_id is null and it is kept.  A very long text is hashed whole; memory follows its
    length.  An empty table gives an empty result.  Columns other than doc_id and text are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = work.save(own.mapInArrow(fingerprints(k, seed), "doc_id long, print long"), "rows")
    known = rows.where("doc_id is not null")
    nodes = work.save(known.groupBy("print").agg(F.min("doc_id").alias("id")), "nodes")
    several = known.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("doc_id")
    same = known.join(several.hint("merge"), "doc_id").join(nodes.hint("merge"), "print").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    links = work.save(linked(nodes, radius).unionByName(same), "links")
    labels = components(links, work, "c")
    classes = nodes.join(labels.hint("merge"), "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    out = rows.join(classes.hint("merge"), "print", "left").withColumn("component_id", F.expr("if(doc_id is null, null, component_id)"))
    return work.only(out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "classes")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint of four-word shingles and its class at four bits or fewer."""
    return simhash_classes(table(spark, sf_dir, "documents"), Work(spark, "simhash"))


#: XXH64 is not among DuckDB's functions; tests/llm/test_simhash.py compares with all pairs.
ORACLE: dict[str, str] = {}
QUERIES = {"op11_simhash_near_dedup": op11_simhash_near_dedup}
