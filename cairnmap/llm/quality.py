"""Quality: random-indexing word vectors (Kanerva et al., 2000) pooled per document, then a two-layer network with a
temperature that calibrates its probabilities.

A word's vector is the sum of the sparse ternary index vectors of its neighbours, over all documents, labelled or not.
Words share a hashed table of 2^WORD_BITS rows; a second, small part of the table holds word shapes (capitals, digits,
marks, length, repeat of the word before), so that unseen words still say how a text looks.  The table is fixed in size
(8 MB) and broadcast.  A document's vector is the mean of its words' and of its shapes' vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .lm import pack, unpack
from .toxicity import sample_of
from .work import crc_fold, table

WORD_BITS, DIM, SHAPES = 16, 32, 4 * 3 * 4 * 2 * 4
ROWS = (1 << WORD_BITS) + SHAPES
MAX_FIT = 12_000
#: Tables of word-vector sums that one task adds up.
FAN = 8
_KIND = np.zeros((3, 256), np.int64)
_KIND[0, 65:91] = 1
_KIND[1, 48:58] = 1
_KIND[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table row of each word, table row of its shape, offsets of the texts)."""
    h, words = tokens.word_hashes(texts)
    data, offsets = tokens.buffer_of(texts)
    parts = [np.zeros((0, 4), np.int64)]
    for _, b, start, end in tokens.word_spans(data, offsets):
        counts = [end - start]
        for kind in _KIND:
            sums = np.zeros(len(b) + 1, np.int64)
            np.cumsum(kind[b], out=sums[1:])
            counts.append(sums[end] - sums[start])
        parts.append(np.stack(counts, 1))
    size, upper, digits, marks = np.concatenate(parts).T
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again[words[:-1][words[:-1] < len(h)]] = 0
    length = np.searchsorted([3, 7, 14], size)
    shape = (((np.minimum(upper, 3) * 3 + np.minimum(digits, 2)) * 4 + np.minimum(marks, 3)) * 2 + again) * 4 + length
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), shape + (1 << WORD_BITS), words


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors: four entries of +-1 in each row."""
    rng = np.random.default_rng(7)
    table_ = np.zeros((ROWS, DIM), np.float32)
    at = rng.integers(0, DIM, (ROWS, 4))
    np.add.at(table_, (np.repeat(np.arange(ROWS), 4), at.ravel()), rng.choice(np.array([-1, 1], np.float32), ROWS * 4))
    return table_


def _accumulate(batches):
    """One task's partial sums over its texts, as pieces of the table."""
    index, total = index_vectors(), np.zeros((ROWS, DIM), np.float64)
    for whole in batches:
        for lo, hi in tokens.slices(tokens.byte_lengths(whole.column(0)), 1 << 20):
            rows, shapes, words = word_rows(whole.column(0).slice(lo, hi - lo))
            # Pieces of fixed length bound the memory of a very long text; two words more on each side are read.
            for at in range(0, len(rows), 1 << 18):
                a, upto, b = max(0, at - 2), min(len(rows), at + (1 << 18)), min(len(rows), at + (1 << 18) + 2)
                own, doc = index[rows[a:b]] + index[shapes[a:b]], np.searchsorted(words, np.arange(a, b), "right")
                near = np.zeros_like(own)
                for gap in (1, 2):
                    same = (doc[gap:] == doc[:-gap])[:, None]
                    near[gap:] += own[:-gap] * same
                    near[:-gap] += own[gap:] * same
                near = near[at - a : upto - a]
                for target in (rows[at:upto], shapes[at:upto]):
                    order = np.argsort(target, kind="stable")
                    found, first = np.unique(target[order], return_index=True)
                    total[found] += np.add.reduceat(near[order], first)
    for c in range(0, ROWS, 4096):
        if total[c : c + 4096].any():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([pack(total[c : c + 4096].astype(np.int64).ravel())])], names=["c", "v"])


def _summed(group: pa.Table) -> pa.Table:
    """The sum of some tasks' tables of one piece."""
    total = sum(unpack(v, np.int64) for v in group.column("v").to_pylist())
    return group.select(["c", "from"]).slice(0, 1).append_column("v", pa.array([pack(total)], pa.binary()))


def word_sums(docs: DataFrame) -> DataFrame:
    """(c, v): pieces of the sums over all documents.  Tables of tasks are added up in a tree: at every step each sum has
    FAN tables at most, so no task gathers what all tasks send."""
    sums = docs.select("text").mapInArrow(_accumulate, "c long, v binary")
    left = sums.rdd.getNumPartitions()
    sums = sums.withColumn("from", F.spark_partition_id())
    while left > 1:
        left = -(-left // FAN)
        sums = sums.withColumn("from", F.floor(F.col("from") / FAN).cast("int"))
        sums = sums.repartition(-(-ROWS // 4096) * left, "c", "from").groupBy("c", "from").applyInArrow(_summed, "c long, from int, v binary")
    return sums.select("c", "v")


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean shape vector of each text; zeros for a text without words."""
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    for lo, hi in tokens.slices(tokens.byte_lengths(texts), 1 << 20):
        rows, shapes, words = word_rows(texts.slice(lo, hi - lo))
        n = np.diff(words)
        full = np.flatnonzero(n)
        if len(full):
            for j, at in enumerate((rows, shapes)):
                # Pieces of fixed length bound the memory of a very long text.
                for a in full if len(rows) > 1 << 20 else [None]:
                    if a is None:
                        out[lo + full, j * DIM : (j + 1) * DIM] = np.add.reduceat(vectors[at], words[:-1][full], dtype=np.float64) / n[full, None]
                    else:
                        out[lo + a, j * DIM : (j + 1) * DIM] = sum(vectors[at[p : min(p + (1 << 18), words[a + 1])]].sum(0, dtype=np.float64) for p in range(words[a], words[a + 1], 1 << 18)) / n[a]
    return out


def _pooled(vectors):
    def run(batches):
        for b in batches:
            found = pool(b.column(2), vectors.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in found], pa.binary())], names=["key", "label", "x"])

    return run


def hidden(x: np.ndarray, net: dict) -> np.ndarray:
    """Logits.  Sums run row by row in a fixed order, so equal rows get equal logits in any batch."""
    x = (x - net["mean"]) / net["dev"]
    h = np.zeros((len(x), net["w1"].shape[1]))
    for i in range(x.shape[1]):
        h += x[:, i : i + 1] * net["w1"][i]
    h = np.maximum(h + net["b1"], 0)
    out = np.full(len(x), net["b2"])
    for i in range(h.shape[1]):
        out = out + h[:, i] * net["w2"][i]
    return out


def train(x: np.ndarray, y: np.ndarray, units: int = 32, epochs: int = 40) -> dict:
    """Adam on the log loss; a fifth of the rows is set aside for the temperature."""
    rng = np.random.default_rng(11)
    net = {"mean": x.mean(0), "dev": x.std(0) + 1e-6, "w1": rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], units)), "b1": np.zeros(units), "w2": rng.normal(0, (2 / units) ** 0.5, units), "b2": np.zeros(()), "t": 1.0}
    set_aside = np.arange(len(x)) % 5 == 4
    if len(np.unique(y[~set_aside])) < 2:
        return net | {"w2": np.zeros(units), "b2": np.asarray(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))}
    xs, ys = ((x - net["mean"]) / net["dev"])[~set_aside], y[~set_aside].astype(float)
    names, step = ("w1", "b1", "w2", "b2"), 0
    m, v = ({k: np.zeros_like(net[k]) for k in names} for _ in range(2))
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for lo in range(0, len(xs), 128):
            a, b = xs[order[lo : lo + 128]], ys[order[lo : lo + 128]]
            h = np.maximum(a @ net["w1"] + net["b1"], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ net["w2"] + net["b2"], -35, 35))) - b) / len(a)
            gh = np.outer(g, net["w2"]) * (h > 0)
            grads = {"w1": a.T @ gh + 1e-4 * net["w1"], "b1": gh.sum(0), "w2": h.T @ g + 1e-4 * net["w2"], "b2": g.sum()}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                net[k] = net[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    z, t = hidden(x[set_aside], net), y[set_aside]
    loss = lambda c: np.logaddexp(0, np.where(t == 1, -z, z) / c).mean()
    return net | {"t": min(np.geomspace(0.25, 8, 61), key=loss) if len(z) else 1.0}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, most: int = MAX_FIT) -> tuple[np.ndarray, dict]:
    """(word and shape vectors of all documents, network fitted on about ``most`` labelled rows at most).  Without labelled
    rows: probability 1/2."""
    spark = docs.sparkSession
    rows = sample_of(docs, labels, label, folds, held_out, most)
    # Sums of whole numbers are exact in any order.
    got, vectors = word_sums(docs).toArrow(), np.zeros((ROWS, DIM), np.float32)
    for c, v in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        vectors[c : c + 4096] = unpack(v, np.int64).reshape(-1, DIM).astype(np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    found = rows.mapInArrow(_pooled(spark.sparkContext.broadcast(vectors)), "key long, label int, x binary").toArrow().sort_by([("key", "ascending"), ("label", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(found.column(2).to_pylist()), np.float32).reshape(-1, 2 * DIM).astype(np.float64)
    y = found.column(1).to_numpy()
    return vectors, train(x, y) if len(x) else train(np.zeros((2, 2 * DIM)), np.array([0, 1]))


def scored(docs: DataFrame, model: tuple[np.ndarray, dict]) -> DataFrame:
    """(doc_id, text) -> doc_id, score; a row for each row.  Null and empty texts are scored by zeros; a text of any length
    is scored whole; equal texts, repeated rows among them, get equal scores.  An empty table gives an empty result; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vectors, net = shared.value
        for b in batches:
            z = hidden(pool(b.column(1), vectors).astype(np.float64), net) / net["t"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def op8_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's probability of good quality; the labels outside the fold that is held out train it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_random_indexing_quality": op8_random_indexing_quality}
