"""Toxicity: FTRL-proximal logistic regression (McMahan et al., 2013) over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word heads (first five bytes of longer words), word pairs and
pairs with one word skipped.  Per-coordinate rates and L1 leave few weights, which are broadcast; their number is bounded
by 2^BITS.  Training takes one task over a bounded sample of labelled rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .work import column, crc_fold, table, through_arrow, unused

BITS, HEAD = 20, 5
#: The most labelled documents that a model is fitted on (about; a hash of doc_id picks them).
MAX_FIT = 12_000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, number of the text of each), repeats included."""
    h, words, heads = tokens.word_hashes(texts, HEAD)
    doc = np.repeat(np.arange(len(words) - 1), np.diff(words))
    found, owner = [], []

    def add(values: np.ndarray, docs: np.ndarray, kind: int) -> None:
        found.append((tokens.mix(values + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append(docs)

    add(h, doc, 1)
    some = heads != 0
    add(heads[some], doc[some], 2)
    for gap, kind in ((1, 3), (2, 4)):
        same = doc[gap:] == doc[:-gap]
        add((h[:-gap] * np.uint64(3) + h[gap:])[same], doc[gap:][same], kind)
    return np.concatenate(found), np.concatenate(owner)


def sample_of(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(key, label, text) of about ``most`` labelled documents at most, of folds other than held_out, picked by a hash of
    doc_id.  Of rows that repeat a doc_id, the least text that is not null counts; of labels, the greater."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max(label).alias("label"))
    share = min(1.0, most / max(1, known.count()))
    picked = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    # The sample has a bound, so it goes to the texts.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select(F.xxhash64("doc_id", F.lit(1)).alias("key"), F.col("label").cast("int").alias("label"), "text")


def _extract(batches):
    for whole in batches:
        for lo, hi in tokens.slices(tokens.byte_lengths(whole.column(2)), 4 << 20):
            batch = whole.slice(lo, hi - lo)
            found, owner = features(batch.column(2))
            pairs = np.unique(owner.astype(np.int64) << BITS | found)
            ends = np.searchsorted(pairs, np.arange(1, hi - lo + 1, dtype=np.int64) << BITS)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["key", "label", "f"])


def ftrl(rows: list[tuple[int, np.ndarray]], alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0, epochs: int = 3, balance: float = 0.5) -> np.ndarray:
    """Weights of 2^BITS features and, last, the bias (no L1).  Rows of the rarer label count more, by the ratio of the
    two to the power ``balance``."""
    size = (1 << BITS) + 1
    z, n, w = (np.zeros(size) for _ in range(3))
    ones = sum(y for y, _ in rows)
    more = max(1.0, (len(rows) - ones) / max(1, ones)) ** balance
    for _ in range(epochs):
        for y, f in rows:
            f = np.append(f, size - 1)
            zf, nf = z[f], n[f]
            lam = np.full(len(f), l1)
            lam[-1] = 0
            wf = np.where(np.abs(zf) <= lam, 0.0, -(zf - np.sign(zf) * lam) / ((beta + np.sqrt(nf)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wf.sum(), -35, 35))) - y) * (more if y else 1.0)
            sigma = (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha
            z[f] = zf + g - sigma * wf
            n[f] = nf + g * g
    lam = np.full(size, l1)
    lam[-1] = 0
    return np.where(np.abs(z) <= lam, 0.0, -(z - np.sign(z) * lam) / ((beta + np.sqrt(n)) / alpha + l2))


def calibrated(w: np.ndarray, rows: list[tuple[int, np.ndarray]], steps: int = 200) -> np.ndarray:
    """Weights times a, bias times a plus b, with the a and b of Platt (1999) on rows that the weights were not fitted
    on; a label's rows weigh by the root of their number.  Without both labels: unchanged."""
    z, y = np.array([w[f].sum() + w[-1] for _, f in rows]), np.array([y for y, _ in rows])
    n = np.bincount(y, minlength=2) if len(rows) else np.zeros(2)
    if not n.min():
        return w
    goal, share = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2)), n[y] ** -0.5 / (n**0.5).sum()
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g, h = share * (p - goal), share * p * (1 - p)
        grad = np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    a = max(a, 1e-3)
    out = w * a
    out[-1] += b
    return out


def train(rows: list[tuple[int, np.ndarray]], **how) -> np.ndarray:
    """FTRL on four fifths of the rows, calibration on the rest."""
    return calibrated(ftrl([r for i, r in enumerate(rows) if i % 5 != 4], **how), rows[4::5])


def _train(batches):
    rows = []
    for b in batches:
        f = b.column(2)
        values, offs = f.values.to_numpy(), f.offsets.to_numpy()
        rows += [(k, y, values[offs[i] : offs[i + 1]].copy()) for i, (k, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    w = train([r[1:] for r in rows])
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["at", "w"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, most: int = MAX_FIT) -> tuple[np.ndarray, np.ndarray]:
    """The model: (feature numbers, weights), the number 2^BITS standing for the bias.  Without labelled rows: empty."""
    rows = sample_of(docs, labels, label, folds, held_out, most).mapInArrow(_extract, "key long, label int, f array<int>")
    found = rows.repartition(1).mapInArrow(_train, "at int, w double").toArrow()
    return found.column(0).to_numpy(), found.column(1).to_numpy()


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """docs -> its columns ``keep`` and ``name``, the probability of label 1; a row for each row.  Null and empty texts have
    the bias alone; a text of any length is scored whole; equal texts get equal scores.  An empty table gives an empty
    result.  Other columns are not read, whatever their names; ``name`` among ``keep`` raises ValueError."""
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"{name} is a column of the documents")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(*map(column, keep), F.col("text").alias(unused(docs, "_text")))
    schema = docs.select(*map(column, keep)).schema.add(name, "double")

    def run(batches):
        at, w = shared.value
        weights = np.zeros((1 << BITS) + 1)
        weights[at] = w
        for whole in batches:
            for lo, hi in tokens.slices(tokens.byte_lengths(whole.column(len(keep))), 4 << 20):
                batch = whole.slice(lo, hi - lo)
                found, owner = features(batch.column(len(keep)))
                hit = np.flatnonzero(weights[found])
                pairs = np.unique(owner[hit].astype(np.int64) << BITS | found[hit])
                total = np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], hi - lo) + weights[-1]
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[str(i) for i in range(len(keep) + 1)])

    return through_arrow(docs, run, schema)


def op1_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's probability of toxicity; the labels outside the fold that is held out train it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ORACLE: dict[str, str] = {}
QUERIES = {"op1_ftrl_toxicity": op1_ftrl_toxicity}
