"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

The CGK random walk (Chakraborty, Goldenberg, Koucky, 2016) reads a word sequence with a pointer; at each step it emits
the word under the pointer and moves on or stays by a random bit that depends on step and word.  Sequences at a small
edit distance get embeddings at a small Hamming distance.  Each repetition has walk bits of its own and samples
``SAMPLED`` steps of the embedding; windows that agree with an item on all sampled steps are candidates.  Candidates
are verified by the edit distance, in words, between the item and the best stretch of text around the window.

Windows start at every word of a text.  A window takes part if as many of its words occur in items as an item within the
allowed distance needs; this filter loses nothing.  Walks end as soon as no item has the sampled prefix.
A candidate also has to share enough words with the item, counted with repeats, before its edit distance is computed.

Walks of distant sequences drift apart with their length, so an item of over ``PIECE`` words is cut into pieces of equal
length that are embedded each: of the allowed edits, which are a share of the words, at least one piece holds no more than
that share of its own.  Whatever piece collides, the whole item is verified, so the recall of a long item is that of one
piece at least.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .work import table, through_arrow

REPEATS, SAMPLED, GROUP, PIECE = 64, 3, 4, 60
#: Items are broadcast in blocks of about so many bytes of text at most; each block is matched against all documents.
ITEM_BYTES = 16 << 20


def allowed(n: int, percent: int = 80) -> int:
    """Edits allowed for an item of n words."""
    return n * (100 - percent) // 100


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance between item and any stretch of text, end of that stretch), in words; first end on a tie."""
    n = len(text)
    row, steps = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, w in enumerate(item):
        new = np.minimum(row + 1, i + 1 + steps)
        new[1:] = np.minimum(new[1:], row[:-1] + (text != w))
        new[0] = i + 1
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Matcher:
    """Pieces of the items of one block, grouped by length, with their sampled keys for every repetition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int = 80, repeats: int = REPEATS):
        self.percent, self.repeats = percent, repeats
        self.items = [(key, words, Counter(words.tolist())) for key, words in items if len(words)]
        self.groups: dict[int, list[tuple[int, int, np.ndarray]]] = {}  # (number of the item, place in it, words)
        for number, (_, words, _) in enumerate(self.items):
            cuts = np.linspace(0, len(words), -(-len(words) // PIECE) + 1).astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                self.groups.setdefault((b - a) // GROUP, []).append((number, a, words[a:b]))
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.tables = {}
        for g, members in self.groups.items():
            least = min(len(w) for *_, w in members)
            rng = np.random.default_rng(1000 + g)
            # The pointer moves at every other step: twice as many steps as words span the shortest item, whose length
            # bounds the words that any walk of the group reads.
            reach = 2 * least
            sampled = [np.sort(rng.choice(reach, min(SAMPLED, reach), replace=False)) for _ in range(repeats)]
            bits = [rng.integers(0, 1 << 63, reach, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(repeats)]
            inside = np.zeros(len(self.vocabulary) + 1, bool)
            for *_, w in members:
                inside[np.searchsorted(self.vocabulary, w)] = True
            starts = np.cumsum([0] + [len(w) for *_, w in members])[:-1]
            flat = np.concatenate([w for *_, w in members])
            tables = []
            for r in range(repeats):
                keys = self.walk(flat, starts, starts + least - 1, sampled[r], bits[r])
                order = np.argsort(keys[-1], kind="stable")
                tables.append((sampled[r], bits[r], [np.unique(k) for k in keys[:-1]] + [keys[-1][order]], order))
            self.tables[g] = (members, inside, tables, least)

    @staticmethod
    def walk(words: np.ndarray, at: np.ndarray, last: np.ndarray, sampled: np.ndarray, bits: np.ndarray, want=None):
        """Keys after each sampled step; with ``want`` (sorted keys of items for each such step), the start numbers and last
        keys of the walks that agree with an item up to there.  A walk stays on its word ``last``."""
        at, rows, key, keys, s = at.copy(), np.arange(len(at)), np.zeros(len(at), np.uint64), [], 0
        for step in range(int(sampled[-1]) + 1):
            read = words[at]
            if step == sampled[s]:
                key = tokens.mix(key + read)
                keys.append(key)
                if want is not None:
                    stay = np.flatnonzero(want[s][np.minimum(np.searchsorted(want[s], key), len(want[s]) - 1)] == key)
                    at, last, rows, key, read = at[stay], last[stay], rows[stay], key[stay], read[stay]
                s += 1
                if s == len(sampled) or not len(at):
                    break
            at += ((read * bits[step]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, last, out=at)
        return keys if want is None else (rows, key)

    def find(self, h: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item key, distance, first word, word after the last) of the best match of each item in each text."""
        if not len(h) or not len(self.vocabulary):
            return []
        code = np.full(len(h), len(self.vocabulary), np.int64)
        maybe = np.flatnonzero(self.bitmap[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        real = self.vocabulary[place] == h[maybe]
        code[maybe[real]] = place[real]
        spots: dict[tuple[int, int], set[int]] = {}  # (text, item) -> where the item would begin
        for members, inside, tables, least in self.tables.values():
            most = max(len(w) for *_, w in members)
            need = min(len(w) - allowed(len(w), self.percent) for *_, w in members)
            sums = np.zeros(len(h) + most + 1, np.int32)
            np.cumsum(inside[code], out=sums[1 : len(h) + 1])
            sums[len(h) + 1 :] = sums[len(h)]
            live = np.flatnonzero(sums[most : most + len(h)] - sums[: len(h)] >= need)
            if not len(live):
                continue
            doc = np.searchsorted(words, live, "right") - 1
            room = sums[np.minimum(live + most, words[doc + 1])] - sums[live] >= need
            live, doc = live[room], doc[room]
            # A walk ends with its text at the latest, so no other text of the batch has a part in it.
            last = np.minimum(live + least, words[doc + 1]) - 1
            for sampled, bits, keys, order in tables:
                rows, key = self.walk(h, live, last, sampled, bits, keys)
                left, right = (np.searchsorted(keys[-1], key, side).tolist() for side in ("left", "right"))
                for w, a, b in zip(rows.tolist(), left, right):
                    for j in order[a:b].tolist():
                        number, place, _ = members[j]
                        spots.setdefault((int(doc[w]), number), set()).add(int(live[w]) - place)
        out = []
        for (doc, number), starts in spots.items():
            key, item, bag = self.items[number]
            n, d, best = len(item), allowed(len(item), self.percent), None
            stretches: list[list[int]] = []
            for p in sorted(starts):
                lo, hi = max(int(words[doc]), p - d), min(int(words[doc + 1]), p + n + 2 * d)
                # Each edit spoils one word of the item at most.
                if (bag & Counter(h[lo:hi].tolist())).total() < n - d:
                    continue
                # Stretches that overlap are read once, so a text full of an item takes no longer than one with few.
                if stretches and lo <= stretches[-1][1]:
                    stretches[-1][1] = hi
                else:
                    stretches.append([lo, hi])
            for lo, hi in stretches:
                cost, stop = edit_distance(item, h[lo:hi])
                if cost <= d and (best is None or cost < best[0]):
                    length = n if not cost else edit_distance(item[::-1], h[max(lo, lo + stop - n - d) : lo + stop][::-1])[1]
                    best = (cost, lo + stop - length - int(words[doc]), lo + stop - int(words[doc]))
            if best:
                out.append((doc, key, *best))
        return sorted(out)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, repeats: int = REPEATS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, text) x (item_id, text) -> doc_id, item_id, distance, first_word, end_word: a row for each document row and
    item of which the document holds a stretch at an edit distance, in words, of at most ``100 - percent`` per cent of the
    item's words.  Of several stretches: the closest, then the first.

    Words fold A-Z.  Items and documents without words (null, empty, blank) match nothing; items of under five words match
    exactly only.  Items with equal words are reported each.  Rows with a null doc_id or item_id are reported with it.
    Ids are cast to long.  A very long text is matched whole, in one piece; memory follows its number of words.  What is found in a text does not
    depend on other texts.  An empty table on either side gives an empty result.  Other columns are not read.
    """
    schema = "doc_id long, item_id long, distance int, first_word int, end_word int"
    out = None
    for shared in _blocks(benchmark, item_bytes):

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, percent, repeats)
            for whole in batches:
                for lo, hi in tokens.slices(tokens.byte_lengths(whole.column(1)), 4 << 20):
                    batch = whole.slice(lo, hi - lo)
                    found = matcher.find(*tokens.word_hashes(batch.column(1)))
                    ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[i] for f in found], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32())))], names=["doc_id", "item_id", "distance", "first_word", "end_word"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(benchmark: DataFrame, item_bytes: int):
    """Broadcasts of the items as (item_id, word hashes), about ``item_bytes`` bytes of text each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n_blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes
    for block in range(n_blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).toArrow()
        h, words = tokens.word_hashes(got.column(1).combine_chunks() if got.num_rows else pa.array([], pa.string()))
        listed = sorted(((key, h[a:b]) for key, a, b in zip(got.column(0).to_pylist(), words[:-1].tolist(), words[1:].tolist())), key=lambda x: (x[0] is None, x[0] or 0))
        yield benchmark.sparkSession.sparkContext.broadcast(listed)


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80, repeats: int = REPEATS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs (text, ...) that hold no item in the sense of contaminated(), with all their columns, whatever their
    names.  Each row is judged by its own text; nothing is shuffled.  Null, empty and blank texts hold no item and stay, as do
    all rows where the benchmark has no words; repeated rows are judged alike; very long texts are matched whole; an empty
    table gives an empty result.  What is compared, and how, is that of contaminated(); doc_id is not read."""
    at = [c.lower() for c in docs.columns].index("text")
    for shared in _blocks(benchmark, item_bytes):

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, percent, repeats)
            for whole in batches:
                for lo, hi in tokens.slices(tokens.byte_lengths(whole.column(at)), 4 << 20):
                    batch, keep = whole.slice(lo, hi - lo), np.ones(hi - lo, bool)
                    keep[[f[0] for f in matcher.find(*tokens.word_hashes(batch.column(at)))]] = False
                    yield batch.filter(pa.array(keep))

        docs = through_arrow(docs, run, docs.schema)
    return docs


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its distance and place."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_cgk_decontamination": op2_cgk_decontamination}
