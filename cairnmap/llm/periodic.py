"""Periodic runs of words: repeated k-gram masking, then Main and Lorentz's search in what survives.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` periods long, that cannot be
extended.  It agrees with itself q words on, in an overlap of at least k words, k derived from the two bounds.  So each of
its words lies in a k-gram that the document repeats: all other words are masked, and what is left between them is searched.

Main and Lorentz halve each segment; runs that cross the middle are found from how far the text agrees with itself, shifted
by each period, from the middle on and back from it.  Segments of many documents are halved together; how far two places
agree is read from exact ranks of grams of 1, 2, 4, ... words (no hash decides what is reported).
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .work import CRC, table

LEAST, TIMES = 24, 3


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The least overlap of a run with itself, shifted by its period: max(least, times * q) - q over all periods q."""
    q = least // times
    return min(least - q, (times - 1) * (q + 1)) if q else times - 1


def surviving(hashes: np.ndarray, words: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the stretches of at least ``least`` words, in one text each, whose words all lie in k-grams that
    their text repeats.  A clash of hashes can only leave more words in."""
    n, none = len(hashes), np.zeros(0, np.int64)
    if n < least:
        return none, none
    doc = np.repeat(np.arange(len(words) - 1), np.diff(words))
    grams = tokens.mix(tokens.chain(hashes, k) + doc[: n - k + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    whole = doc[: n - k + 1] == doc[k - 1 :]
    starts = np.flatnonzero(whole)
    order = starts[np.argsort(grams[starts])]
    same = grams[order[1:]] == grams[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, order[again], 1)
    np.add.at(cover, order[again] + k, -1)
    kept = np.concatenate([[False], np.cumsum(cover[:n]) > 0, [False]])
    edge = np.zeros(n + 1, bool)
    edge[words[:-1][words[:-1] < n]] = True
    first = np.flatnonzero(kept[1:-1] & (~kept[:-2] | edge[:n]))
    # A stretch ends with its text, though the next text may go on.
    last = np.flatnonzero(kept[1:-1] & (~kept[2:] | np.append(edge[1:n], True)))
    long = last + 1 - first >= least
    return first[long], last[long] + 1


class Ranks:
    """How far two places of a sequence agree, by ranks of its grams of 1, 2, 4, ... items."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.n, self.levels = len(codes), [codes.astype(np.int64)]
        while 2 ** len(self.levels) <= longest:
            was, step = self.levels[-1], 2 ** (len(self.levels) - 1)
            after = np.full(self.n, -1, np.int64)
            after[: self.n - step] = was[step:]
            # Grams that reach beyond the end are like no other.
            after[max(0, self.n - step) :] = -1 - np.arange(self.n - max(0, self.n - step))
            self.levels.append(np.unique((was + 1) * (3 * self.n + 3) + after + self.n + 1, return_inverse=True)[1])

    def onward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of items that agree from places i and j (i < j) on."""
        i, j, far = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            step, rank = 1 << level, self.levels[level]
            fit = np.flatnonzero(j + step <= self.n)
            fit = fit[rank[i[fit]] == rank[j[fit]]]
            i[fit] += step
            j[fit] += step
            far[fit] += step
        return far

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of items that agree before places i and j (i < j)."""
        i, j, far = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            step, rank = 1 << level, self.levels[level]
            fit = np.flatnonzero(i >= step)
            fit = fit[rank[i[fit] - step] == rank[j[fit] - step]]
            i[fit] -= step
            j[fit] -= step
            far[fit] += step
        return far


def runs_in(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs within the segments, in order.  Between segments stands an item of its own,
    like no other, so no run reaches out of one."""
    if not len(begins):
        return np.zeros((0, 3), np.int64)
    ranks = Ranks(codes, int((ends - begins).max()))
    # A run's stretch of agreement touches the middle and is overlap() long at least: this many items on one side of it.
    near = max(1, overlap(least, times) // 2)
    level = min(near.bit_length() - 1, len(ranks.levels) - 1)
    gram, size = ranks.levels[level], 1 << level
    found, lo, hi = [], begins.astype(np.int64), ends.astype(np.int64)
    while len(lo):
        mid = (lo + hi) // 2
        many = (hi - lo) // times
        at = np.repeat(np.arange(len(lo)), many)
        period = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + 1
        pivot = mid[at]
        for left, right in ((pivot, pivot + period), (pivot - period, pivot)):
            inside = (left >= lo[at]) & (right <= hi[at])
            on = np.zeros(len(left), bool)
            fit = np.flatnonzero(inside & (right + size <= ranks.n))
            on[fit] = gram[left[fit]] == gram[right[fit]]
            fit = np.flatnonzero(inside & ~on & (left >= size))
            on[fit] = gram[left[fit] - size] == gram[right[fit] - size]
            live = np.flatnonzero(on)
            i, j, p = left[live], right[live], period[live]
            before, length = ranks.back(i, j), ranks.onward(i, j)
            start, total = i - before, before + length + p
            good = total >= np.maximum(least, times * p)
            found.append(np.stack([start[good], total[good], p[good]], axis=1))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        big = hi - lo >= least
        lo, hi = lo[big], hi[big]
    every = np.unique(np.concatenate(found), axis=0)
    # The same stretch with a multiple of its period is no other run.
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    return every[first]


def runs_of(texts: pa.Array, least: int = LEAST, times: int = TIMES) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs (start, length, period; by start, then period) of each text."""
    data, offsets = tokens.buffer_of(texts)
    split = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    begins, ends = surviving(*tokens.word_hashes(texts), overlap(least, times), least)
    words = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    out: list[tuple[list[bytes], list[tuple[int, int, int]]]] = [(s, []) for s in split]
    codes, known, places, at, own = [], {}, [], 0, np.searchsorted(words, begins, "right") - 1
    for d, a, b in zip(own.tolist(), begins.tolist(), ends.tolist()):
        some = split[d][a - int(words[d]) : b - int(words[d])]
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in some), np.int64, b - a))
        places.append(at)
        at += b - a + 1
    if not codes:
        return out
    joined, starts = np.full(at, -1, np.int64), np.array(places)
    for place, code in zip(places, codes):
        joined[place : place + len(code)] = code
    gaps = joined < 0
    joined[gaps] = len(known) + np.arange(int(gaps.sum()))
    _, joined = np.unique(joined, return_inverse=True)
    for start, length, period in runs_in(joined, starts, starts + (ends - begins), least, times).tolist():
        segment = int(np.searchsorted(starts, start, "right")) - 1
        d = int(own[segment])
        out[d][1].append((start - places[segment] + int(begins[segment] - words[d]), length, period))
    for _, runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, gone in zip(words, (np.cumsum(change[:-1]) > 0).tolist()) if not gone]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, text) -> doc_id, runs (array of start, length, period, by start, then period), text (the words that are left
    when each run keeps its first period only, joined by one space; unlike the text that went in even without runs).

    A word is what stands between white space; case counts.  Null, empty and blank texts have no words, no runs and the
    empty text.  Each row is searched by itself: repeated rows get equal results, a null doc_id stays null.  A very long text
    is searched whole; memory follows its number of words.  An empty table gives an empty result; other columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for whole in batches:
            for lo, hi in tokens.slices(tokens.byte_lengths(whole.column(1)), 2 << 20):
                batch = whole.slice(lo, hi - lo)
                found = runs_of(batch.column(1), least, times)
                runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs] for _, runs in found], kind)
                texts = pa.array([b" ".join(collapsed(*x)) for x in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), runs, texts], names=["doc_id", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def tiled(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where texts of a doc_id whose crc32 h ends in 0 become periodic: with g = h / 10 and n words, word i from
    a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) / (3 + g mod 8).  A null doc_id has no h."""
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    changed = changed.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    changed = changed.withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    text = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return changed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of each document, some of which are made periodic first: number, the one of most periods, digests."""
    found = periodic_runs(tiled(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    most = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (x, r) -> if(x is null or r.length * x.period > x.length * r.period, r, x))")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("m"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "text")
    return best.select("doc_id", "n_runs", "m.start", "m.length", "m.period", F.expr("m.length * 1000 div m.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


ORACLE = {
    "op13_periodic_runs": rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {CRC.format("doc_id")} AS h FROM documents),
f AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM f),
e AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 8], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(n - 7)) AS i FROM t WHERE n >= 24)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
s AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 8 + q AS length FROM k GROUP BY doc_id, q, island HAVING length >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
best AS (SELECT doc_id, start, length, period FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
left_ AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS text FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM t) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN left_ USING (doc_id)""",
}
QUERIES = {"op13_periodic_runs": op13_periodic_runs}
