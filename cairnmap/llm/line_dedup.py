r"""Repeated runs of lines, found by winnowing over line hashes (Schleimer, Wilkerson, Aiken, 2003); DataFrame functions alone.

A line ends at a newline, or at ``.``, ``!`` or ``?`` with a blank after 20 characters of one sentence.  Of every
``window`` lines in a row the one with the least hash is a fingerprint (a blank line only among blank lines); so is a line
of ``min_words`` words or more by itself.  So each run of ``min_words`` words that two places share has a fingerprint at
the same place in both, and a run without a fingerprint that occurs elsewhere is not repeated.  Of the others, the
tight runs (``min_words`` words or more, and less without the first or without the last line) get a hash of all their
lines.  A tight run whose hash has an earlier place in the order (doc_id, text hash, line) is deleted there.  The tight
runs in a longer repeated run cover it, and the first place of a hash holds the whole run, so a run goes if it occurs at
any earlier place, whatever stands around it.  A group of copies is joined with its first member only, so the work
follows the number of lines, not the square of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Work, column, table, unused

CUT = r"(?<=[\\n ])(?:(?<=\\n)|(?<=[.!?] )(?<=[^.!?\\n]{20}[.!?] ))"
MIN_WORDS, WINDOW = 25, 2


def repeated(places: DataFrame) -> DataFrame:
    """(h, d, t, p) -> h, d0, t0, p0: the first place of each h that has several."""
    place = F.struct("d", "t", "p")
    return places.groupBy("h").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("h", F.col("f.d").alias("d0"), F.col("f.t").alias("t0"), F.col("f.p").alias("p0"))


def delete_repeats(docs: DataFrame, work: Work, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) -> its columns with the text without repeated runs, and n_lines, lines_deleted (int).

    A null text stays null (no lines); an empty one is one line; a text of which all lines are repeats becomes empty.  Words
    of a line are its blanks plus one (30,000 at most, which no result shows).  Rows without doc_id come last in the order,
    by a hash of the text.  Rows that agree in doc_id and text are one document and get the same result.  An earlier place
    may overlap the later one.  A very long text is worked on whole, in memory that follows its number of lines.  Empty
    tables give empty results; other columns pass through, with any names; one named n_lines or lines_deleted gives way.
    """
    # A document is its doc_id and the hash of its text; without doc_id, two hashes of its text, above all ids in use.
    half = F.xxhash64("text")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 2).bitwiseOR(F.lit(1 << 62)))
    lines = docs.where("text is not null").select(doc.alias("d"), half.alias("t"), F.expr(f"split(text, '{CUT}')").alias("s"))
    words = lambda x: F.least(F.lit(30000), F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("short")
    arrays = work.save(lines.select("d", "t", F.transform("s", lambda x: F.xxhash64(F.rtrim(x, F.lit(" \t\r\n")))).alias("h"), F.transform("s", words).alias("w")), "arrays")

    value = F.transform("h", lambda x: F.when(x == F.xxhash64(F.lit("")), F.lit((1 << 63) - 1)).otherwise(x))
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - window, F.lit(0)))
    least = lambda i: F.array_min(F.transform(F.slice("v", i + 1, window), lambda x, j: F.struct(x.alias("h"), (i + j).alias("p"))))["p"]
    alone = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i) >= min_words)
    places = F.transform(F.array_distinct(F.concat(F.transform(starts, least), alone)), lambda p: F.struct(F.get("h", p).alias("h"), p.alias("p")))
    picked = arrays.where(F.size("h") > 0).withColumn("v", value).select("d", "t", F.explode(places).alias("m"))
    marks = picked.select("m.h", "d", "t", "m.p")
    # No side of these joins has a bound, so none is broadcast; adaptive execution splits the partition of a frequent line.
    several = " or ".join(f"least_{c} < most_{c}" for c in "dtp")
    firsts = work.save(marks.groupBy("h").agg(*(f(c).alias(f"{name}_{c}") for c in "dtp" for name, f in (("least", F.min), ("most", F.max)))).where(several).select("h"), "firsts")
    live = marks.join(firsts.hint("merge"), "h")
    live = live.groupBy("d", "t").agg(F.collect_set("p").alias("p"))

    # A fingerprint among the first ``window`` lines of a run begins up to window - 1 lines after the run.
    one = arrays.groupBy("d", "t").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    tight = F.expr(f"""flatten(transform(array_distinct(flatten(transform(p, x -> sequence(greatest(0, x - {window - 1}), x)))), i -> aggregate(
      sequence(i, least(size(h), i + {min_words}) - 1),
      named_struct('n', 0, 'k', 0L, 'out', cast(array() as array<struct<h: bigint, a: int, b: int>>)),
      (s, j) -> if(s.n - w[i] >= {min_words}, s, named_struct('n', s.n + w[j], 'k', xxhash64(s.k, h[j]), 'out',
        if(s.n + w[j] >= {min_words} and (s.n < {min_words} or s.n + w[j] - w[i] < {min_words}), concat(s.out, array(named_struct('h', xxhash64(s.k, h[j]), 'a', i, 'b', j + 1))), s.out))),
      s -> s.out)))""")
    runs = live.join(one.hint("merge"), ["d", "t"]).select("d", "t", F.explode(tight).alias("r"))
    runs = work.save(runs.select("r.h", "d", "t", F.col("r.a").alias("p"), (F.col("r.b") - F.col("r.a")).cast("short").alias("n")), "runs")
    work.drop("arrays", "firsts")
    first_runs = work.save(repeated(runs), "first_runs")
    later = runs.join(first_runs.hint("merge"), "h").where("d <> d0 or t <> t0 or p <> p0")
    deleted = later.groupBy("d", "t").agg(F.collect_set(F.struct(F.col("p").alias("a"), (F.col("p") + F.col("n")).alias("b"))).alias("runs"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["a"], r["b"] - 1))))
    deleted = work.save(deleted.select("d", "t", covered.alias("gone")), "deleted")
    work.drop("runs", "first_runs")

    # Helpers stand in columns whose names docs does not have.
    d, t, parts, cut = (unused(docs, f"_{c}") for c in ("d", "t", "parts", "cut"))
    wide = docs.withColumns({d: doc, t: half})
    wide = wide.join(deleted.select(F.col("d").alias(d), F.col("t").alias(t), F.col("gone").alias(cut)).hint("merge"), [d, t], "left").withColumn(parts, F.expr(f"split(text, '{CUT}')"))
    wide = wide.withColumn(cut, F.when(F.col(cut).isNotNull(), F.expr(f"transform(array_except(sequence(0, size({parts}) - 1), {cut}), i -> {parts}[i])")))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(cut, ""))
    n = F.greatest(F.coalesce(F.size(parts), F.lit(0)), F.lit(0))
    kept = [text.alias(c) if c.lower() == "text" else column(c) for c in docs.columns if c.lower() not in ("n_lines", "lines_deleted")]
    return wide.select(*kept, n.alias("n_lines"), F.when(F.col(cut).isNull(), 0).otherwise(n - F.size(cut)).alias("lines_deleted"))


def op10_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without the runs of lines that stand at an earlier place."""
    return delete_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Work(spark, "line-dedup")).select("doc_id", "n_lines", "lines_deleted", "text")


ORACLE: dict[str, str] = {}
QUERIES = {"op10_winnowing_line_dedup": op10_winnowing_line_dedup}
