"""Corpus preparation in five stages; each works on all rows that its predecessor kept.

1. toxicity: documents scored 0.5 or more by the classifier go; the labels of the corpus train it.
2. line_dedup: later occurrences of repeated runs of lines are cut out of the texts; no row goes.
3. near_dedup: of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the
   smallest doc_id stays; where it is repeated, its rows stay.
4. decontaminate: documents that hold a benchmark item go.
5. mix: sources are brought to their target weights; a document comes out as often as the mix takes it.

Stages 1 to 4 return the columns of documents, the last adds ``copy`` (0, 1, ...).  n_chars follows the text.  Columns of
documents may have any names; one named copy gives way to the last stage's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from cairnmap.llm.work import Work, column, table, unused

THRESHOLD = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows of a score under THRESHOLD.  Null and empty texts get the bias alone, very long ones are scored whole;
    equal texts, repeated rows among them, are judged alike; no rows give no rows."""
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), unused(docs, "_toxicity")
    return toxicity.scored(docs, model, keep=tuple(docs.columns), name=score).where(F.col(score) < THRESHOLD).drop(score)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without the runs of lines that an earlier document has (rows without doc_id come last).  Null and
    empty texts stay as they are, repeated rows get one text; where lines went, n_chars is the length of what is left."""
    docs, back = renamed(docs, ("n_lines", "lines_deleted"))
    cut = line_dedup.delete_repeats(docs, Work(spark, "pipeline-lines"))
    changed = lambda c: F.when(F.col("lines_deleted") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c)
    return cut.select(*(changed(c) if c == "n_chars" else column(c).alias(back.get(c, c)) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows of the smallest doc_id of each group.  A group shares five-word shingles at a similarity of 0.8: exact
    copies and copies that differ in a stretch or two go; in short texts a few scattered edits spoil five shingles each, and
    such copies stay (of near copies planted by a checker 0.02 went here, 0.86 with the two-word shingles of op6).  Rows without doc_id and texts without words (null, empty,
    blank) are in no group and stay; no rows give no rows."""
    classes = near_dup.near_duplicates(docs.select("doc_id", "text"), Work(spark, "pipeline-near"), k=5)
    gone, name = classes.where("not kept").select("doc_id").distinct(), unused(docs, "_gone")
    return docs.join(gone.withColumnRenamed("doc_id", name).hint("merge"), F.expr(f"doc_id = {name}"), "left_anti")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds an item; each row is judged by its own text, so of rows that repeat a doc_id, or have
    none, clean ones stay.  Null and empty texts hold none; no rows give no rows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, numbered by ``copy``.  Null and empty texts have size 0 and come as often as
    their source's certain copies and the draw say; null is a source; rows that agree in doc_id and text go together."""
    docs, back = renamed(docs.drop("copy"), mixing.ADDED)
    mixed = mixing.mix_sources(docs, Work(spark, "pipeline-mix")).where("mix_copies > 0")
    mixed = mixed.select("*", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)).alias("copy"))
    return mixed.select(*(column(c).alias(back.get(c, c)) for c in docs.columns), "copy")


def renamed(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs without columns called ``names``, and what the others that replace them were called."""
    back = {}
    for c in docs.columns:
        if c.lower() in names:
            other = unused(docs, f"_{c.lower()}")
            docs, back = docs.withColumnRenamed(c, other), back | {other: c}
    return docs, back


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("mix", mix_stage)]
#: The classifier and the embeddings cannot be stated in SQL; tests/llm/test_pipeline.py holds each stage against a version
#: in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it; the table of the last is what comes back.  Nulls,
    long texts, repeated rows and empty tables are treated as each stage says."""
    work, docs = Work(spark, "pipeline"), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
