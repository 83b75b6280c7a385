"""Mixing sources to target weights by Pareto order sampling (Rosén, 1997), on DataFrame functions alone.

Every document expects ``target / source words`` copies (times its own weight, where one is given).  Whole copies are
certain.  For the rest a document has inclusion odds ``p / (1 - p)``; it gets the rank random odds / inclusion odds, and
the lowest ranks of a source are taken until the source's words are reached: a sample of fixed size in words.

No source is sorted in one task: ranks are counted in bins per source, only the bin in which the target falls is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import Work, column, table, unused

BINS = 4096
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
WORD = r"[^\\x20\\x09-\\x0D]+"


def targets(sources: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size) -> with target: shares by weight of all words, stopped at ``most`` times the source's own
    words, the excess reshared by weight.  Sources by code point, null last, get the weights in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    given = given.withColumns({"cap": (F.col("source_size") * most).cast("double"), "total": F.sum("source_size").over(Window.partitionBy()).cast("double")})
    # Sources meet their cap in the order of cap / weight: the level is that of the first one which stays below its cap.
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    given = given.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    first = F.min(F.when(F.col("level").isNotNull(), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(Window.partitionBy())
    return given.select("source", "source_size", F.least(F.col("cap"), F.coalesce(first["level"] * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, work: Work, weights=(5, 2, 1), most: int = 3, seed: str = "mix", weight: str | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) -> its columns and mix_size, mix_source_size, mix_target, mix_copies.

    A null or empty text has size 0; it gets its certain copies and may be drawn, and counts nothing.  Null is a source,
    the last one.  ``weight`` names a column of positive relative weights (null: 1).  Rows that agree in doc_id and text
    are decided together.  A very long text counts whole.  An empty table gives an empty result.  Columns of docs may have
    any names; one with the name of an added column gives way to it.
    Chance comes from md5(seed, doc_id, text): reruns agree, whatever the partitioning.
    """
    own = F.coalesce(column(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    size = F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long")
    sized = work.save(docs.select("doc_id", F.col("source").alias("source"), size.alias("size"), own.alias("own"), key.alias("key")), "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("own")).alias("weighed"))
    goal = targets(sums.select("source", "source_size"), weights, most).join(sums.select(F.col("source").alias("s2"), "weighed"), F.expr("source <=> s2")).drop("s2")
    goal = work.save(goal.withColumn("rate", F.when(F.col("weighed") > 0, F.col("target") / F.col("weighed")).otherwise(0.0)), "targets")

    def ranked(df: DataFrame) -> DataFrame:
        u = (F.conv(F.substring("key", 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
        df = df.withColumn("expected", F.least(F.col("rate") * F.col("own"), F.lit(float(most))))
        df = df.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
        df = df.withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
        return df.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS))

    here = goal.select(F.col("source").alias("s"), "source_size", "target", "rate")
    drawn = ranked(sized.join(here, F.expr("source <=> s")).drop("s"))
    bins = work.save(drawn.groupBy("source", "bin").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("whole")).alias("certain")), "bins")
    by_bin = Window.partitionBy("source").orderBy(F.col("bin").asc_nulls_first())
    # Rows without a rank (p = 0) are in the null bin, which comes first and adds nothing to what is drawn.
    left = F.first("target").over(Window.partitionBy("source")) - F.sum("certain").over(Window.partitionBy("source"))
    cum = bins.join(here.select(F.col("s"), "target"), F.expr("source <=> s")).drop("s").withColumn("drawable", F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0))
    cum = cum.withColumns({"left": left, "upto": F.sum("drawable").over(by_bin)})
    edge = cum.where("bin is not null and left > 0 and upto >= left").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("drawable")).alias("before"), "left")).alias("e"))
    edge = edge.select(F.col("source").alias("s3"), "e.*").withColumnRenamed("bin", "edge_bin")
    in_edge = drawn.join(edge, F.expr("source <=> s3 and bin = edge_bin"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("q", "key").rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    in_edge = in_edge.withColumn("upto", run).withColumn("run", F.sum("size").over(Window.partitionBy("source", "q", "key")))
    taken = in_edge.where("upto - run < left and (upto <= left or upto - run / 2 <= left)").groupBy("source").agg(F.max(F.struct("q", "key")).alias("last"))
    cuts = edge.join(taken.select(F.col("source").alias("s4"), "last"), F.expr("s3 <=> s4"), "left").select("s3", "edge_bin", "last")
    open_ = cum.groupBy("source").agg(F.first("left").alias("left")).withColumnRenamed("source", "s5")
    plan = here.join(cuts, F.expr("s <=> s3"), "left").drop("s3").join(open_, F.expr("s <=> s5"), "left").drop("s5")
    plan = work.save(plan.select(*(F.col(c).alias(f"_{c}") for c in ("s", "source_size", "target", "rate", "edge_bin", "last", "left"))), "plan")

    work.drop("sized", "targets", "bins")

    # Helpers stand in two columns whose names docs does not have.
    own_, plan_ = unused(docs, "_own"), unused(docs, "_plan")
    df = docs.withColumn(own_, F.struct(F.col("source").alias("source"), size.alias("size"), own.alias("own"), key.alias("key")))
    df = df.join(plan.select(F.struct("*").alias(plan_)), F.expr(f"{own_}.source <=> {plan_}._s"), "left")
    mine, here = (lambda c: F.col(own_)[c]), (lambda c: F.col(plan_)[f"_{c}"])
    u = (F.conv(F.substring(mine("key"), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    expected = F.least(F.coalesce(here("rate") * mine("own"), F.lit(0.0)), F.lit(float(most)))
    whole = F.floor(expected)
    p = expected - whole
    q = F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    bin_ = F.floor(q / (1 + q) * BINS)
    edge_take = F.coalesce(F.struct(q.alias("q"), mine("key").alias("key")) <= here("last"), F.lit(False))
    draw = F.when(q.isNull() | (F.coalesce(here("left"), F.lit(0.0)) <= 0), F.lit(False)).when(here("edge_bin").isNull() | (bin_ < here("edge_bin")), F.lit(True)).otherwise((bin_ == here("edge_bin")) & edge_take)
    kept = [column(c) for c in docs.columns if c.lower() not in ADDED]
    return df.select(*kept, mine("size").alias("mix_size"), here("source_size").alias("mix_source_size"), here("target").alias("mix_target"), (whole + draw.cast("int")).cast("int").alias("mix_copies"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), Work(spark, "mixing"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


ORACLE = {
    "op7_pareto_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
g AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
  CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM g),
v AS (SELECT arg_min(level, cap / weight) AS level FROM f WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(v.level * weight, cap)) AS target FROM f LEFT JOIN v ON TRUE),
e AS (SELECT d.*, t.source_size, t.target, least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END, 3.0) AS expected FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p, target - sum(size * floor(expected)) OVER (PARTITION BY source) AS remaining FROM e),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY substr(key, 1, 13), key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY source, key) AS run FROM r)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN p > 0 AND remaining > 0 AND upto - run < remaining AND (upto <= remaining OR upto - run / 2 <= remaining) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
}
QUERIES = {"op7_pareto_mixing": op7_pareto_mixing}
