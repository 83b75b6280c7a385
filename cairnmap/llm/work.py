"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Steps that are written take texts from the JVM in batches of 8 MB (or one text), in place of 64 MB.
STEP = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder.  Where neither is set, a temporary folder (removed at
    exit) serves a local master; on a cluster that is an error, because executors do not share the driver's folders."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("cairnmap.work.dir", None)
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cairnmap-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("cairnmap.work.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, **values):
    """Session settings for the length of a block; names as ``spark_sql_x`` for ``spark.sql.x`` are given in a dict."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Work:
    """Tables of one run.  ``save`` writes a table and reads it back, which cuts lineage: a lost executor costs the tasks
    of the step that runs, never an earlier step.  Shuffle files of a step go when the step ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, split: int | None = None) -> DataFrame:
        """Writes df and reads it back.  ``split``: bytes that a task of this step reads of a table at most (packed tables
        hold more work a byte than others)."""
        with setting(self.spark, **STEP | ({"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": str(split // 4)} if split else {})):
            df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Saves df in buckets of the hash of ``key``: later joins on the key move only their other side."""
        with setting(self.spark, **STEP | {"spark.sql.sources.bucketing.maxBuckets": str(max(buckets, 100_000))}):
            df.repartition(buckets, key).write.option("path", f"{self.path}/{name}").bucketBy(buckets, key).saveAsTable(self._listed(name))
        return self.spark.table(self._listed(name))

    def _listed(self, name: str) -> str:
        return f"{self.path.rpartition('/')[2]}_{name}".replace("-", "_")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        files, path = self._files()
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._listed(name)}")
            files.delete(path(f"{self.path}/{name}"), True)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """Saves the result of a run and deletes all its other tables."""
        saved = self.save(df, name)
        files, path = self._files()
        self.drop(*(found.getPath().getName() for found in files.listStatus(path(self.path)) if found.getPath().getName() != name))
        return saved


def column(name: str):
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, stem: str = "_x") -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def through_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """mapInArrow that bears any column names: batches that go in and come out name their columns 0, 1, ..."""
    inner = StructType([StructField(str(i), f.dataType) for i, f in enumerate(schema)])
    return df.toDF(*map(str, range(len(df.columns)))).mapInArrow(run, inner).toDF(*schema.names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: DuckDB: crc32 of a decimal number, bit by bit (``.format`` gives the number).
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))), lambda c, d: list_reduce(list_prepend(xor(c, d), CAST(range(8) AS BIGINT[])), lambda r, s: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
