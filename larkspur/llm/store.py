"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, as in tests, a folder of our own if all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        found = _own[context.applicationId]
    return found.rstrip("/")


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, options: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    It ends the lineage: what follows is recomputed from these files when an executor is lost. The files go when the session's
    process ends, unless drop() has deleted them before. No mark of success is written: nobody asks for it, and in a local store each file
    starts two processes (chmod, for it and its checksum). Rows are dealt into buckets by the column by, if given: a join on it then leaves
    them where they are. Spark writes buckets only for a table in its catalog, which keeps it no longer than that.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/larkspur-{name}"
    writer = df.write.options(**{"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"} | (options or {}))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    with _tidy(spark):
        if by is None:
            writer.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        table = f"spark_catalog.default.larkspur_{name}"
        writer.bucketBy(partitions(spark), by).saveAsTable(table, format="parquet", path=path)
        back = spark.read.table(table)
        spark.sql(f"DROP TABLE {table}")  # the files of a table with a path stay
        return back


def drop(df: DataFrame) -> None:
    """Deletes what cut() wrote for df, once no later step reads it."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/larkspur-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The size of what df's plan reads, as the optimizer knows it, without a job; sources of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


#: Bytes of input that one bucket of hashes stands for, about: a task holds whole buckets in memory.
BUCKET_BYTES = 32 << 20


def buckets_for(df: DataFrame, least: int = 64, each: int = 2) -> int:
    """How many buckets hashes of df's texts are dealt into: each for a shuffle partition, and more where the input is large for that."""
    return max(least, each * partitions(df.sparkSession), -(-each * input_bytes(df) // BUCKET_BYTES))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of long texts at once: batches of so many rows and bytes at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def free_name(taken, base: str) -> str:
    """A column name that none of taken has, whatever its case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base
