"""Recursive queries that Spark's own WITH RECURSIVE does not cover."""

from __future__ import annotations

import re
import tempfile
import uuid

from larkspur.errors import SqlError
from pyspark.sql import DataFrame, SparkSession

#: Rounds, or rows of an ordered recursion, after which a recursion counts as endless; None for no bound.
MOST_ROUNDS: int | None = None
#: Up to so many rows are held as local rows.
LOCAL_ROWS = 5_000
#: Sources of so many bytes are not first looked at for few rows.
LARGE_BYTES = 64 << 20


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's name under spark.checkpoint.dir; where that is unset, as in tests, under one of our own if all runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise SqlError("spark.checkpoint.dir must name a folder that driver and executors share", "config")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        folder = _own[context.applicationId]
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Writes rows into the shared folder, which ends their lineage."""
    path = shared_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return from_paths(df.sparkSession, df.schema, [path])


def from_paths(spark: SparkSession, schema, paths: list[str]) -> DataFrame:
    """The rows of folders that keep() wrote, as one relation."""
    out = spark.read.schema(schema).parquet(*paths)
    out.paths = paths
    return out


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the size of df's sources, without a job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def settle(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows without the plan that made them: up to LOCAL_ROWS as local rows, more as files in the shared folder.

    A plan over much data is run once, into files, whatever comes of it.
    """
    if plan_bytes(df) > LARGE_BYTES:
        return keep(df)
    head = df.limit(LOCAL_ROWS + 1).toArrow()
    if head.num_rows <= LOCAL_ROWS:
        out = spark.createDataFrame(head, df.schema)
        out.local_rows = head.num_rows
        return out
    return keep(df)


def size_of(df: DataFrame) -> int:
    """The number of rows, known for what settle() holds locally."""
    known = getattr(df, "local_rows", None)
    return df.count() if known is None else known


def fixpoint(spark: SparkSession, first: str, step: str, view: str, distinct: bool, limit: int | None) -> None:
    """Registers view with all rows that first and then step, over and over on the newest rows, give.

    Rounds are set operations: with distinct a round keeps only rows never seen before. limit bounds the rows.
    """
    frontier = settle(spark, spark.sql(first).distinct() if distinct else spark.sql(first))
    seen = frontier
    count = size_of(frontier)
    rounds = 0
    while not (limit is not None and 0 <= limit <= count or size_of(frontier) == 0):
        if MOST_ROUNDS is not None and rounds >= MOST_ROUNDS:
            raise SqlError("recursion does not end", "limit")
        rounds += 1
        frontier.createOrReplaceTempView(view)
        more = spark.sql(step)
        frontier = settle(spark, more.distinct().subtract(seen) if distinct else more)
        count += size_of(frontier)
        seen = settle(spark, seen.union(frontier))
    (seen.limit(limit) if limit is not None and limit >= 0 else seen).createOrReplaceTempView(view)


def queue(spark: SparkSession, first: str, step: str, view: str, keys: list[str], distinct: bool, limit: int | None) -> None:
    """Registers view with the rows in the order in which a priority queue hands them out.

    Each row taken from the queue is stepped alone, so the queue and its order live on the driver; this form is for small
    hierarchies, as its order is only defined row by row.
    """
    schema = spark.sql(first).schema
    waiting, out, seen = [tuple(r) for r in spark.sql(first).collect()], [], set()
    if distinct:
        waiting = list(dict.fromkeys(waiting))
        seen = set(waiting)
    while waiting and not (limit is not None and 0 <= limit <= len(out)):
        spark.createDataFrame([(i, *r) for i, r in enumerate(waiting)], _numbered(schema)).createOrReplaceTempView(view)
        best = spark.sql(f"SELECT n FROM {view} ORDER BY {', '.join(keys)}, n LIMIT 1").first()["n"]
        row = waiting.pop(best)
        out.append(row)
        if MOST_ROUNDS is not None and len(out) > MOST_ROUNDS:
            raise SqlError("recursion does not end", "limit")
        spark.createDataFrame([row], schema).createOrReplaceTempView(view)
        for r in map(tuple, spark.sql(step).collect()):
            if not distinct or r not in seen:
                seen.add(r)
                waiting.append(r)
    spark.createDataFrame(out, schema).createOrReplaceTempView(view)


def _numbered(schema):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("n", T.IntegerType()), *schema.fields])
