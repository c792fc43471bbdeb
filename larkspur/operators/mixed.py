"""Values of several storage classes in one column.

A tagged value is a struct <c, n, t, b>: the class (1 number, 2 text, 3 blob) and one field for each. Spark orders structs field by field with
nulls first, which is the dialect's order: NULL, then numbers, text and blobs. It groups and joins them as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<c:tinyint, n:double, t:string, b:binary>"


def tag(value: Column, kind: str) -> Column:
    """A tagged value from a column of one class: number, text or blob; NULL stays NULL."""
    at = {"number": 1, "text": 2, "blob": 3}[kind]
    parts = [
        F.lit(at).cast("tinyint").alias("c"),
        (value if at == 1 else F.lit(None)).cast("double").alias("n"),
        (value if at == 2 else F.lit(None)).cast("string").alias("t"),
        (value if at == 3 else F.lit(None)).cast("binary").alias("b"),
    ]
    return F.when(value.isNotNull(), F.struct(*parts)).otherwise(F.lit(None)).cast(TYPE)


def kind(value: Column) -> Column:
    """typeof() of a tagged value: a number that is whole counts as an integer."""
    number = F.when(value["n"] == F.floor(value["n"]), "integer").otherwise("real")
    return F.when(value.isNull(), "null").when(value["c"] == 1, number).when(value["c"] == 2, "text").otherwise("blob")


def ascending(value: Column) -> Column:
    return value.asc_nulls_first()


def descending(value: Column) -> Column:
    return value.desc_nulls_last()
