from larkspur.operators import recursion
from pyspark.sql import types as T


class Rows:
    def __init__(self, spark, rows, schema=None):
        self.spark, self.rows, self.schema = spark, rows, schema

    def collect(self):
        return self.rows

    def first(self):
        return self.rows[0]

    def createOrReplaceTempView(self, view):
        self.spark.view = self.rows


class Chain:
    """Stands for a session over a hierarchy of so many rows, each below the one before."""

    schema = T.StructType([T.StructField("k", T.LongType())])

    def __init__(self, n):
        self.n, self.view = n, []

    def createDataFrame(self, rows, schema):
        return Rows(self, rows, schema)

    def sql(self, text):
        if text == "first":
            return Rows(self, [(1,)], self.schema)
        if text == "step":
            return Rows(self, [(k + 1,) for (k,) in self.view if k < self.n])
        return Rows(self, [{"n": 0}])


def test_ordered_recursion_of_more_than_ten_thousand_rows():
    spark = Chain(10_001)
    recursion.queue(spark, "first", "step", "v", ["k"], False, None)
    assert spark.view == [(k,) for k in range(1, 10_002)]
