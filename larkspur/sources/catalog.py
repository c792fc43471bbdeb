"""Tables, views, indexes and triggers of a database, and their rows as DataFrames.

A table's rows are one immutable DataFrame with a __rowid column; a change makes a new one. So a transaction is a copy of the catalog, and rolling
back is putting the copy back. Small results of a change are kept as local rows, larger ones as Parquet in the shared folder.
"""

from __future__ import annotations

import copy
import itertools
from dataclasses import dataclass, field

from larkspur.errors import SqlError
from larkspur.functions import values as v
from larkspur.operators.recursion import from_paths, keep, settle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SPARK = {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "any": T.StringType(), "blob": T.BinaryType(), "null": T.StringType(), "bool": T.LongType(), "ts": T.StringType()}
_views = itertools.count()
__all__ = ["Catalog", "Col", "Foreign", "Index", "Key", "Table", "Trigger", "View", "append", "empty", "external", "publish", "schema", "settle"]


@dataclass
class Col:
    name: str
    declared: str = ""
    t: str = "null"
    aff: str = ""
    coll: str = ""
    notnull: bool = False
    pk: int = 0
    default: object = None
    default_text: str | None = None
    generated: object = None
    stored: bool = False


@dataclass
class Key:
    columns: list[str]
    conflict: str | None = None
    name: str | None = None
    where: object = None
    exprs: list | None = None
    origin: str = "u"


@dataclass
class Foreign:
    columns: list[str]
    parent: str
    parent_columns: list[str] | None
    on_delete: str
    on_update: str
    deferred: bool = False


@dataclass
class Table:
    name: str
    columns: list[Col]
    keys: list[Key] = field(default_factory=list)
    checks: list = field(default_factory=list)
    foreigns: list[Foreign] = field(default_factory=list)
    strict: bool = False
    without_rowid: bool = False
    rowid_column: str | None = None
    autoincrement: bool = False
    last_rowid: int = 0
    sql: str = ""
    external: bool = False
    fts: dict | None = None
    rtree: bool = False
    df: DataFrame | None = None
    view: str = ""

    def col(self, name: str) -> Col:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SqlError(f"table {self.name} has no column named {name}", "name")


@dataclass
class View:
    name: str
    select: object
    columns: list[str] | None
    sql: str


@dataclass
class Index:
    name: str
    table: str
    unique: bool
    columns: list
    where: object
    sql: str


@dataclass
class Trigger:
    name: str
    node: object
    sql: str


class Catalog:
    """All objects of a database by lower-case name."""

    def __init__(self):
        self.tables: dict[str, Table] = {}
        self.views: dict[str, View] = {}
        self.indexes: dict[str, Index] = {}
        self.triggers: dict[str, Trigger] = {}
        self.attached: dict[str, Catalog] = {}
        self.pragmas = {"user_version": 0, "schema_version": 0}

    def copy(self) -> Catalog:
        out = Catalog()
        out.tables = {k: copy.copy(t) for k, t in self.tables.items()}
        for t in out.tables.values():
            t.columns, t.keys = [copy.copy(c) for c in t.columns], list(t.keys)
        out.views, out.indexes, out.triggers = dict(self.views), dict(self.indexes), dict(self.triggers)
        out.attached = {k: c.copy() for k, c in self.attached.items()}
        out.pragmas = dict(self.pragmas)
        return out

    def keys(self, table: Table) -> list[Key]:
        """Unique keys of a table, those of its unique indexes among them."""
        extra = []
        for i in self.indexes.values():
            if i.unique and i.table.lower() == table.name.lower():
                plain = all(e[0] == "col" for e, _ in i.columns)
                extra.append(Key([e[2] for e, _ in i.columns] if plain else [], None, i.name, i.where, None if plain and not i.where else [e for e, _ in i.columns], "c"))
        return [*table.keys, *extra]


def schema(table: Table, types: dict[str, str] | None = None) -> T.StructType:
    cols = [] if table.external else [T.StructField("__rowid", T.LongType())]
    return T.StructType([*cols, *(T.StructField(c.name, _SPARK[c.t]) for c in table.columns)])


def empty(spark: SparkSession, table: Table) -> DataFrame:
    out = spark.createDataFrame([], schema(table))
    out.local_rows = 0
    return out


def publish(table: Table, df: DataFrame) -> None:
    """Makes df the table's rows, under a view of a new name so that older plans keep what they read."""
    table.df = df
    table.view = f"t{next(_views)}_{''.join(c if c.isascii() and c.isalnum() else '_' for c in table.name)}"
    df.createOrReplaceTempView(table.view)


#: Folders that a table's rows may lie in before they are written together.
MOST_PARTS = 64


def append(table: Table, df: DataFrame) -> None:
    """Adds settled rows to the table's. Few rows stay local; others are written beside the files that are there, which stay as they are."""
    old, spark = table.df, df.sparkSession
    if getattr(old, "local_rows", None) is not None and getattr(df, "local_rows", None) is not None:
        return publish(table, settle(spark, old.unionByName(df)))
    new = df.select(*old.columns)
    if [(f.name, f.dataType) for f in old.schema.fields] != [(f.name, f.dataType) for f in new.schema.fields]:
        return publish(table, settle(spark, old.unionByName(df)))
    paths = [p for part in (old if hasattr(old, "paths") else keep(old), keep(new)) for p in part.paths]
    rows = from_paths(spark, old.schema, paths)
    publish(table, keep(rows) if len(paths) > MOST_PARTS else rows)


def external(name: str, df: DataFrame) -> Table:
    """An outside DataFrame as a table: narrow numbers widened, timestamps and dates kept as such until shown."""
    cols, select = [], []
    for f in df.schema.fields:
        kind, q = f.dataType, v.ident(f.name)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            t, sql = "int", f"CAST({q} AS BIGINT) AS {q}"
        elif isinstance(kind, T.LongType):
            t, sql = "int", q
        elif isinstance(kind, T.BooleanType):
            t, sql = "int", f"CAST({q} AS BIGINT) AS {q}"
        elif isinstance(kind, (T.FloatType, T.DecimalType)):
            t, sql = "real", f"CAST({q} AS DOUBLE) AS {q}"
        elif isinstance(kind, T.DoubleType):
            t, sql = "real", q
        elif isinstance(kind, T.BinaryType):
            t, sql = "blob", q
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            t, sql = "ts", f"CAST({q} AS TIMESTAMP_NTZ) AS {q}"
        elif isinstance(kind, T.DateType):
            t, sql = "text", f"date_format({q}, 'yyyy-MM-dd') AS {q}"
        elif isinstance(kind, T.StringType):
            t, sql = "text", q
        else:
            t, sql = "text", f"to_json({q}) AS {q}"
        aff = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "ts": "TEXT"}.get(t, "BLOB")
        cols.append(Col(f.name, aff, t, aff))
        select.append(sql)
    table = Table(name, cols, external=True)
    publish(table, df.selectExpr(*select))
    return table
