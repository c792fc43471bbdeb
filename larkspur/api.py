"""The host API: Database, Statement, Snapshot."""

from __future__ import annotations

import json
import math
from contextlib import contextmanager

from larkspur.errors import ConstraintError, SqlError
from larkspur.functions import udfs
from larkspur.functions import values as v
from larkspur.functions.values import E
from larkspur.operators.changes import Changes, _Ignore
from larkspur.plans import parser
from larkspur.plans.lower import Lowering, Scope
from larkspur.plans.parser import Node
from larkspur.session import TABLES, prepare
from larkspur.session import table as read_table
from larkspur.sources import catalog as cat
from larkspur.sources.pragma import Pragmas
from pyspark.sql import DataFrame, SparkSession

STRICT_TYPES = {"INT", "INTEGER", "REAL", "TEXT", "BLOB", "ANY"}


class RunResult:
    """What a changing statement did."""

    def __init__(self, changes: int, last_insert_rowid: int):
        self.changes, self.last_insert_rowid = changes, last_insert_rowid


class Statement:
    """A parsed statement, run with bound values. A SELECT is lowered once for each state of the database and set of values, so changes are seen."""

    def __init__(self, db: Database, sql: str):
        self.db, self.sql, self.node = db, sql, db._one(sql)
        self._lowered: tuple | None = None

    def _select(self, params) -> DataFrame:
        """The last result's plan again where neither the database nor the values have changed since; a statement that draws random numbers is lowered anew."""
        if self._lowered is not None and self._lowered[0] == (self.db._state(), repr(params)):
            return self._lowered[1]
        draws = self.db._draws
        df = self.db._execute(self.node, params)
        self._lowered = ((self.db._state(), repr(params)), df) if self.db._draws == draws else None
        return df

    def run(self, *params) -> RunResult:
        self.db._execute(self.node, self._bind(params))
        return RunResult(self.db.changes, self.db.last_insert_rowid)

    def result(self, *params) -> DataFrame:
        out = self._select(self._bind(params)) if self.node.kind == "select" else self.db._execute(self.node, self._bind(params))
        return out if out is not None else self.db.spark.createDataFrame([], "ok int").drop("ok")

    def all(self, *params) -> list[dict]:
        return [r.asDict() for r in self.result(*params).collect()]

    def get(self, *params) -> dict | None:
        rows = self.result(*params).limit(1).collect()
        return rows[0].asDict() if rows else None

    @staticmethod
    def _bind(params):
        if len(params) == 1 and isinstance(params[0], (dict, list, tuple)):
            return params[0]
        return list(params)


class Database:
    """A database of the dialect on a Spark session. Queries are lazy DataFrames; changes happen at once."""

    def __init__(self, spark: SparkSession, seed: int = 1, now: str = "2000-01-01 00:00:00"):
        self.spark, self.seed, self.now = prepare(spark), seed, now
        udfs.register(spark)
        self.catalog = cat.Catalog()
        self.changes = self.total_changes = self.last_insert_rowid = 0
        self.foreign_keys = self.case_sensitive_like = False
        self._stack: list[tuple[str | None, cat.Catalog]] = []
        self._folder, self._lazy = None, set()
        self._changer, self._pragmas, self._closed, self._draws = Changes(self), Pragmas(self), False, 0

    # -- use
    def exec(self, sql: str) -> None:
        """Runs all statements of a script."""
        self._open()
        for node in parser.parse(sql):
            out = self._execute(node, None)
            if out is not None and node.kind in ("select",):
                out.schema

    def query(self, sql: str, params=None) -> DataFrame:
        """The result of one statement, as a DataFrame."""
        self._open()
        out = self._execute(self._one(sql), params)
        return out if out is not None else self.spark.createDataFrame([], "ok int").drop("ok")

    def prepare(self, sql: str) -> Statement:
        self._open()
        return Statement(self, sql)

    @contextmanager
    def transaction(self):
        """Commits at the end, rolls back on an error; nested ones are savepoints."""
        name = f"nested{len(self._stack)}" if self._stack else None
        self._stack.append((name, self.catalog.copy()))
        depth = len(self._stack)
        try:
            yield self
        except BaseException:
            self.catalog = self._stack[depth - 1][1]
            del self._stack[depth - 1 :]
            raise
        del self._stack[depth - 1 :]

    @property
    def in_transaction(self) -> bool:
        return bool(self._stack)

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.catalog.copy())

    def close(self) -> None:
        self._closed = True

    def register(self, name: str, df: DataFrame) -> None:
        """Makes an outside DataFrame readable as a table."""
        self.catalog.tables[name.lower()] = cat.external(name, df)

    def attach_folder(self, path: str, names=TABLES) -> Database:
        """Makes the Parquet tables of a folder readable; each is opened when a statement first names it."""
        self._folder, self._lazy = path, {n.lower() for n in names}
        return self

    def _find(self, name: str) -> None:
        if name.lower() in self._lazy:
            self._lazy.discard(name.lower())
            if name.lower() not in self.catalog.tables:
                self.register(name.lower(), read_table(self.spark, self._folder, name.lower()))

    def _state(self) -> tuple:
        """What a lowered SELECT depends on: the rows and definitions of all tables and views, and the session's switches."""
        every = (self.catalog, *self.catalog.attached.values())
        return (
            tuple((k, t.view) for c in every for k, t in c.tables.items()), tuple((k, id(w)) for c in every for k, w in c.views.items()),
            self.case_sensitive_like, self.changes, self.total_changes, self.last_insert_rowid, self.catalog.pragmas["schema_version"],
        )

    def explain(self, sql: str, mode: str = "formatted") -> None:
        """Spark's plan of a query."""
        self.query(sql).explain(mode)

    # -- what lowering asks
    def _open(self):
        if self._closed:
            raise SqlError("database is closed", "closed")

    def _one(self, sql: str) -> Node:
        nodes = parser.parse(sql)
        if len(nodes) != 1:
            raise SqlError("expected one statement", "syntax")
        return nodes[0]

    def bound(self, params, key):
        if params is None:
            value = None
        elif isinstance(params, dict):
            value = params.get(key, params.get(str(key)[1:])) if isinstance(key, str) else params.get(key)
        else:
            value = params[key - 1] if isinstance(key, int) and key <= len(params) else None
        if isinstance(value, bool):
            return int(value)
        if isinstance(value, float) and not math.isfinite(value):
            raise SqlError("cannot bind a non-finite number", "bind")
        if value is not None and not isinstance(value, (int, float, str, bytes, bytearray)):
            raise SqlError(f"cannot bind a value of type {type(value).__name__}", "bind")
        return value

    def next_seed(self) -> int:
        self._draws += 1
        return self.seed * 1_000_003 + self._draws

    def _schema(self, schema: str | None) -> cat.Catalog:
        if schema is None or schema.lower() in ("main", "temp"):
            return self.catalog
        if schema.lower() not in self.catalog.attached:
            raise SqlError(f"unknown database {schema}", "name")
        return self.catalog.attached[schema.lower()]

    def catalog_of(self, t) -> cat.Catalog:
        for c in self.catalog.attached.values():
            if any(x is t for x in c.tables.values()) or any(x is t for x in c.views.values()):
                return c
        return self.catalog

    def is_table(self, name: str) -> bool:
        self._find(name)
        return any(name.lower() in c.tables or name.lower() in c.views for c in (self.catalog, *self.catalog.attached.values()))

    def table(self, schema: str | None, name: str) -> cat.Table:
        self._find(name)
        for c in [self._schema(schema)] + (list(self.catalog.attached.values()) if schema is None else []):
            if name.lower() in c.tables:
                return c.tables[name.lower()]
        raise SqlError(f"no such table: {name}", "name")

    def source(self, schema: str | None, name: str):
        low = name.lower()
        self._find(name)
        if low in ("sqlite_schema", "sqlite_master", "sqlite_temp_schema", "sqlite_temp_master"):
            view, cols = self._pragmas.master(self._schema(schema))
            return "table", (view, [(n, t, "", "") for n, t in cols], None)
        for c in [self._schema(schema)] + (list(self.catalog.attached.values()) if schema is None else []):
            if low in c.views:
                return "view", c.views[low]
            if low in c.tables:
                t = c.tables[low]
                cols = [(x.name, x.t, x.aff, x.coll) for x in t.columns]
                if not t.external:
                    cols.append(("__rowid", "int", "INTEGER", ""))
                return "table", (t.view, cols, t.fts)
        return None

    def pragma_table(self, name: str, args: list):
        return self._pragmas.table(name, args)

    # -- statements
    def _execute(self, s: Node, params, outer: Scope | None = None):
        kind = s.kind
        if kind == "select":
            return self._select(s, params, outer)
        if kind in ("insert", "update", "delete"):
            return self._change(s, params, outer)
        if kind == "explain":
            detail = "SCAN" if s.plan else "Init"
            return self.spark.createDataFrame([(2, 0, 0, detail)], "id int, parent int, notused int, detail string")
        if kind == "pragma":
            return self._pragmas.run(s)
        if kind in ("analyze", "reindex", "vacuum"):
            return self._pragmas.analyze(s.name) if kind == "analyze" else None
        if kind in ("begin", "commit", "rollback", "savepoint", "release"):
            return self._transact(s)
        if kind in ("attach", "detach"):
            name = s.name.lower()
            if kind == "attach":
                if name in self.catalog.attached or name in ("main", "temp"):
                    raise SqlError(f"database {s.name} is already in use")
                self.catalog.attached[name] = cat.Catalog()
            elif self.catalog.attached.pop(name, None) is None:
                raise SqlError(f"no such database: {s.name}", "name")
            return None
        self.catalog.pragmas["schema_version"] += 1
        return getattr(self, f"_{kind}")(s)

    def _select(self, s: Node, params=None, outer=None) -> DataFrame:
        rel = Lowering(self, params).query(s, outer)
        df = self.spark.sql(rel.sql)
        return df.toDF(*[c.name for c in rel.columns])

    def _change(self, s: Node, params, outer):
        target = self._schema(s.schema)
        if s.table.lower() in target.views:
            return self._view_change(s, params, outer, target.views[s.table.lower()])
        t = self.table(s.schema, s.table)
        if t.fts and s.kind == "insert" and s.columns and [c.lower() for c in s.columns[:1]] == [t.name.lower()]:
            return self._fts_command(t, s)
        saved = self.catalog.copy()
        rowid, total = self.last_insert_rowid, self.total_changes
        try:
            count, out = getattr(self._changer, s.kind)(s, outer, params)
        except SqlError:
            if s.conflict == "ROLLBACK" and self._stack:
                saved = self._stack[0][1]
                self._stack.clear()
            self.catalog = saved
            self.last_insert_rowid = rowid
            raise
        except Exception as e:
            self.catalog = saved
            found = str(e).split("RAISE:", 1)
            if len(found) == 2:
                action, message = found[1].split(":", 1)
                raise ConstraintError(message.split(" SQLSTATE")[0].split("\n")[0], "trigger") from None
            raise
        if self._changer.depth == 0:
            self.changes = count
        self.total_changes = max(total, self.total_changes) + count
        return out

    def run_in_trigger(self, s: Node, outer: Scope) -> None:
        if s.kind == "select":
            for item in s.arms[0][1].items or []:
                if item[0] == "item" and item[1][0] == "raise" and s.arms[0][1].where is None and s.arms[0][1].source is None:
                    self._raise(item[1])
            try:
                rows = self._select(s, None, outer).collect()
            except Exception as e:
                if "RAISE:" in str(e):
                    action, message = str(e).split("RAISE:", 1)[1].split(":", 1)
                    if action == "IGNORE":
                        raise _Ignore from None
                    raise ConstraintError(message.split(" SQLSTATE")[0].split("\n")[0].strip("'"), "trigger") from None
                raise
            del rows
        else:
            self._change(s, None, outer)

    def _raise(self, e):
        if e[1] == "IGNORE":
            raise _Ignore
        raise ConstraintError(str(e[2][1]) if e[2] else "", "trigger")

    def _view_change(self, s: Node, params, outer, view):
        event = s.kind.upper()
        found = [x for x in self.catalog.triggers.values() if x.node.table.lower() == view.name.lower() and x.node.when == "INSTEAD OF" and x.node.event == event]
        if not found:
            raise SqlError(f"cannot modify {view.name} because it is a view", "readonly")
        low = Lowering(self, params)
        rel = low.query(view.select)
        names = view.columns or [c.name for c in rel.columns]
        cols = [cat.Col(n, t=c.e.t) for n, c in zip(names, rel.columns)]
        fake = cat.Table(view.name, cols)
        view_sql = f"SELECT {', '.join(f'c{i} AS {v.ident(n)}' for i, n in enumerate(names))}, monotonically_increasing_id() AS __rowid FROM ({rel.sql})"
        from larkspur.operators.changes import columns_of, view_of

        if s.kind == "insert":
            got = low.query(s.source, outer)
            given = [c.lower() for c in (s.columns or names)]
            parts = [f"{v.cast_to(got.columns[given.index(n.lower())].e._replace(sql=f'c{given.index(n.lower())}'), got.columns[given.index(n.lower())].e.t)} AS {v.ident(n)}" if n.lower() in given else f"CAST(NULL AS STRING) AS {v.ident(n)}" for n in names]
            new = self.spark.sql(f"SELECT {', '.join(parts)}, monotonically_increasing_id() AS __rowid FROM ({got.sql})")
            self._changer.fire(fake, "INSTEAD OF", event, None, cat.settle(self.spark, new))
            return None
        old = cat.settle(self.spark, self.spark.sql(view_sql))
        name = view_of(old)
        scope = Scope(columns_of(fake, name, s.alias or view.name), outer)
        where = f" WHERE {v.truth(low.expr(s.where, scope))}" if s.where is not None else ""
        old = cat.settle(self.spark, self.spark.sql(f"SELECT * FROM {name}{where}"))
        if s.kind == "delete":
            self._changer.fire(fake, "INSTEAD OF", event, old, None)
            return None
        new = {c.lower(): v.value(low.expr(e, scope)) for c, e in s.set}
        cols_sql = ", ".join(f"{new.get(n.lower(), v.ident(n))} AS {v.ident(n)}" for n in names)
        changed = cat.settle(self.spark, self.spark.sql(f"SELECT {cols_sql}, __rowid, __rowid AS __old FROM {name}{where}"))
        self._changer.fire(fake, "INSTEAD OF", event, old, changed, [c.lower() for c, _ in s.set])
        return None

    def _transact(self, s: Node) -> None:
        if s.kind == "begin":
            if self._stack:
                raise SqlError("cannot start a transaction within a transaction", "transaction")
            self._stack.append((None, self.catalog.copy()))
        elif s.kind == "commit":
            if not self._stack:
                raise SqlError("cannot commit - no transaction is active", "transaction")
            self._deferred()
            self._stack.clear()
        elif s.kind == "savepoint":
            self._stack.append((s.name.lower(), self.catalog.copy()))
        else:
            name = s.name if s.kind == "release" else s.to
            if name is None:
                if not self._stack:
                    raise SqlError("cannot rollback - no transaction is active", "transaction")
                self.catalog = self._stack[0][1]
                self._stack.clear()
                return
            at = next((i for i in range(len(self._stack) - 1, -1, -1) if self._stack[i][0] == name.lower()), None)
            if at is None:
                raise SqlError(f"no such savepoint: {name}", "transaction")
            if s.kind == "release":
                del self._stack[at:]
            else:
                self.catalog = self._stack[at][1].copy()
                del self._stack[at + 1 :]

    def _deferred(self) -> None:
        """Deferred foreign keys are checked when the transaction ends."""
        if not self.foreign_keys:
            return
        stack, self._stack = self._stack, []
        try:
            for t in self.catalog.tables.values():
                if any(f.deferred for f in t.foreigns):
                    self._changer.foreign_out(t, t.df)
        finally:
            self._stack = stack

    # -- definitions
    def _taken(self, s: Node) -> bool:
        c = self._schema(s.schema)
        for kind, names in (("table", c.tables), ("view", c.views), ("index", c.indexes)):
            if s.name.lower() in names:
                if s.exists:
                    return True
                raise SqlError(f"{'there is already a table' if kind == 'table' and s.kind == 'create_view' else kind} {s.name} already exists", "exists")
        return False

    def _create_table(self, s: Node) -> None:
        if self._taken(s):
            return None
        c = self._schema(s.schema)
        if s.select is not None:
            rel = Lowering(self).query(s.select)
            cols = [cat.Col(x.name, "", x.e.t if x.e.t != "any" else "text", "") for x in rel.columns]
            t = cat.Table(s.name, cols, sql=s.text)
            names = ", ".join(f"c{i} AS {v.ident(x.name)}" for i, x in enumerate(cols))
            df = self.spark.sql(f"SELECT row_number() OVER (ORDER BY __k) * 1L AS __rowid, * EXCEPT (__k) FROM (SELECT monotonically_increasing_id() AS __k, {names} FROM ({rel.sql}))")
            cat.publish(t, cat.settle(self.spark, df))
            t.last_rowid = self.spark.sql(f"SELECT coalesce(max(__rowid), 0L) AS m FROM {t.view}").first()["m"]
            c.tables[s.name.lower()] = t
            return None
        t = cat.Table(s.name, [], strict=bool(s.strict), without_rowid=bool(s.without_rowid), sql=s.text)
        pk = []
        for d in s.columns:
            aff = v.affinity(d.type)
            if any(x.name.lower() == d.name.lower() for x in t.columns):
                raise SqlError(f"duplicate column name: {d.name}", "schema")
            if t.strict and (d.type or "").upper() not in STRICT_TYPES:
                raise SqlError(f"unknown datatype for {s.name}.{d.name}: \"{d.type}\"" if d.type else f"missing datatype for {s.name}.{d.name}", "schema")
            kind = {"INTEGER": "int", "TEXT": "text", "REAL": "real"}.get(aff, "blob" if "BLOB" in (d.type or "").upper() else "null")
            t.columns.append(cat.Col(d.name, d.type or "", kind, aff if d.type else "", d.collation or "", bool(d.notnull), 0, d.default, d.default_text, d.generated, bool(d.stored)))
            if d.primary:
                pk = [d.name]
                t.autoincrement = bool(d.autoincrement)
            if d.unique:
                t.keys.append(cat.Key([d.name], d.unique_conflict))
            t.checks += [(x.expr, x.text) for x in d.checks]
            if d.foreign:
                t.foreigns.append(self._foreign(d.foreign))
        for x in s.constraints:
            if x.type == "primary":
                pk = x.columns
            elif x.type == "unique":
                t.keys.append(cat.Key(x.columns, x.on_conflict, x.name))
            elif x.type == "check":
                t.checks.append((x.expr, x.name or x.text))
            else:
                t.foreigns.append(self._foreign(x))
        for i, n in enumerate(pk):
            t.col(n).pk = i + 1
        if len(pk) == 1 and t.col(pk[0]).declared.upper() == "INTEGER" and not t.without_rowid:
            t.rowid_column = t.col(pk[0]).name
        elif pk:
            t.keys.insert(0, cat.Key(pk, None, None, origin="pk"))
            if t.without_rowid:
                for n in pk:
                    t.col(n).notnull = True
        if t.without_rowid and not pk:
            raise SqlError(f"PRIMARY KEY missing on table {s.name}", "schema")
        cat.publish(t, cat.empty(self.spark, t))
        c.tables[s.name.lower()] = t

    @staticmethod
    def _foreign(x) -> cat.Foreign:
        return cat.Foreign(x.columns, x.parent, x.parent_columns, x.on_delete, x.on_update, bool(x.deferred))

    def _create_view(self, s: Node) -> None:
        if not self._taken(s):
            self._schema(s.schema).views[s.name.lower()] = cat.View(s.name, s.select, s.columns, s.text)

    def _create_index(self, s: Node) -> None:
        if self._taken(s):
            return
        t = self.table(s.schema, s.table)
        c = self.catalog_of(t)
        for e, _ in s.columns:
            Lowering(self).expr(e, Scope(_cols(t)))
        c.indexes[s.name.lower()] = cat.Index(s.name, t.name, s.unique, s.columns, s.where, s.text)
        if s.unique:
            try:
                self._changer.duplicates(t, t.df)
            except ConstraintError:
                del c.indexes[s.name.lower()]
                raise

    def _create_trigger(self, s: Node) -> None:
        c = self._schema(s.schema)
        if s.name.lower() in c.triggers:
            if s.exists:
                return
            raise SqlError(f"trigger {s.name} already exists", "exists")
        if s.table.lower() not in c.tables and s.table.lower() not in c.views:
            raise SqlError(f"no such table: {s.table}", "name")
        c.triggers[s.name.lower()] = cat.Trigger(s.name, s, s.text)

    def _create_virtual(self, s: Node) -> None:
        if self._taken(s):
            return
        plain, options = [], {}
        for a in s.args:
            if "=" in a and not a.lstrip().startswith(("'", '"')):
                k, x = a.split("=", 1)
                options[k.strip().lower()] = x.strip().strip("'\"")
            else:
                plain.append(a.split()[0].strip("'\"`[]"))
        if s.module in ("fts3", "fts4", "fts5"):
            tokenize = options.get("tokenize", "unicode61" if s.module == "fts5" else "ascii")
            tokenize = {"simple": "ascii"}.get(tokenize.split()[0], tokenize)
            if tokenize.split()[0] not in ("unicode61", "ascii", "porter", "trigram"):
                raise SqlError(f"no such tokenizer: {tokenize}", "name")
            cols = [cat.Col(n, "", "text", "TEXT") for n in plain or ["content"]]
            t = cat.Table(s.name, cols, sql=s.text, fts={"columns": [c.name for c in cols], "tokenize": tokenize, "options": options})
            source = options.get("content")
            if source and s.module == "fts5" and self.is_table(source):
                src = self.table(None, source)
                t.fts["content"] = source
                key = options.get("content_rowid")
                rowid = v.ident(key) if key else "__rowid" if not src.external else "monotonically_increasing_id()"
                df = self.spark.sql(f"SELECT CAST({rowid} AS BIGINT) AS __rowid, {', '.join(v.ident(c.name) for c in cols)} FROM {src.view}")
                cat.publish(t, df)
            else:
                cat.publish(t, cat.empty(self.spark, t))
        elif s.module in ("rtree", "rtree_i32"):
            kind = "real" if s.module == "rtree" else "int"
            cols = [cat.Col(n.lstrip("+"), "INTEGER" if i == 0 else "REAL" if kind == "real" else "INT", "int" if i == 0 else kind, "INTEGER" if i == 0 else "REAL" if kind == "real" else "INTEGER") for i, n in enumerate(plain)]
            t = cat.Table(s.name, cols, sql=s.text, rowid_column=cols[0].name, rtree=True)
            pairs = [c.name for c in cols[1:]]
            for lo, hi in zip(pairs[::2], pairs[1::2]):
                t.checks.append((("bin", "<=", ("col", None, lo), ("col", None, hi)), f"{s.name}.({lo}<={hi})"))
            cat.publish(t, cat.empty(self.spark, t))
        elif s.module == "fts5vocab":
            src = self.table(None, plain[-2] if len(plain) > 2 else plain[0])
            from larkspur.functions import fts

            mode = plain[-1].lower() if len(plain) > 1 else "row"
            columns = ", ".join(f"struct({v.quote(c)} AS col, {fts.token_array(v.ident(c), src.fts['tokenize'])} AS terms)" for c in src.fts["columns"])
            found = f"SELECT __rowid, x.col AS col, posexplode(x.terms) AS (offset, term) FROM (SELECT __rowid, explode(array({columns})) AS x FROM {src.view})"
            shown = {
                "row": "SELECT term, count(DISTINCT __rowid) AS doc, count(*) AS cnt FROM {} GROUP BY term",
                "col": "SELECT term, col, count(DISTINCT __rowid) AS doc, count(*) AS cnt FROM {} GROUP BY term, col",
                "instance": "SELECT term, __rowid AS doc, col, CAST(offset AS BIGINT) AS offset FROM {}",
            }
            if mode not in shown:
                raise SqlError(f"fts5vocab: unknown table type: {mode!r}", "error")
            t = cat.external(s.name, self.spark.sql(shown[mode].format(f"({found})")))
            t.sql = s.text
        elif s.module in ("dbstat", "bytecode", "tables_used", "fts3tokenize", "fts4aux"):
            fields = {"dbstat": "name string, path string, pageno bigint, pagetype string, ncell bigint, payload bigint, unused bigint, mx_payload bigint, pgoffset bigint, pgsize bigint, schema string"}
            rows = []
            if s.module == "dbstat":
                for i, t in enumerate(x for x in self.catalog.tables.values() if not x.external):
                    rows.append((t.name, "/", i + 1, "leaf", t.df.count(), 0, 0, 0, 4096 * i, 4096, "main"))
            t = cat.external(s.name, self.spark.createDataFrame(rows, fields.get(s.module, "token string")))
            t.sql = s.text
        else:
            raise SqlError(f"no such module: {s.module}", "name")
        self._schema(s.schema).tables[s.name.lower()] = t

    def _fts_command(self, t: cat.Table, s: Node) -> None:
        word = s.source.arms[0][1].values[0][0][1] if s.source and s.source.arms[0][1].values else None
        if word == "delete-all":
            cat.publish(t, t.df.limit(0))
        elif word not in ("optimize", "rebuild", "integrity-check", "automerge", "merge", "delete"):
            raise SqlError(f"unknown command: {word}", "error")
        return None

    def _drop(self, s: Node) -> None:
        c = self._schema(s.schema)
        names = {"table": c.tables, "view": c.views, "index": c.indexes, "trigger": c.triggers}.get(s.what)
        if names is None:
            raise SqlError(f'near "{s.what}": syntax error', "syntax")
        if s.name.lower() not in names:
            if s.exists:
                return
            raise SqlError(f"no such {s.what}: {s.name}", "name")
        if s.what == "table" and self.foreign_keys and not names[s.name.lower()].external:
            t = names[s.name.lower()]
            self._changer.foreign_in(t, t.df, None)
        del names[s.name.lower()]
        if s.what in ("table", "view"):
            c.triggers = {k: x for k, x in c.triggers.items() if x.node.table.lower() != s.name.lower()}
            c.indexes = {k: x for k, x in c.indexes.items() if x.table.lower() != s.name.lower()}

    def _alter(self, s: Node) -> None:
        t = self.table(s.schema, s.table)
        c = self.catalog_of(t)
        if s.action == "rename":
            if s.to.lower() in c.tables or s.to.lower() in c.views:
                raise SqlError(f"there is already another table or index with this name: {s.to}", "exists")
            del c.tables[t.name.lower()]
            for x in c.indexes.values():
                x.table = s.to if x.table.lower() == t.name.lower() else x.table
            for x in c.triggers.values():
                x.node.table = s.to if x.node.table.lower() == t.name.lower() else x.node.table
            for other in c.tables.values():
                for f in other.foreigns:
                    f.parent = s.to if f.parent.lower() == t.name.lower() else f.parent
            t.sql = t.sql.replace(t.name, f'"{s.to}"', 1)
            t.name = s.to
            c.tables[s.to.lower()] = t
        elif s.action == "rename_column":
            col = t.col(s.column)
            cat.publish(t, t.df.withColumnRenamed(col.name, s.to))
            for k in t.keys:
                k.columns = [s.to if x.lower() == col.name.lower() else x for x in k.columns]
            for f in t.foreigns:
                f.columns = [s.to if x.lower() == col.name.lower() else x for x in f.columns]
            if t.rowid_column == col.name:
                t.rowid_column = s.to
            old = col.name.lower()
            t.checks = [(_renamed(e, old, s.to), text) for e, text in t.checks]
            for x in c.indexes.values():
                if x.table.lower() == t.name.lower():
                    x.columns = [(_renamed(e, old, s.to), d) for e, d in x.columns]
            col.name = s.to
        elif s.action == "add":
            d = s.column
            if any(x.name.lower() == d.name.lower() for x in t.columns):
                raise SqlError(f"duplicate column name: {d.name}", "schema")
            if d.primary or d.unique:
                raise SqlError(f"Cannot add a {'PRIMARY KEY' if d.primary else 'UNIQUE'} column", "schema")
            if d.notnull and d.default is None and t.df.limit(1).count():
                raise SqlError("Cannot add a NOT NULL column with default value NULL", "schema")
            aff = v.affinity(d.type)
            e = Lowering(self).expr(d.default, Scope([])) if d.default is not None else v.literal(None)
            kind = {"INTEGER": "int", "TEXT": "text", "REAL": "real"}.get(aff, e.t)
            col = cat.Col(d.name, d.type or "", kind, aff if d.type else "", d.collation or "", bool(d.notnull), 0, d.default, d.default_text, d.generated, bool(d.stored))
            t.columns.append(col)
            cat.publish(t, t.df.selectExpr("*", f"CAST({v.cast_to(e, kind)} AS {v.spark_type(kind)}) AS {v.ident(d.name)}"))
            if d.generated is not None:
                cat.publish(t, cat.settle(self.spark, self._changer.generate(t, t.df)))
            if d.foreign:
                t.foreigns.append(self._foreign(d.foreign))
        else:
            col = t.col(s.column)
            if col.pk or any(col.name.lower() in [x.lower() for x in k.columns] for k in c.keys(t)) or len(t.columns) == 1:
                raise SqlError(f"cannot drop column \"{col.name}\"", "schema")
            t.columns.remove(col)
            cat.publish(t, t.df.drop(col.name))


def _renamed(e, old: str, new: str):
    if isinstance(e, tuple):
        if e[:1] == ("col",) and e[2].lower() == old:
            return (*e[:2], new, *e[3:])
        return tuple(_renamed(x, old, new) for x in e)
    return e


def _cols(t: cat.Table):
    from larkspur.operators.changes import columns_of

    return columns_of(t, t.view, t.name)


class Snapshot:
    """A frozen state of a database. encode() writes it as a folder of Parquet and one catalog file."""

    def __init__(self, db: Database, catalog: cat.Catalog):
        self._db, self._catalog = db, catalog

    def open(self) -> Database:
        out = Database(self._db.spark, self._db.seed, self._db.now)
        out.catalog = self._catalog.copy()
        return out

    def encode(self, folder: str) -> str:
        spark, items = self._db.spark, {"tables": [], "sql": [], "pragmas": self._catalog.pragmas}
        for i, t in enumerate(self._catalog.tables.values()):
            if t.external:
                continue
            t.df.write.mode("overwrite").parquet(f"{folder}/t{i}")
            items["tables"].append({"name": t.name, "sql": t.sql, "path": f"t{i}", "last_rowid": t.last_rowid, "columns": [[c.name, c.t] for c in t.columns]})
        for group in (self._catalog.views, self._catalog.indexes, self._catalog.triggers):
            items["sql"] += [x.sql for x in group.values()]
        spark.createDataFrame([(json.dumps(items),)], "catalog string").coalesce(1).write.mode("overwrite").text(f"{folder}/catalog")
        return folder

    @staticmethod
    def decode(spark: SparkSession, folder: str) -> Snapshot:
        items = json.loads(spark.read.text(f"{folder}/catalog").first()[0])
        db = Database(spark)
        for x in items["tables"]:
            if " AS SELECT" in x["sql"].upper().replace("\n", " ") or not x["sql"]:
                db.catalog.tables[x["name"].lower()] = cat.Table(x["name"], [cat.Col(n, t=k) for n, k in x["columns"]], sql=x["sql"])
            else:
                db.exec(x["sql"])
            t = db.catalog.tables[x["name"].lower()]
            for c, (_, k) in zip(t.columns, x["columns"]):
                c.t = k
            t.last_rowid = x["last_rowid"]
            cat.publish(t, spark.read.parquet(f"{folder}/{x['path']}"))
        for sql in items["sql"]:
            db.exec(sql)
        db.catalog.pragmas = items["pragmas"]
        return Snapshot(db, db.catalog.copy())


__all__ = ["Database", "RunResult", "Snapshot", "Statement", "SqlError", "ConstraintError", "E"]
