"""INSERT, UPDATE and DELETE as set operations on the rows of a table.

The rows to add or change are computed first, as one DataFrame, then checked as a set, and the table gets its new rows at the end, so a
failed statement leaves everything as it was. Where one row of a statement must see what an earlier one did (UPSERT of one key
twice) the rows go in rounds. Triggers and the actions of foreign keys run on the driver, over the statement's rows.
"""

from __future__ import annotations

import itertools

from larkspur.errors import ConstraintError, SqlError
from larkspur.functions import values as v
from larkspur.functions.values import E, ident
from larkspur.plans.lower import Column, Lowering, Scope
from larkspur.plans.parser import Node
from larkspur.operators.recursion import size_of
from larkspur.sources.catalog import Key, Table, append, publish, settle
from pyspark.sql import DataFrame

_names = itertools.count()
MOST_TRIGGERS = 1000


class _Ignore(Exception):
    """RAISE(IGNORE)."""


def view_of(df: DataFrame) -> str:
    name = f"d{next(_names)}"
    df.createOrReplaceTempView(name)
    return name


def columns_of(t: Table, alias: str, shown: str) -> list[Column]:
    out = [Column(c.name, E(f"{alias}.{ident(c.name)}", c.t, c.aff, c.coll), shown) for c in t.columns]
    return [*out, Column("__rowid", E(f"{alias}.__rowid", "int", "INTEGER"), shown)]


def stored(e: E, aff: str) -> tuple[str, str]:
    """(class, SQL) of a value put into a column of this affinity, as far as the class shows it."""
    if e.t == "null":
        return "null", "NULL"
    if aff == "TEXT" and e.t in ("int", "real", "bool", "ts", "any"):
        return "text", v.text(e)
    if aff in ("INTEGER", "NUMERIC") and e.t == "real":
        if e.const is not v.MISSING and float(e.const).is_integer():
            return "int", v.literal(int(e.const)).sql
        return "real", e.sql
    if aff == "REAL" and e.t in ("int", "bool"):
        return "real", v.real(e)
    if aff in ("INTEGER", "NUMERIC", "REAL") and e.t in ("text", "any"):
        if isinstance(e.const, str):
            if v.NUMERIC.match(e.const):
                n = v.number(e)
                return stored(n, aff)
            return "text", e.sql
        return "text?", e.sql
    return {"bool": "int", "ts": "text", "any": "text"}.get(e.t, e.t), v.value(e)


class Changes:
    """Changes to one database's tables."""

    def __init__(self, db):
        self.db, self.spark, self.depth = db, db.spark, 0

    # -- shared steps
    def widen(self, t: Table, types: list[str]) -> None:
        """Brings a table's columns to classes that hold the new values too."""
        casts, change = ["__rowid"], False
        for c, new in zip(t.columns, types):
            both = v.unify([c.t, new])
            if both != c.t:
                if t.strict and c.t not in ("null",):
                    raise ConstraintError(f"cannot store {new.upper()} value in {c.declared} column {t.name}.{c.name}", "datatype")
                change = True
                casts.append(f"{v.cast_to(E(ident(c.name), c.t), both)} AS {ident(c.name)}")
                c.t = both
            else:
                casts.append(ident(c.name))
        if change:
            publish(t, t.df.selectExpr(*casts))

    def fit(self, t: Table, rel_sql: str, exprs: list[E], extra: list[str]) -> DataFrame:
        """Rows of the table's classes from expressions over rel_sql; text that is a number is stored as one where the column wants it."""
        kinds, sqls = [], []
        for c, e in zip(t.columns, exprs):
            k, s = stored(e, c.aff)
            kinds.append(k)
            sqls.append(s)
        unsure = [i for i, k in enumerate(kinds) if k == "text?"]
        if unsure:
            bad = ", ".join(f"count_if({sqls[i]} IS NOT NULL AND try_cast({sqls[i]} AS DOUBLE) IS NULL) AS b{i}, count_if(try_cast({sqls[i]} AS DOUBLE) <> floor(try_cast({sqls[i]} AS DOUBLE))) AS r{i}" for i in unsure)
            row = self.spark.sql(f"SELECT {bad} FROM {rel_sql}").first()
            for i in unsure:
                kinds[i] = "text" if row[f"b{i}"] else "real" if row[f"r{i}"] or t.columns[i].aff == "REAL" else "int"
                if kinds[i] != "text":
                    sqls[i] = f"CAST(try_cast({sqls[i]} AS DOUBLE) AS {v.spark_type(kinds[i])})"
        if t.strict:
            for c, k in zip(t.columns, kinds):
                want = {"INTEGER": "int", "TEXT": "text", "REAL": "real", "BLOB": "blob"}.get("ANY" if c.declared.upper() == "ANY" else c.aff)
                if want and k not in ("null", want) and not (want == "real" and k == "int"):
                    raise ConstraintError(f"cannot store {k.upper()} value in {c.declared.upper()} column {t.name}.{c.name}", "datatype")
        self.widen(t, [k if k != "null" else "null" for k in kinds])
        out = [f"CAST({v.cast_to(E(s, k if k != 'null' else 'null'), c.t)} AS {v.spark_type(c.t)}) AS {ident(c.name)}" for c, k, s in zip(t.columns, kinds, sqls)]
        return self.spark.sql(f"SELECT {', '.join([*extra, *out])} FROM {rel_sql}")

    def generate(self, t: Table, df: DataFrame) -> DataFrame:
        """Fills generated columns in."""
        for c in t.columns:
            if c.generated is not None:
                view = view_of(df)
                e = Lowering(self.db).expr(c.generated, Scope(columns_of(t, view, t.name)))
                k, s = stored(e, c.aff)
                k = "text" if k == "text?" else k
                if c.t == "null":
                    c.t = k
                    publish(t, t.df.selectExpr(*[f"CAST({ident(x)} AS {v.spark_type(k)}) AS {ident(x)}" if x == c.name else ident(x) for x in t.df.columns]))
                rest = ", ".join(ident(x) for x in df.columns if x != c.name)
                order = [x for x in df.columns]
                df = self.spark.sql(f"SELECT {rest}, CAST({v.cast_to(E(s, k), c.t)} AS {v.spark_type(c.t)}) AS {ident(c.name)} FROM {view}").select(*[ident(x) for x in order])
        return df

    def check(self, t: Table, df: DataFrame, ignore: bool) -> DataFrame:
        """NOT NULL and CHECK; with ignore the rows that fail are left out."""
        tests, messages = [], []
        for c in t.columns:
            if c.notnull and c.name != t.rowid_column:
                tests.append(f"{ident(c.name)} IS NOT NULL")
                messages.append((f"NOT NULL constraint failed: {t.name}.{c.name}", "notnull"))
        if t.checks:
            view = view_of(df)
            for e, text in t.checks:
                tests.append(f"coalesce({v.truth(Lowering(self.db).expr(e, Scope(columns_of(t, view, t.name))))}, TRUE)".replace(f"{view}.", ""))
                messages.append((f"CHECK constraint failed: {text}", "check"))
        if not tests:
            return df
        view = view_of(df)
        if ignore:
            return self.spark.sql(f"SELECT * FROM {view} WHERE {' AND '.join(tests)}")
        row = self.spark.sql("SELECT " + ", ".join(f"count_if(NOT ({x})) AS f{i}" for i, x in enumerate(tests)) + f" FROM {view}").first()
        for i, (message, kind) in enumerate(messages):
            if row[f"f{i}"]:
                raise ConstraintError(message, kind)
        return df

    def key_sql(self, t: Table, key: Key, alias: str) -> tuple[list[str], str]:
        """The parts of a key over an alias, and the condition under which a row takes part."""
        scope = Scope(columns_of(t, alias, t.name))
        if key.exprs is not None:
            es = [Lowering(self.db).expr(e, scope) for e in key.exprs]
        else:
            es = [scope.find(None, c) for c in key.columns]
        parts = [v.collate(e.sql, e.coll) if e.t in ("text", "any") else v.value(e) for e in es]
        cond = " AND ".join(f"{p} IS NOT NULL" for p in parts)
        if key.where is not None:
            cond += f" AND {v.truth(Lowering(self.db).expr(key.where, scope))}"
        return parts, cond

    def all_keys(self, t: Table) -> list[Key]:
        rowid = [Key(["__rowid"], None, None, origin="rowid")] if t.rowid_column else []
        return [*rowid, *self.db.catalog_of(t).keys(t)]

    def clash(self, t: Table, key: Key, a: str, b: str) -> str:
        (p, c), (q, d) = self.key_sql(t, key, a), self.key_sql(t, key, b)
        return " AND ".join([*(f"{x} = {y}" for x, y in zip(p, q)), c, d])

    def unique_error(self, t: Table, key: Key) -> ConstraintError:
        names = [t.rowid_column if c == "__rowid" else c for c in key.columns]
        if key.exprs is not None and key.name:
            return ConstraintError(f"UNIQUE constraint failed: index '{key.name}'", "unique")
        return ConstraintError("UNIQUE constraint failed: " + ", ".join(f"{t.name}.{c}" for c in names), "primarykey" if key.origin in ("pk", "rowid") else "unique")

    def duplicates(self, t: Table, df: DataFrame) -> None:
        """Raises if two rows agree in a key."""
        for key in self.all_keys(t):
            view = view_of(df)
            parts, cond = self.key_sql(t, key, view)
            again = self.spark.sql(f"SELECT 1 FROM {view} WHERE {cond} GROUP BY {', '.join(parts)} HAVING count(*) > 1 LIMIT 1")
            if again.count():
                raise self.unique_error(t, key)

    # -- INSERT
    def insert(self, s: Node, outer: Scope | None = None, params=None) -> tuple[int, DataFrame | None]:
        t = self.db.table(s.schema, s.table)
        if t.external:
            raise SqlError(f"table {t.name} may not be modified", "readonly")
        names = s.columns or [c.name for c in t.columns if c.generated is None]
        low = Lowering(self.db, params)
        if s.ctes:
            low.with_clause(s.ctes, None)
        if s.source is None:
            body, given, names = "(SELECT 1)", {}, []
        elif len(s.source.arms) == 1 and s.source.arms[0][1].values and not s.source.ctes and not any(e[0] in ("sub",) for r in s.source.arms[0][1].values for e in r):
            return self._insert_values(s, t, names, s.source.arms[0][1].values, low, outer)
        else:
            rel = low.query(s.source, outer)
            if len(rel.columns) != len(names):
                raise SqlError(f"table {t.name} has {len(names)} columns but {len(rel.columns)} values were supplied" if not s.columns else f"{len(rel.columns)} values for {len(names)} columns")
            body, given = f"({rel.sql})", {n.lower(): c.e._replace(sql=f"c{i}") for i, (n, c) in enumerate(zip(names, rel.columns))}
        return self._insert_rows(s, t, body, given, low)

    def _insert_values(self, s, t, names, rows, low, outer):
        """VALUES keep the class of each value, so a column sees numbers and text apart."""
        total, returned = 0, []
        es = [[low.expr(e, Scope([], outer)) for e in r] for r in rows]
        for r in es:
            if len(r) != len(names):
                raise SqlError(f"table {t.name} has {len(names)} columns but {len(r)} values were supplied" if not s.columns else f"{len(r)} values for {len(names)} columns")
        kinds = []
        for i, n in enumerate(names):
            aff = "INTEGER" if n.lower() in ("rowid", "_rowid_", "oid") and not any(c.name.lower() == n.lower() for c in t.columns) else t.col(n).aff
            pairs = [stored(r[i], aff) for r in es]
            kind = v.unify([("text" if k == "text?" else k) for k, _ in pairs])
            for r, (k, q) in zip(es, pairs):
                r[i] = v.cast_to(E(q, "text" if k == "text?" else k, const=r[i].const if k in ("int", "real") and isinstance(r[i].const, (int, float)) else v.MISSING), kind)
            kinds.append(kind)
        body = "(SELECT * FROM VALUES " + ", ".join("(" + ", ".join([str(j), *r]) + ")" for j, r in enumerate(es)) + f" AS v(n, {', '.join(f'c{i}' for i in range(len(names)))}))"
        given = {n.lower(): E(f"c{i}", k) for i, (n, k) in enumerate(zip(names, kinds))}
        return self._insert_rows(s, t, body, given, low, "n")

    def _insert_rows(self, s, t, body, given, low, order="monotonically_increasing_id()"):
        for n in given:
            if n not in ("rowid", "_rowid_", "oid") and t.col(n).generated is not None:
                raise SqlError(f"cannot INSERT into generated column \"{n}\"", "generated")
        exprs, rowid = [], "CAST(NULL AS BIGINT)"
        for c in t.columns:
            if c.name.lower() in given:
                e = given[c.name.lower()]
                if c.name == t.rowid_column:
                    if e.t == "text":
                        raise ConstraintError("datatype mismatch", "mismatch")
                    rowid = v.integer(e)
            elif c.generated is not None or c.default is None:
                e = v.literal(None)
            else:
                e = Lowering(self.db).expr(c.default, Scope([]))
            exprs.append(e)
        for n in ("rowid", "_rowid_", "oid"):
            if n in given:
                rowid = v.integer(given[n])
        base = self.fit(t, body, exprs, [f"{rowid} AS __rowid", f"{order} AS __n"])
        view = view_of(base if order == "n" else settle(self.spark, base))
        top = max(t.last_rowid if t.autoincrement else 0, self.spark.sql(f"SELECT max(__rowid) AS m FROM {t.view}").first()["m"] or 0)
        alias = ident(t.rowid_column) if t.rowid_column else None
        # rows are numbered inside the tasks that made them, each task from where those before it end
        ends = f"(SELECT shiftright(__n, 33) AS __p, sum(count(*)) OVER (ORDER BY shiftright(__n, 33)) - count(*) AS __before FROM {view} WHERE __rowid IS NULL GROUP BY shiftright(__n, 33))"
        number = f"coalesce(__rowid, greatest({top}L, (SELECT coalesce(max(__rowid), 0L) FROM {view})) + __before + row_number() OVER (PARTITION BY shiftright(__n, 33), __rowid IS NULL ORDER BY __n))"
        if order == "n":  # the rows of VALUES are few
            number = f"coalesce(__rowid, greatest({top}L, coalesce(max(__rowid) OVER (), 0L)) + row_number() OVER (PARTITION BY __rowid IS NULL ORDER BY __n))"
        cols = ", ".join(f"{number} AS {ident(c.name)}" if c.name == t.rowid_column else ident(c.name) for c in t.columns)
        delta = settle(self.spark, self.spark.sql(f"SELECT __n, {number} AS __rowid, {cols} FROM {view}" + ("" if order == "n" else f" LEFT JOIN {ends} ON shiftright(__n, 33) = __p")))
        delta = self.generate(t, delta)
        if alias:
            t.col(t.rowid_column).t = "int"
        mode = s.conflict
        delta = self.fire(t, "BEFORE", "INSERT", None, delta)
        delta = self.check(t, delta, mode == "IGNORE")
        keys = self.all_keys(t)
        count, touched = 0, None
        if s.upsert is not None:
            count, touched = self.upsert(s, t, delta, keys, low)
        else:
            delta = self._resolve(t, delta, keys, mode)
            delta = settle(self.spark, delta)
            self.foreign_out(t, delta)
            rows = delta.drop("__n")
            rows.local_rows = getattr(delta, "local_rows", None)
            append(t, rows)
            count, touched = size_of(delta), delta
        if count:
            highest, self.db.last_insert_rowid = touched.selectExpr("max(__rowid)", "max_by(__rowid, __n)").first()
            t.last_rowid = max(t.last_rowid, highest or 0)
        self.fire(t, "AFTER", "INSERT", None, touched)
        return count, self.returning(s, t, touched)

    def _resolve(self, t, delta, keys, mode):
        """The rows that go in, after clashes among themselves and with the table."""
        if mode == "REPLACE":
            view = view_of(delta)
            for key in keys:
                parts, cond = self.key_sql(t, key, view)
                delta = self.spark.sql(f"SELECT * EXCEPT (__r) FROM (SELECT {view}.*, row_number() OVER (PARTITION BY {', '.join(parts)}, CASE WHEN {cond} THEN NULL ELSE __n END ORDER BY __n DESC) AS __r FROM {view}) WHERE __r = 1")
                view = view_of(delta)
            delta = settle(self.spark, delta)
            view = view_of(delta)
            for key in keys:
                old = self.spark.sql(f"SELECT o.* FROM {t.view} o LEFT SEMI JOIN {view} n ON {self.clash(t, key, 'o', 'n')}")
                gone = settle(self.spark, old)
                if gone.count():
                    self.foreign_in(t, gone, None)
                    ids = view_of(gone)
                    publish(t, self.spark.sql(f"SELECT o.* FROM {t.view} o LEFT ANTI JOIN {ids} n ON o.__rowid = n.__rowid"))
            return delta
        for key in keys:
            ignore = mode == "IGNORE" or (mode == "ABORT" and key.conflict == "IGNORE")
            view = view_of(delta)
            parts, cond = self.key_sql(t, key, view)
            if ignore:
                first = f"SELECT * EXCEPT (__r) FROM (SELECT {view}.*, row_number() OVER (PARTITION BY {', '.join(parts)}, CASE WHEN {cond} THEN NULL ELSE __n END ORDER BY __n) AS __r FROM {view}) WHERE __r = 1"
                delta = self.spark.sql(f"SELECT n.* FROM ({first}) n LEFT ANTI JOIN {t.view} o ON {self.clash(t, key, 'o', 'n')}")
            else:
                again = self.spark.sql(f"SELECT 1 FROM {view} WHERE {cond} GROUP BY {', '.join(parts)} HAVING count(*) > 1 LIMIT 1").count()
                if again or self.spark.sql(f"SELECT 1 FROM {view} n LEFT SEMI JOIN {t.view} o ON {self.clash(t, key, 'o', 'n')} LIMIT 1").count():
                    raise self.unique_error(t, key)
        return delta

    def upsert(self, s, t, delta, keys, low):
        u = s.upsert
        if u.target is None:
            targets = keys
        else:
            want = sorted(e[2].lower() if e[0] == "col" else repr(e) for e in u.target)
            targets = [k for k in keys if sorted((t.rowid_column if c == "__rowid" else c).lower() for c in k.columns) == want or (k.exprs is not None and sorted(e[2].lower() if e[0] == "col" else repr(e) for e in k.exprs) == want)]
            if not targets:
                raise SqlError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint", "syntax")
        if u.set is None:
            rest = [k for k in keys if k not in targets]
            delta = self._resolve(t, delta, targets, "IGNORE")
            delta = settle(self.spark, self._resolve(t, delta, rest, s.conflict))
            self.foreign_out(t, delta)
            publish(t, settle(self.spark, t.df.unionByName(delta.drop("__n"))))
            return delta.count(), delta
        key, count, touched = targets[0], 0, []
        view = view_of(delta)
        parts, _ = self.key_sql(t, key, view)
        turn = settle(self.spark, self.spark.sql(f"SELECT {view}.*, row_number() OVER (PARTITION BY {', '.join(parts)} ORDER BY __n) AS __turn FROM {view}"))
        for k in range(1, (turn.selectExpr("max(__turn)").first()[0] or 0) + 1):
            part = view_of(turn.where(f"__turn = {k}").drop("__turn"))
            clash = self.clash(t, key, "o", "n")
            fresh = self.spark.sql(f"SELECT n.* FROM {part} n LEFT ANTI JOIN {t.view} o ON {clash}")
            fresh = settle(self.spark, self._resolve(t, fresh, [x for x in keys if x is not key], s.conflict))
            scope = Scope([*columns_of(t, "o", s.alias or t.name), *(c._replace(table="excluded", hidden=True) for c in columns_of(t, "n", "excluded"))])
            where = f" WHERE {v.truth(low.expr(u.set_where, scope))}" if u.set_where is not None else ""
            new = {c.lower(): low.expr(e, scope) for c, e in u.set}
            exprs = [new.get(c.name.lower(), E(f"o.{ident(c.name)}", c.t)) for c in t.columns]
            changed = self.fit(t, f"{t.view} o JOIN {part} n ON {clash}{where}", exprs, ["n.__n", "o.__rowid"])
            changed = settle(self.spark, self.generate(t, changed))
            self.check(t, changed, False)
            ids = view_of(changed)
            rest = self.spark.sql(f"SELECT o.* FROM {t.view} o LEFT ANTI JOIN {ids} n ON o.__rowid = n.__rowid")
            after = settle(self.spark, rest.unionByName(changed.drop("__n")).unionByName(fresh.drop("__n")))
            self.duplicates(t, after)
            publish(t, after)
            both = settle(self.spark, fresh.unionByName(changed))
            self.foreign_out(t, both)
            count += both.count()
            touched.append(both)
        out = touched[0] if touched else delta.limit(0)
        for x in touched[1:]:
            out = out.unionByName(x)
        return count, settle(self.spark, out)

    # -- UPDATE and DELETE
    def update(self, s: Node, outer: Scope | None = None, params=None) -> tuple[int, DataFrame | None]:
        t = self.db.table(s.schema, s.table)
        if t.external:
            raise SqlError(f"table {t.name} may not be modified", "readonly")
        low = Lowering(self.db, params)
        if s.ctes:
            low.with_clause(s.ctes, None)
        scope_cols, source = columns_of(t, "o", s.alias or t.name), f"{t.view} o"
        if s.source is not None:
            sql, cols, _ = low.source(s.source, outer)
            source, scope_cols = f"{source} CROSS JOIN {sql}", [*scope_cols, *(c._replace(hidden=c.name == "__rowid") for c in cols)]
        scope = Scope(scope_cols, outer)
        where = f" WHERE {v.truth(low.expr(s.where, scope))}" if s.where is not None else ""
        for c, _ in s.set:
            if t.col(c).generated is not None:
                raise SqlError(f"cannot UPDATE generated column \"{c}\"", "generated")
        new = {c.lower(): low.expr(e, scope) for c, e in s.set}
        exprs = [new.get(c.name.lower(), E(f"o.{ident(c.name)}", c.t, c.aff)) for c in t.columns]
        rowid = f"coalesce({v.integer(new[t.rowid_column.lower()])}, o.__rowid)" if t.rowid_column and t.rowid_column.lower() in new else "o.__rowid"
        changed = self.fit(t, f"{source}{where}", exprs, ["o.__rowid AS __old", f"{rowid} AS __rowid", "monotonically_increasing_id() AS __n"])
        if s.source is not None:  # the last source row wins
            view = view_of(changed)
            changed = self.spark.sql(f"SELECT * EXCEPT (__r) FROM (SELECT *, row_number() OVER (PARTITION BY __old ORDER BY __n DESC) AS __r FROM {view}) WHERE __r = 1")
        changed = settle(self.spark, self.generate(t, changed))
        changed = self.check(t, changed, s.conflict == "IGNORE")
        ids = view_of(changed)
        old = settle(self.spark, self.spark.sql(f"SELECT o.* FROM {t.view} o LEFT SEMI JOIN {ids} n ON o.__rowid = n.__old"))
        sets = [c.lower() for c, _ in s.set]
        changed = self.fire(t, "BEFORE", "UPDATE", old, changed, sets)
        ids = view_of(changed)
        rest = self.spark.sql(f"SELECT o.* FROM {t.view} o LEFT ANTI JOIN {ids} n ON o.__rowid = n.__old")
        plain = changed.drop("__n", "__old")
        if s.conflict == "REPLACE":
            n, r = view_of(plain), rest
            for key in self.all_keys(t):
                rv = view_of(r)
                r = self.spark.sql(f"SELECT o.* FROM {rv} o LEFT ANTI JOIN {n} n ON {self.clash(t, key, 'o', 'n')}")
            rest = r
        after = settle(self.spark, rest.unionByName(plain))
        if s.conflict == "IGNORE":
            try:
                self.duplicates(t, after)
            except ConstraintError:
                return 0, None
        else:
            self.duplicates(t, after)
        self.foreign_out(t, plain)
        publish(t, after)
        self.foreign_in(t, old, changed)
        self.fire(t, "AFTER", "UPDATE", old, changed, sets)
        return changed.count(), self.returning(s, t, changed)

    def delete(self, s: Node, outer: Scope | None = None, params=None) -> tuple[int, DataFrame | None]:
        t = self.db.table(s.schema, s.table)
        if t.external:
            raise SqlError(f"table {t.name} may not be modified", "readonly")
        low = Lowering(self.db, params)
        if s.ctes:
            low.with_clause(s.ctes, None)
        where = f" WHERE {v.truth(low.expr(s.where, Scope(columns_of(t, 'o', s.alias or t.name), outer)))}" if s.where is not None else ""
        gone = settle(self.spark, self.spark.sql(f"SELECT o.* FROM {t.view} o{where}"))
        gone = self.fire(t, "BEFORE", "DELETE", gone, None)
        ids = view_of(gone)
        publish(t, settle(self.spark, self.spark.sql(f"SELECT o.* FROM {t.view} o LEFT ANTI JOIN {ids} n ON o.__rowid = n.__rowid")))
        self.foreign_in(t, gone, None)
        self.fire(t, "AFTER", "DELETE", gone, None)
        return gone.count(), self.returning(s, t, gone)

    def returning(self, s: Node, t: Table, rows: DataFrame | None) -> DataFrame | None:
        if s.returning is None or rows is None:
            return None
        view = view_of(rows)
        scope = Scope(columns_of(t, view, s.alias or t.name))
        low = Lowering(self.db)
        items = [(n, e if isinstance(e, E) else low.expr(e, scope)) for n, e, _ in low.expand(s.returning, scope)]
        sql = f"SELECT {', '.join(f'{v.value(e)} AS c{i}' for i, (_, e) in enumerate(items))} FROM {view}"
        return self.spark.sql(sql).toDF(*[n for n, _ in items])

    # -- foreign keys
    def foreign_out(self, t: Table, rows: DataFrame) -> None:
        """Each new row must have its parents."""
        if not self.db.foreign_keys:
            return
        for f in t.foreigns:
            if f.deferred and self.db.in_transaction:
                continue
            p = self.db.table(None, f.parent)
            n = view_of(rows)
            missing = self.spark.sql(f"SELECT 1 FROM {n} n LEFT ANTI JOIN {p.view} o ON {self._tie(t, f, p, 'n', 'o')} WHERE {' AND '.join(f'n.{ident(c)} IS NOT NULL' for c in f.columns)} LIMIT 1")
            if p is t:
                both = view_of(t.df.unionByName(rows.select(*[ident(c) for c in t.df.columns])))
                missing = self.spark.sql(f"SELECT 1 FROM {n} n LEFT ANTI JOIN {both} o ON {self._tie(t, f, p, 'n', 'o')} WHERE {' AND '.join(f'n.{ident(c)} IS NOT NULL' for c in f.columns)} LIMIT 1")
            if missing.count():
                raise ConstraintError("FOREIGN KEY constraint failed", "foreignkey")

    def parents(self, f, p: Table) -> list[str]:
        return f.parent_columns or [c.name for c in sorted((c for c in p.columns if c.pk), key=lambda c: c.pk)]

    def _tie(self, t, f, p, child, parent) -> str:
        return " AND ".join(v.compare("=", E(f"{child}.{ident(c)}", t.col(c).t, t.col(c).aff), E(f"{parent}.{ident(q)}", p.col(q).t, p.col(q).aff)).sql for c, q in zip(f.columns, self.parents(f, p)))

    def foreign_in(self, p: Table, old: DataFrame, new: DataFrame | None) -> None:
        """Children of parent rows that are gone or have another key: the action of their constraint."""
        if not self.db.foreign_keys:
            return
        for t in list(self.db.catalog_of(p).tables.values()):
            for f in t.foreigns:
                if f.parent.lower() != p.name.lower():
                    continue
                cols = self.parents(f, p)
                ov = view_of(old)
                if new is None:
                    lost = ov
                else:
                    nv = view_of(new)
                    moved = " OR ".join(f"NOT (o.{ident(c)} <=> n.{ident(c)})" for c in cols)
                    lost = view_of(settle(self.spark, self.spark.sql(f"SELECT o.* FROM {ov} o JOIN {nv} n ON o.__rowid = n.__old WHERE {moved}")))
                hit = settle(self.spark, self.spark.sql(f"SELECT c.* FROM {t.view} c LEFT SEMI JOIN {lost} o ON {self._tie(t, f, p, 'c', 'o')}"))
                if not hit.count():
                    continue
                action = f.on_delete if new is None else f.on_update
                ids = view_of(hit)
                if action in ("RESTRICT", "NO ACTION"):
                    if action == "NO ACTION" and f.deferred and self.db.in_transaction:
                        continue
                    again = self.spark.sql(f"SELECT 1 FROM {ids} c LEFT ANTI JOIN {p.view} o ON {self._tie(t, f, p, 'c', 'o')} LIMIT 1")
                    if action == "RESTRICT" or again.count():
                        raise ConstraintError("FOREIGN KEY constraint failed", "foreignkey")
                    continue
                rest = self.spark.sql(f"SELECT c.* FROM {t.view} c LEFT ANTI JOIN {ids} n ON c.__rowid = n.__rowid")
                if action == "CASCADE" and new is None:
                    publish(t, settle(self.spark, rest))
                    self.foreign_in(t, hit, None)
                    self.fire(t, "AFTER", "DELETE", hit, None)
                    continue
                put = {}
                for c, q in zip(f.columns, cols):
                    if action == "SET NULL":
                        put[c.lower()] = f"CAST(NULL AS {v.spark_type(t.col(c).t)})"
                    elif action == "SET DEFAULT":
                        d = t.col(c).default
                        put[c.lower()] = v.cast_to(Lowering(self.db).expr(d, Scope([])) if d is not None else v.literal(None), t.col(c).t)
                    else:
                        put[c.lower()] = v.cast_to(E(f"n.{ident(q)}", p.col(q).t), t.col(c).t)
                cols_sql = ", ".join(f"{put.get(c.name.lower(), f'c.{ident(c.name)}')} AS {ident(c.name)}" for c in t.columns)
                join = f" JOIN {lost} o ON {self._tie(t, f, p, 'c', 'o')} JOIN {view_of(new)} n ON o.__rowid = n.__old" if action == "CASCADE" else ""
                changed = settle(self.spark, self.spark.sql(f"SELECT c.__rowid AS __old, c.__rowid, {cols_sql} FROM {ids} c{join}"))
                self.check(t, changed, False)
                publish(t, settle(self.spark, rest.unionByName(changed.drop("__old"))))
                if action == "SET DEFAULT":
                    self.foreign_out(t, changed.drop("__old"))
                self.foreign_in(t, hit, changed)

    # -- triggers
    def fire(self, t, when: str, event: str, old: DataFrame | None, new: DataFrame | None, sets: list[str] | None = None, view=None) -> DataFrame | None:
        """Runs the table's triggers for each row of the statement; returns the rows that go on (RAISE(IGNORE) drops one)."""
        rows = new if new is not None else old
        name = t.name.lower()
        found = [x for x in self.db.catalog_of(t).triggers.values() if x.node.table.lower() == name and x.node.when == when and x.node.event == event]
        found = [x for x in found if not x.node.columns or sets is None or any(c.lower() in sets for c in x.node.columns)]
        if not found or rows is None:
            return rows
        if self.depth >= MOST_TRIGGERS:
            raise SqlError("too many levels of trigger recursion", "limit")
        key = "__old" if new is not None and "__old" in new.columns else "__rowid"
        before = {r["__rowid"]: r for r in old.collect()} if old is not None else {}
        order = "__n" if "__n" in rows.columns else "__rowid"
        dropped = []
        self.depth += 1
        try:
            for r in rows.orderBy(order).collect():
                scope = []
                was = before.get(r[key]) if old is not None else None
                for label, row in (("old", was), ("new", r if new is not None else None)):
                    if row is not None:
                        scope += [Column(c.name, self._literal(row[c.name], c), label, True) for c in t.columns]
                        scope.append(Column("__rowid", v.literal(row["__rowid"]), label, True))
                outer = Scope(scope)
                try:
                    for x in found:
                        if x.node.cond is not None:
                            ok = self.spark.sql(f"SELECT {v.truth(Lowering(self.db).expr(x.node.cond, outer))} AS x").first()["x"]
                            if not ok:
                                continue
                        for b in x.node.body:
                            self.db.run_in_trigger(b, outer)
                except _Ignore:
                    dropped.append(r["__rowid"])
        finally:
            self.depth -= 1
        if dropped:
            return rows.where(~rows["__rowid"].isin(dropped))
        return rows

    @staticmethod
    def _literal(x, c) -> E:
        return v.literal(bytes(x) if isinstance(x, bytearray) else x)._replace(aff=c.aff, coll=c.coll)
