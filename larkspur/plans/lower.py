"""Lowers the dialect's SELECT to Spark SQL text, with names, classes and collations resolved here and the plan left to Catalyst.

Every source gets an alias of its own (s0, s1, ...) and every query result columns c0, c1, ...; the dialect's names live in Scope
and Rel. Constructs that Spark lacks are rewritten: GROUPS frames over a dense rank, EXCLUDE over collected frames, integer
division, row values, projected NOT IN, left-associative compounds, and recursive UNION as a fixpoint.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

from larkspur.errors import SqlError
from larkspur.functions import aggregates, scalars
from larkspur.functions import values as v
from larkspur.functions.values import MISSING, E, ident
from larkspur.plans.parser import Node

_ids = itertools.count()


def fresh(prefix: str) -> str:
    return f"{prefix}{next(_ids)}"


class Column(NamedTuple):
    name: str
    e: E
    table: str | None = None
    hidden: bool = False


class Rel(NamedTuple):
    """A query: Spark SQL whose columns are c0, c1, ..., and what the dialect knows of them."""

    sql: str
    columns: list[Column]


class Scope:
    def __init__(self, columns: list[Column], outer: Scope | None = None, fts: dict | None = None):
        self.columns, self.outer, self.fts = columns, outer, fts or {}

    def find(self, table: str | None, name: str, quoted: bool = False) -> E:
        low, scope = name.lower(), self
        while scope is not None:
            hits = [c for c in scope.columns if c.name.lower() == low and (table is None or (c.table or "").lower() == table.lower())]
            if table is None and len(hits) > 1:
                shown = [c for c in hits if not c.hidden]
                hits = shown or hits[:1]
                if len(hits) > 1:
                    raise SqlError(f"ambiguous column name: {name}", "name")
            if hits:
                return hits[0].e
            if low in ("rowid", "_rowid_", "oid"):
                hits = [c for c in scope.columns if c.name == "__rowid" and (table is None or (c.table or "").lower() == table.lower())]
                if hits:
                    return hits[0].e
            scope = scope.outer
        if quoted and table is None:
            return v.literal(name)
        raise SqlError(f"no such column: {table + '.' if table else ''}{name}", "name")


def walk(e, stop=()):
    """All nodes of an expression, without those inside subqueries."""
    if isinstance(e, tuple):
        if e and isinstance(e[0], str) and e[0] not in stop:
            yield e
        for x in e:
            if isinstance(x, (tuple, list)):
                yield from walk(x, stop)
            elif isinstance(x, Node) and x.kind != "select" and e[0] == "fn":
                for y in (x.filter, *(o[0] for o in x.order or ())):
                    if y:
                        yield from walk(y, stop)
                w = x.over
                if w:
                    for y in (*(w.partition or ()), *(o[0] for o in w.order or ())):
                        yield from walk(y, stop)
    elif isinstance(e, list):
        for x in e:
            yield from walk(x, stop)


def is_aggregate(n) -> bool:
    return n[0] == "fn" and not n[3].over and n[1] in aggregates.NAMES and not (n[1] in ("min", "max") and len(n[2]) > 1)


class Lowering:
    """One statement's lowering against a catalog. db answers for tables and session state; params for bound values."""

    def __init__(self, db, params=None):
        self.db, self.params = db, params
        self.ctes: list[dict[str, Rel]] = [{}]
        self.agg = None
        self.windows: dict | None = None  # named windows where a window function may stand
        self.ranks: dict[int, tuple[str, str]] = {}

    # -- queries
    def query(self, s: Node, outer: Scope | None = None, names: list[str] | None = None) -> Rel:
        saved, saved_agg, saved_windows = dict(self.ctes[-1]), self.agg, self.windows
        self.ctes.append(saved)
        self.agg = self.windows = None
        try:
            if s.ctes:
                self.with_clause(s.ctes, outer)
            return self.compound(s, outer)
        finally:
            self.ctes.pop()
            self.agg, self.windows = saved_agg, saved_windows

    def with_clause(self, ctes: Node, outer) -> None:
        for c in ctes.items:
            uses = ctes.recursive and _mentions(c.body, c.name)
            rel = self.recursive(c) if uses else self.query(c.body, outer)
            if c.columns:
                if len(c.columns) != len(rel.columns):
                    raise SqlError(f"table {c.name} has {len(rel.columns)} values for {len(c.columns)} columns")
                rel = Rel(rel.sql, [x._replace(name=n) for x, n in zip(rel.columns, c.columns)])
            self.ctes[-1][c.name.lower()] = rel

    def compound(self, s: Node, outer) -> Rel:
        if len(s.arms) == 1 and not s.arms[0][1].values:
            return self.core(s.arms[0][1], s, outer)
        arms = [(op, self.core(a, None, outer)) for op, a in s.arms]
        rel = self.set_chain(arms)
        if s.order or s.limit:
            alias = fresh("s")
            scope = Scope([Column(c.name, c.e._replace(sql=f"{alias}.c{i}")) for i, c in enumerate(rel.columns)], outer)
            order = [self.order_key(o, [x.e for x in scope.columns], [x.name for x in scope.columns], scope) for o in s.order]
            sql = f"SELECT * FROM ({rel.sql}) {alias}" + (f" ORDER BY {', '.join(order)}" if order else "") + self.limits(s)
            rel = Rel(sql, rel.columns)
        return rel

    def set_chain(self, arms: list[tuple[str | None, Rel]]) -> Rel:
        """Joins the arms from the left, each pair brought to common classes."""
        n = len(arms[0][1].columns)
        for op, r in arms:
            if len(r.columns) != n:
                raise SqlError(f"SELECTs to the left and right of {op} do not have the same number of result columns", "syntax")
        types = [v.unify([r.columns[i].e.t for _, r in arms]) for i in range(n)]
        sql = ""
        for op, r in arms:
            cast = [f"{v.cast_to(c.e._replace(sql=f'c{i}'), t)} AS c{i}" for i, (c, t) in enumerate(zip(r.columns, types))]
            arm = f"SELECT {', '.join(cast)} FROM ({r.sql})"
            sql = f"({arm})" if op is None else f"({sql} {op} ({arm}))"
        cols = [Column(c.name, E(f"c{i}", t, coll=c.e.coll)) for i, (c, t) in enumerate(zip(arms[0][1].columns, types))]
        return Rel(f"SELECT * FROM {sql}", cols)

    def constant(self, e, what: str):
        x = self.expr(e, Scope([]))
        if x.const is MISSING:
            rows = self.db.spark.sql(f"SELECT {v.value(x)} AS x").collect()
            return rows[0]["x"]
        return x.const

    def limits(self, s: Node) -> str:
        out = ""
        for word, e in (("LIMIT", s.limit), ("OFFSET", s.offset)):
            if e is not None:
                n = self.constant(e, word)
                if isinstance(n, str) and v.NUMERIC.match(n):
                    n = float(n)
                if n is None or isinstance(n, (str, bytes)) or n != int(n):
                    raise SqlError("datatype mismatch", "mismatch")
                n = int(n)
                if n >= 0 and not (word == "OFFSET" and n == 0):
                    out += f" {word} {n}"
        return out

    def values(self, rows: list, outer) -> Rel:
        lowered = [[self.expr(e, Scope([], outer)) for e in row] for row in rows]
        types = [v.unify([r[i].t for r in lowered]) for i in range(len(lowered[0]))]
        body = ", ".join("(" + ", ".join(v.cast_to(e, t) for e, t in zip(r, types)) + ")" for r in lowered)
        cols = ", ".join(f"c{i}" for i in range(len(types)))
        return Rel(f"SELECT * FROM VALUES {body} AS v({cols})", [Column(f"column{i + 1}", E(f"c{i}", t)) for i, t in enumerate(types)])

    def core(self, c: Node, whole: Node | None, outer) -> Rel:
        if c.values:
            return self.values(c.values, outer)
        if c.source is not None:
            source, cols, fts = self.source(c.source, outer)
            scope = Scope(cols, outer, fts)
        else:
            source, scope = None, Scope([], outer)
        where = f" WHERE {self.condition(c.where, scope)}" if c.where else ""
        items = self.expand(c.items, scope)
        order = whole.order if whole is not None else []
        aliases = {n.lower(): e for n, e, given in items if given and not isinstance(e, E)}
        having = self._aliased(c.having, aliases, scope) if c.having else None
        group = [self._group_item(g, items, aliases) for g in c.group]
        asked = [e for _, e, _ in items if not isinstance(e, E)] + ([having] if having else []) + [o[0] for o in order]
        grouped = bool(group) or any(is_aggregate(n) for e in asked for n in walk(e)) or c.having is not None
        special = [n[3].over for e in asked for n in walk(e) if n[0] == "fn" and n[3].over]
        special = [w for w in (self.window_spec(x, c.windows) for x in special) if w.frame and (w.frame.mode == "GROUPS" or w.frame.exclude)]
        if special and not grouped:
            source, scope, where, items = self._flatten(source, scope, where, items, special, c)
        keys = []
        if grouped:
            for g in group:
                e = self.expr(g, scope)
                keys.append(v.collate(v.value(e), e.coll) if e.t in ("text", "any") else v.value(e))
            mins = {(n[1], n[2]) for e in asked for n in walk(e) if is_aggregate(n) and n[1] in ("min", "max") and n[2]}
            pick = None
            if len(mins) == 1:
                (f, args), = mins
                pick = f, v.value(self.expr(args[0], scope))
            self.agg = Node(keys=set(keys), pick=pick)
        self.windows = c.windows or {}
        out, names = [], []
        for name, e, _ in items:
            x = e if isinstance(e, E) and not grouped else self._bare(e) if isinstance(e, E) else self.expr(e, scope)
            out.append(x)
            names.append(name)
        select = ", ".join(f"{v.value(x)} AS c{i}" for i, x in enumerate(out)) or "1"
        sql = f"SELECT {'DISTINCT ' if c.distinct and not any(x.coll not in ('', 'BINARY') for x in out) else ''}{select}" + (f" FROM {source}" if source else "") + where
        if keys:
            sql += f" GROUP BY {', '.join(dict.fromkeys(keys))}"
        elif grouped and having is not None and not any(is_aggregate(n) for e in asked for n in walk(e)):
            sql += " GROUP BY ()" if source else ""
        if having is not None:
            sql += f" HAVING {v.truth(self.expr(having, scope))}"
        cols = [Column(n, E(f"c{i}", {"bool": "int", "ts": "text"}.get(x.t, x.t), x.aff, x.coll, json=x.json)) for i, (n, x) in enumerate(zip(names, out))]
        if c.distinct and any(x.coll not in ("", "BINARY") for x in out):
            by = ", ".join(v.collate(f"c{i}", x.coll) if x.t == "text" else f"c{i}" for i, x in enumerate(out))
            sql = f"SELECT {', '.join(f'first(c{i}) AS c{i}' for i in range(len(out)))} FROM ({sql}) GROUP BY {by}"
        if order:
            # an output column stands for itself; any other expression is over the source
            named = [E(f"c{i}", c_.e.t, c_.e.aff, c_.e.coll) for i, c_ in enumerate(cols)]
            # Spark numbers a correlated subquery's rows by the sort right below its limit, so keys that are no output become columns there
            beside = [] if outer is not None and not c.distinct and (whole.limit is not None or whole.offset is not None) else None
            by = ", ".join(self.order_key(o, named, names, scope, items, beside) for o in order)
            if beside:
                sql = f"SELECT * FROM (SELECT {', '.join(beside)}, {sql.removeprefix('SELECT ')})"
            sql += f" ORDER BY {by}"
        if whole is not None:
            sql += self.limits(whole)
        if order and beside:
            sql = f"SELECT {', '.join(f'c{i}' for i in range(len(out)))} FROM ({sql})"
        self.agg = None
        return Rel(sql, cols)

    def condition(self, e, scope: Scope) -> str:
        """A filter. IN and NOT IN over a query become Spark's own forms where they stand alone, which join null-aware."""
        if e[0] == "bin" and e[1] == "AND":
            return f"({self.condition(e[2], scope)} AND {self.condition(e[3], scope)})"
        if e[0] == "in" and isinstance(e[2], Node) and e[1][0] != "row":
            x, rel = self.expr(e[1], scope), self.query(e[2], scope)
            if len(rel.columns) == 1:
                pair = v.aligned(x, rel.columns[0].e._replace(sql="c0", aff=""))
                if not isinstance(pair, int):
                    return f"({pair[0]} {'NOT ' if e[3] else ''}IN (SELECT {pair[1]} FROM ({rel.sql})))"
        return v.truth(self.expr(e, scope))

    def _bare(self, e: E) -> E:
        """A column of a grouped query outside of aggregates: a key, or the value of one row of the group."""
        if self.agg is None or v.value(e) in self.agg.keys or not e.sql.startswith("s"):
            return e
        if self.agg.pick:
            f, by = self.agg.pick
            return e._replace(sql=f"{f}_by({e.sql}, {by})")
        return e._replace(sql=f"first({e.sql})")

    def _group_item(self, g, items, aliases):
        if g[0] == "lit" and isinstance(g[1], int):
            if not 1 <= g[1] <= len(items):
                raise SqlError("GROUP BY term out of range - should be between 1 and %d" % len(items))
            e = items[g[1] - 1][1]
            return ("e", e) if isinstance(e, E) else e
        if g[0] == "col" and g[1] is None and g[2].lower() in aliases:
            return aliases[g[2].lower()]
        return g

    def _aliased(self, e, aliases, scope):
        """e with the names of select items replaced by the items."""
        if isinstance(e, tuple):
            if e[:1] == ("col",) and e[1] is None and e[2].lower() in aliases:
                try:
                    scope.find(None, e[2])
                except SqlError:
                    return aliases[e[2].lower()]
                return e if any(c.name.lower() == e[2].lower() for c in scope.columns) else aliases[e[2].lower()]
            return tuple(self._aliased(x, aliases, scope) if isinstance(x, tuple) else x for x in e)
        return e

    def order_key(self, o, outs: list[E], names: list[str], scope: Scope, items=None, beside: list[str] | None = None) -> str:
        """One term of an ORDER BY; where beside is given, what is no output goes there as a column."""
        e, desc, nulls = o
        coll = None
        if e[0] == "collate":
            e, coll = e[1], e[2]
        x, own = None, False
        if e[0] == "lit" and isinstance(e[1], int):
            if not 1 <= e[1] <= len(outs):
                raise SqlError("ORDER BY term out of range - should be between 1 and %d" % len(outs))
            x = outs[e[1] - 1]
        elif e[0] == "col" and e[1] is None and e[2].lower() in [n.lower() for n in names]:
            x = outs[[n.lower() for n in names].index(e[2].lower())]
        elif items is not None and any(not isinstance(i[1], E) and i[1] == e for i in items):
            x = outs[[None if isinstance(i[1], E) else i[1] for i in items].index(e)]
        else:
            x, own = self.expr(e, scope), True
        key = v.collate(v.value(x), coll or x.coll) if x.t in ("text", "any") else v.value(x)
        if own and beside is not None:
            beside.append(f"{key} AS k{len(beside)}")
            key = f"k{len(beside) - 1}"
        return key + (" DESC" if desc else " ASC") + (f" NULLS {nulls}" if nulls else "")

    def expand(self, items, scope: Scope) -> list[tuple[str, object, bool]]:
        out = []
        for item in items:
            if item[0] == "star":
                cols = [c for c in scope.columns if c.name != "__rowid" and (not c.hidden if item[1] is None else (c.table or "").lower() == item[1].lower())]
                if not cols:
                    raise SqlError("no tables specified" if item[1] is None else f"no such table: {item[1]}", "name")
                out += [(c.name, c.e, False) for c in cols]
            else:
                _, e, alias, text = item
                out.append((alias or (e[2] if e[0] == "col" else text), e, alias is not None))
        return out

    # -- sources
    def source(self, s: Node, outer) -> tuple[str, list[Column], dict]:
        if s.join:
            return self.join(s, outer)
        if s.select is not None:
            rel = self.query(s.select, None)
            return self._aliased_rel(rel, s.alias)
        if s.args is not None and not self.db.is_table(s.table):
            return self.table_function(s, Scope([], outer), lateral=False)
        low = s.table.lower()
        if s.schema is None and low in self.ctes[-1]:
            return self._aliased_rel(self.ctes[-1][low], s.alias or s.table)
        found = self.db.source(s.schema, s.table)
        if found is None:
            if low.startswith("pragma_") or low in scalars.TABLE_FUNCTIONS:
                return self.table_function(s, Scope([], outer), lateral=False)
            raise SqlError(f"no such table: {(s.schema + '.') if s.schema else ''}{s.table}", "name")
        kind, got = found
        alias, shown = fresh("s"), s.alias or s.table
        if kind == "view":
            rel = Lowering(self.db).query(got.select)
            if got.columns:
                rel = Rel(rel.sql, [c._replace(name=n) for c, n in zip(rel.columns, got.columns)])
            return self._aliased_rel(rel, shown)
        view, columns, fts = got
        cols = [Column(n, E(f"{alias}.{ident(n)}", t, aff, coll), shown) for n, t, aff, coll in columns]
        return f"{view} AS {alias}", cols, {shown.lower(): (fts, alias, view)} if fts else {}

    def _aliased_rel(self, rel: Rel, shown: str | None):
        alias = fresh("s")
        cols = [Column(c.name, c.e._replace(sql=f"{alias}.c{i}", const=MISSING), shown) for i, c in enumerate(rel.columns)]
        return f"({rel.sql}) AS {alias}", cols, {}

    def table_function(self, s: Node, scope: Scope, lateral: bool):
        args = [self.expr(a, scope) for a in s.args or []]
        alias, shown = fresh("s"), s.alias or s.table
        low = s.table.lower()
        if low.startswith("pragma_"):
            view, columns = self.db.pragma_table(low[7:], [a.const for a in args])
            return f"{view} AS {alias}", [Column(n, E(f"{alias}.{ident(n)}", t), shown) for n, t in columns], {}
        if low not in scalars.TABLE_FUNCTIONS:
            raise SqlError(f"no such table-valued function: {s.table}", "name")
        sql, columns = scalars.TABLE_FUNCTIONS[low](args)
        head = "LATERAL " if lateral else ""
        names = ", ".join(ident(n) for n, _ in columns)
        return f"{head}{sql} AS {alias}({names})" if not sql.startswith("(") else f"{head}{sql} AS {alias}", [Column(n, E(f"{alias}.{ident(n)}", t), shown) for n, t in columns], {}

    def join(self, s: Node, outer):
        left, lcols, lfts = self.source(s.left, outer)
        r = s.right
        lateral = not r.join and r.select is None and r.table and not self.db.is_table(r.table) and r.table.lower() in scalars.TABLE_FUNCTIONS and r.table.lower() not in self.ctes[-1]
        if lateral:
            right, rcols, rfts = self.table_function(r, Scope(lcols, outer), lateral=True)
        else:
            right, rcols, rfts = self.source(r, outer)
        how = s.join
        fts = lfts | rfts
        if s.natural:
            using = [c.name for c in lcols if not c.hidden and any(x.name.lower() == c.name.lower() for x in rcols)]
            using = [n for n in dict.fromkeys(using) if n != "__rowid"]
        else:
            using = s.using or []
        if using:
            tests = []
            for n in using:
                a, b = self._only(lcols, n), self._only(rcols, n)
                tests.append(v.compare("=", a.e, b.e).sql)
                merged = a.e if how in ("INNER", "LEFT") else b.e if how == "RIGHT" else a.e._replace(sql=f"coalesce({a.e.sql}, {b.e.sql})", const=MISSING)
                if how in ("INNER", "LEFT"):
                    rcols = [c._replace(hidden=True) if c is b else c for c in rcols]
                else:
                    at = lcols.index(a)
                    lcols = [*lcols[:at], Column(n, merged, None), *(c._replace(hidden=True) if c is a else c for c in lcols[at:])]
                    rcols = [c._replace(hidden=True) if c is b else c for c in rcols]
            on = " AND ".join(tests)
        elif s.on is not None:
            on = v.truth(self.expr(s.on, Scope([*lcols, *rcols], outer, fts)))
        else:
            on = None
        word = {"CROSS": "CROSS", "INNER": "INNER", "LEFT": "LEFT", "RIGHT": "RIGHT", "FULL": "FULL"}[how if on or how in ("LEFT", "RIGHT", "FULL") else "CROSS"]
        if on is None and word != "CROSS":
            on = "TRUE"
        right = right if not r.join else f"({right})"
        sql = f"{left} {'INNER' if word == 'CROSS' and on else word} JOIN {right}" + (f" ON {on}" if on else "")
        return sql, [*lcols, *rcols], fts

    @staticmethod
    def _only(cols, name) -> Column:
        hits = [c for c in cols if c.name.lower() == name.lower() and not c.hidden]
        if len(hits) != 1:
            raise SqlError(f"cannot join using column {name} - column not present in both tables" if not hits else f"ambiguous column name: {name}", "name")
        return hits[0]

    # -- windows
    def window_spec(self, w: Node, named: dict) -> Node:
        seen = set()
        out = Node(partition=w.partition or [], order=w.order or [], frame=w.frame)
        while w.base:
            key = w.base.lower()
            if key not in named:
                raise SqlError(f"no such window: {w.base}", "name")
            if key in seen:
                raise SqlError(f"circular reference to window {w.base}", "name")
            seen.add(key)
            w = named[key]
            out.partition, out.order, out.frame = out.partition or w.partition, out.order or w.order, out.frame or w.frame
        return out

    def _flatten(self, source, scope, where, items, special, c):
        """The source as one relation with a row number and, for each special window, the dense rank of its order."""
        alias, cols, inner = fresh("s"), [], []
        for i, col in enumerate(scope.columns):
            inner.append(f"{v.value(col.e) if col.e.t != 'ts' else col.e.sql} AS f{i}")
            cols.append(col._replace(e=col.e._replace(sql=f"{alias}.f{i}")))
        inner.append("monotonically_increasing_id() AS k")
        source = f"(SELECT {', '.join(inner)} FROM {source}{where}) AS {alias}"
        mid = Scope(cols, scope.outer)
        outer_alias, extra = fresh("s"), []
        for j, w in enumerate(special):
            part = "PARTITION BY " + ", ".join(v.value(self.expr(p, mid)) for p in w.partition) if w.partition else ""
            order = ", ".join(self.order_key(o, [], [], mid) for o in w.order) or "1"
            extra.append(f"dense_rank() OVER ({part} ORDER BY {order}) AS g{j}")
            self.ranks[_window_key(w)] = f"{outer_alias}.g{j}", f"{outer_alias}.k"
        source = f"(SELECT {alias}.*, {', '.join(extra)} FROM {source}) AS {outer_alias}"
        final = Scope([x._replace(e=x.e._replace(sql=x.e.sql.replace(alias + ".", outer_alias + ".", 1))) for x in cols], scope.outer)
        old = {v.value(a.e): b.e for a, b in zip(scope.columns, final.columns)}
        items = [(n, old.get(v.value(e), e) if isinstance(e, E) else e, g) for n, e, g in items]
        return source, final, "", items

    def over(self, n, scope: Scope) -> E:
        _, name, args, opts = n
        if self.windows is None:
            raise SqlError(f"misuse of window function {name}()", "misuse")
        w = self.window_spec(opts.over, self.windows)
        saved = self.agg
        xs = [self.expr(a, scope) for a in args]
        part = [v.value(self.expr(p, scope)) for p in w.partition]
        order = [self.order_key(o, [], [], scope) for o in w.order]
        filt = v.truth(self.expr(opts.filter, scope)) if opts.filter else None
        self.agg = saved
        head = f"PARTITION BY {', '.join(part)} " if part else ""
        frame, f = "", w.frame
        if f is not None:
            g, k = self.ranks.get(_window_key(w), (None, None)) if f.mode == "GROUPS" or f.exclude else (None, None)
            if f.mode == "GROUPS":
                order = [f"{g} ASC"]
            frame = f" {'RANGE' if f.mode == 'GROUPS' else f.mode} BETWEEN {self._bound(f.lo, f.mode)} AND {self._bound(f.hi, f.mode)}"
        by = f"ORDER BY {', '.join(order)}" if order else ""
        spec = f"({head}{by}{frame})"
        if name in aggregates.RANKING:
            if not order:
                spec = f"({head}ORDER BY 1)"
            else:
                spec = f"({head}{by})"
            return aggregates.RANKING[name](xs, spec)
        if f is not None and f.exclude and name in aggregates.IN_PIECES and not opts.distinct:
            pieces = self._pieces(f, part, order, g, k)
            if pieces is not None:
                return aggregates.in_pieces(name, xs, pieces, filt)
        if f is not None and f.exclude:
            return aggregates.excluded(name, xs, opts, spec, g, k, f.exclude, filt)
        if name in aggregates.FRAME_VALUES:
            return aggregates.FRAME_VALUES[name](xs, spec)
        return aggregates.windowed(name, xs, opts, spec, filt)

    def _place(self, b) -> float:
        """Where a frame's bound lies from the current row, in rows or groups."""
        kind, e = b
        sign = -1 if kind.endswith("PRECEDING") else 1
        return 0 if kind == "CURRENT" else sign * float("inf") if e is None else sign * self.constant(e, "frame")

    def _pieces(self, f, part: list[str], order: list[str], g: str, k: str) -> list[str | None] | None:
        """The windows that together are a frame without what EXCLUDE names, None among them for the row itself; None where the frame may
        hold a part of the peers only."""
        lo, hi = self._place(f.lo), self._place(f.hi)
        inf = float("inf")

        def window(keys: list[str], by: list[str], mode: str, a: float, b: float) -> str:
            def bound(n):
                return "CURRENT ROW" if n == 0 else f"{'UNBOUNDED' if abs(n) == inf else int(abs(n))} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

            head = f"PARTITION BY {', '.join(keys)} " if keys else ""
            return f"({head}ORDER BY {', '.join(by)} {mode} BETWEEN {bound(a)} AND {bound(b)})"

        def around(keys, by, mode) -> list[str]:
            """The frame without its middle, or all of it where the middle lies outside."""
            if not lo <= 0 <= hi:
                return [window(keys, by, mode, lo, hi)] if lo <= hi else []
            return ([window(keys, by, mode, lo, -1)] if lo < 0 else []) + ([window(keys, by, mode, 1, hi)] if hi > 0 else [])

        if f.mode == "ROWS":
            return around(part, order or ["1"], "ROWS") if f.exclude == "CURRENT ROW" else None
        if f.mode == "RANGE" and not {lo, hi} <= {-inf, 0, inf}:
            return None
        out = around(part, [f"{g} ASC"], "RANGE")  # over the number of the peer group, both modes are the same
        if not lo <= 0 <= hi or f.exclude == "GROUP":
            return out
        peers, by = [*part, g], [f"{k} ASC"]
        if f.exclude == "TIES":
            return [*out, None]
        return [*out, window(peers, by, "ROWS", -inf, -1), window(peers, by, "ROWS", 1, inf)]

    def _bound(self, b, mode) -> str:
        kind, e = b
        if kind == "CURRENT":
            return "CURRENT ROW"
        if e is None:
            return kind
        n = self.constant(e, "frame")
        if not isinstance(n, (int, float)) or n < 0:
            raise SqlError(f"frame offset must be a non-negative {'number' if mode == 'RANGE' else 'integer'}")
        return f"{int(n) if n == int(n) else n} {kind}"

    # -- recursion
    def recursive(self, c: Node) -> Rel:
        arms = c.body.arms
        split = next((i for i, (_, a) in enumerate(arms) if _mentions(Node(arms=[(None, a)]), c.name)), 1)
        anchor = Node(kind="select", arms=arms[:split], order=[], limit=None, offset=None)
        step = Node(kind="select", arms=[(None, arms[split][1]), *arms[split + 1 :]], order=[], limit=None, offset=None)
        op = arms[split][0]
        base = self.query(anchor)
        names = c.columns or [x.name for x in base.columns]
        types = [x.e.t if x.e.t != "null" else "int" for x in base.columns]
        limit = self.constant(c.body.limit, "LIMIT") if c.body.limit is not None else None
        view = fresh("rec")
        me = [Column(n, E(f"c{i}", t)) for i, (n, t) in enumerate(zip(names, types))]
        self.ctes[-1][c.name.lower()] = Rel(f"SELECT * FROM {view}", me)
        again = self.query(step)
        for _ in range(3):  # a class may widen with the recursion
            wider = [v.unify([a, x.e.t]) for a, x in zip(types, again.columns)]
            if wider == types:
                break
            types = wider
            me = [Column(n, E(f"c{i}", t)) for i, (n, t) in enumerate(zip(names, types))]
            self.ctes[-1][c.name.lower()] = Rel(f"SELECT * FROM {view}", me)
            again = self.query(step)
        cast = [[f"{v.cast_to(x.e._replace(sql=f'c{i}'), t)} AS c{i}" for i, (x, t) in enumerate(zip(r.columns, types))] for r in (base, again)]
        first, more = (f"SELECT {', '.join(k)} FROM ({r.sql})" for k, r in zip(cast, (base, again)))
        if op == "UNION ALL" and not c.body.order and (limit is None or limit < 0):
            cols = ", ".join(f"c{i}" for i in range(len(types)))
            return Rel(f"WITH RECURSIVE {view}({cols}) AS ({first} UNION ALL {more}) SELECT * FROM {view}", me)
        from larkspur.operators import recursion

        if c.body.order:
            scope = Scope(me)
            keys = [self.order_key(o, [x.e for x in me], names, scope) for o in c.body.order]
            recursion.queue(self.db.spark, first, more, view, keys, op == "UNION", limit)
        else:
            recursion.fixpoint(self.db.spark, first, more, view, op == "UNION", limit)
        return Rel(f"SELECT * FROM {view}", me)

    # -- expressions
    def expr(self, e, scope: Scope) -> E:
        if self.agg is not None and e[0] not in ("lit", "col", "e"):
            saved, self.agg = self.agg, None
            try:
                if not any(is_aggregate(n) or n[0] == "fn" and n[3].over for n in walk(e)):
                    x = self._expr(e, scope)
                    if v.value(x) in saved.keys:
                        return x
            finally:
                self.agg = saved
        return self._expr(e, scope)

    def _expr(self, e, scope: Scope) -> E:
        return getattr(self, f"x_{e[0]}")(e, scope)

    def x_e(self, e, scope):
        return e[1]

    def x_lit(self, e, scope):
        return v.literal(e[1])

    def x_bool(self, e, scope):
        return v.literal(int(e[1]))

    def x_param(self, e, scope):
        return v.literal(self.db.bound(self.params, e[1]))

    def x_col(self, e, scope):
        try:
            x = scope.find(e[1], e[2], len(e) > 3 and e[3])
        except SqlError:
            table = self._ranked(e, scope)
            if table is None:
                raise
            from larkspur.functions import fts

            return fts.rank(self, table, scope)
        inside = any(c.e.sql == x.sql for c in scope.columns)
        return self._bare(x) if self.agg is not None and inside else x

    @staticmethod
    def _ranked(e, scope: Scope) -> str | None:
        """The full-text table whose hidden column rank e names."""
        while scope is not None and e[2].lower() == "rank":
            for table in scope.fts:
                if e[1] is None or e[1].lower() == table:
                    return table
            scope = scope.outer
        return None

    def x_row(self, e, scope):
        raise SqlError("row value misused", "syntax")

    def x_raise(self, e, scope):
        message = self.constant(e[2], "RAISE") if e[2] else ""
        return E(f"raise_error({v.quote(f'RAISE:{e[1]}:{message}')})", "null")

    def x_un(self, e, scope):
        _, op, a = e
        x = self.expr(a, scope)
        if op == "NOT":
            return E(f"(NOT {v.truth(x)})", "bool")
        if op == "+":
            return x
        n = v.number(x)
        if op == "~":
            return E(f"(~{v.integer(x)})", "int")
        return E(f"(-{n.sql})", n.t)

    def x_bin(self, e, scope):
        _, op, a, b = e
        if op in ("AND", "OR"):
            return E(f"({v.truth(self.expr(a, scope))} {op} {v.truth(self.expr(b, scope))})", "bool")
        if a[0] == "row" or b[0] == "row":
            return self.rows(op, a, b, scope)
        x, y = self.expr(a, scope), self.expr(b, scope)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return v.compare(op, x, y)
        if op == "||":
            return E(f"concat({v.text(x)}, {v.text(y)})", "text")
        if op in ("->", "->>"):
            return scalars.arrow(op, x, y)
        return v.arithmetic(op, x, y)

    def _row(self, e, scope, n=None) -> list[E]:
        if e[0] == "row":
            return [self.expr(x, scope) for x in e[1]]
        raise SqlError("row value misused", "syntax")

    def rows(self, op, a, b, scope) -> E:
        xs, ys = self._row(a, scope), self._row(b, scope)
        if len(xs) != len(ys):
            raise SqlError("row value misused", "syntax")
        return self._row_compare(op, xs, ys)

    def _row_compare(self, op, xs, ys) -> E:
        equal = [v.compare("=", x, y).sql for x, y in zip(xs, ys)]
        if op == "=":
            return E("(" + " AND ".join(equal) + ")", "bool")
        if op == "<>":
            return E("(NOT (" + " AND ".join(equal) + "))", "bool")
        out = v.compare(op, xs[-1], ys[-1]).sql
        for i in range(len(xs) - 2, -1, -1):
            out = f"({v.compare(op[0], xs[i], ys[i]).sql} OR ({equal[i]} AND {out}))"
        return E(out, "bool")

    def x_is(self, e, scope):
        _, a, b, negated = e
        if b[0] == "bool":
            x = E(f"coalesce({v.truth(self.expr(a, scope))} = {str(b[1]).upper()}, FALSE)", "bool")
        elif a[0] == "row":
            xs, ys = self._row(a, scope), self._row(b, scope)
            x = E("(" + " AND ".join(v.same(p, q).sql for p, q in zip(xs, ys)) + ")", "bool")
        elif b == ("lit", None):
            x = E(f"({self.expr(a, scope).sql} IS NULL)", "bool")
        else:
            x = v.same(self.expr(a, scope), self.expr(b, scope))
        return E(f"(NOT {x.sql})", "bool") if negated else x

    def x_between(self, e, scope):
        _, a, lo, hi, negated = e
        if a[0] == "row":
            out = f"({self.rows('>=', a, lo, scope).sql} AND {self.rows('<=', a, hi, scope).sql})"
        else:
            x = self.expr(a, scope)
            out = f"({v.compare('>=', x, self.expr(lo, scope)).sql} AND {v.compare('<=', x, self.expr(hi, scope)).sql})"
        return E(f"(NOT {out})" if negated else out, "bool")

    def x_in(self, e, scope):
        _, a, what, negated = e
        if isinstance(what, list):
            if not what:
                return E("TRUE" if negated else "FALSE", "bool")
            if a[0] == "row":
                xs = self._row(a, scope)
                tests = [self._row_compare("=", xs, self._row(w, scope)).sql for w in what]
            else:
                x = self.expr(a, scope)
                tests = [v.compare("=", x, self.expr(w, scope)).sql for w in what]
                if x.t in ("int", "real") and x.aff and all(w[0] == "lit" and isinstance(w[1], (int, float)) for w in what):
                    tests = [f"({x.sql} IN ({', '.join(v.literal(w[1]).sql for w in what)}))"]
            out = "(" + " OR ".join(tests) + ")"
            return E(f"(NOT {out})" if negated else out, "bool")
        rel = self.query(what, scope)
        alias = fresh("s")
        xs = self._row(a, scope) if a[0] == "row" else [self.expr(a, scope)]
        if len(xs) != len(rel.columns):
            raise SqlError(f"sub-select returns {len(rel.columns)} columns - expected {len(xs)}", "syntax")
        ys = [c.e._replace(sql=f"{alias}.c{i}", aff=c.e.aff if len(xs) > 1 else "") for i, c in enumerate(rel.columns)]
        test = self._row_compare("=", xs, ys).sql
        body = f"SELECT 1 FROM ({rel.sql}) {alias} WHERE"
        # three-valued: a match, or else unknown if the comparison with some row is unknown
        maybe = " OR ".join(f"({x.sql} IS NULL OR {y.sql} IS NULL)" for x, y in zip(xs, ys))
        yes, no = ("FALSE", "TRUE") if negated else ("TRUE", "FALSE")
        if len(xs) == 1 and not _refers(rel.sql, scope):  # the counts of rows and of NULLs are computed once, the match is a hash join
            some = f"(SELECT count(*) FROM ({rel.sql}))"
            nulls = f"(SELECT count_if({ys[0].sql} IS NULL) FROM ({rel.sql}) {alias})"
            unknown = f"({xs[0].sql} IS NULL AND {some} > 0) OR {nulls} > 0"
            return E(f"(CASE WHEN EXISTS ({body} {test}) THEN {yes} WHEN {unknown} THEN NULL ELSE {no} END)", "bool")
        return E(f"(CASE WHEN EXISTS ({body} {test}) THEN {yes} WHEN EXISTS ({body} {maybe}) THEN NULL ELSE {no} END)", "bool")

    def x_exists(self, e, scope):
        rel = self.query(e[1], scope)
        return E(f"EXISTS ({rel.sql})", "bool")

    def x_sub(self, e, scope):
        s = e[1]
        core = s.arms[0][1]
        one = len(s.arms) == 1 and not core.values and not core.group and any(is_aggregate(n) for i in core.items if i[0] == "item" for n in walk(i[1]))
        if not one and (s.limit is None or self.constant(s.limit, "LIMIT") not in (0, 1)):
            s = Node(**vars(s) | {"limit": ("lit", 1)})
        rel = self.query(s, scope)
        if len(rel.columns) != 1:
            raise SqlError(f"sub-select returns {len(rel.columns)} columns - expected 1", "syntax")
        c = rel.columns[0].e
        return E(f"({rel.sql})", c.t, c.aff, c.coll)

    def x_like(self, e, scope):
        _, op, a, b, escape, negated = e
        if op == "MATCH":
            from larkspur.functions import fts

            out = fts.match(self, a, b, scope)
        elif op == "REGEXP":
            out = E(f"({v.text(self.expr(a, scope))} RLIKE {v.text(self.expr(b, scope))})", "bool")
        else:
            args = [self.expr(b, scope), self.expr(a, scope)]
            if escape is not None:
                args.append(self.expr(escape, scope))
            out = scalars.like(args, self.db.case_sensitive_like) if op == "LIKE" else scalars.glob(args)
        return E(f"(NOT {out.sql})", "bool") if negated else out

    def x_case(self, e, scope):
        _, base, whens, other = e
        x = self.expr(base, scope)._replace(aff="") if base else None
        conds, outs = [], []
        for cond, then in whens:
            y = self.expr(cond, scope)
            conds.append(v.compare("=", x, y._replace(aff="")).sql if x else v.truth(y))
            outs.append(self.expr(then, scope))
        last = self.expr(other, scope) if other is not None else v.literal(None)
        t = v.unify([o.t for o in [*outs, last]])
        arms = " ".join(f"WHEN {c} THEN {v.cast_to(o, t)}" for c, o in zip(conds, outs))
        return E(f"(CASE {arms} ELSE {v.cast_to(last, t)} END)", t)

    def x_cast(self, e, scope):
        return v.cast(self.expr(e[1], scope), e[2])

    def x_collate(self, e, scope):
        if e[2] not in ("BINARY", "NOCASE", "RTRIM"):
            raise SqlError(f"no such collation sequence: {e[2]}", "name")
        return self.expr(e[1], scope)._replace(coll=e[2])

    def x_fn(self, e, scope):
        _, name, args, opts = e
        if opts.over:
            return self.over(e, scope)
        if is_aggregate(e):
            if self.agg is None:
                raise SqlError(f"misuse of aggregate function {name.upper()}()", "misuse")
            saved, self.agg = self.agg, None
            try:
                xs = [self.expr(a, scope) for a in args]
                filt = v.truth(self.expr(opts.filter, scope)) if opts.filter else None
                order = [(self.expr(o, scope), d) for o, d, _ in opts.order or []]
            finally:
                self.agg = saved
            return aggregates.aggregate(name, xs, opts, filt, order)
        if name in ("bm25", "highlight", "snippet", "offsets", "matchinfo") and args and args[0][0] == "col":
            from larkspur.functions import fts

            return fts.auxiliary(self, name, args, scope)
        xs = [self.expr(a, scope) for a in args]
        return scalars.call(name, xs, self.db)


def _refers(sql: str, scope: Scope | None) -> bool:
    """Whether a subquery's text names a source of the queries around it."""
    while scope is not None:
        if any(re.search(rf"\b{re.escape(a)}\.", sql) for a in {c.e.sql.split(".")[0] for c in scope.columns if "." in c.e.sql}):
            return True
        scope = scope.outer
    return False


def _window_key(w: Node) -> str:
    return repr((w.partition, w.order, w.frame.mode, w.frame.exclude))


def _mentions(s: Node, name: str) -> bool:
    """Whether a query reads a table of this name."""

    def source(x) -> bool:
        if x is None:
            return False
        if x.join:
            return source(x.left) or source(x.right)
        if x.select is not None:
            return _mentions(x.select, name)
        return (x.table or "").lower() == name.lower()

    def inside(e) -> bool:
        if isinstance(e, Node):
            return _mentions(e, name) if e.arms else False
        return isinstance(e, (tuple, list)) and any(inside(x) for x in e)

    for _, a in s.arms or []:
        if a.values:
            if inside(a.values):
                return True
        elif source(a.source) or inside([i[1] for i in a.items if i[0] == "item"]) or inside(a.where) or inside(a.having):
            return True
    return any(_mentions(c.body, name) for c in (s.ctes.items if s.ctes else []))
