"""PRAGMA statements, their table-valued forms, and the schema tables, as DataFrames made from the catalog."""

from __future__ import annotations

import itertools

from larkspur.errors import SqlError
from larkspur.functions import aggregates, scalars
from pyspark.sql import DataFrame

_views = itertools.count()
_TYPES = {"int": "bigint", "text": "string", "any": "string"}

#: Columns of the table-valued pragmas.
COLUMNS = {
    "table_info": [("cid", "int"), ("name", "text"), ("type", "text"), ("notnull", "int"), ("dflt_value", "text"), ("pk", "int")],
    "table_xinfo": [("cid", "int"), ("name", "text"), ("type", "text"), ("notnull", "int"), ("dflt_value", "text"), ("pk", "int"), ("hidden", "int")],
    "index_list": [("seq", "int"), ("name", "text"), ("unique", "int"), ("origin", "text"), ("partial", "int")],
    "index_info": [("seqno", "int"), ("cid", "int"), ("name", "text")],
    "index_xinfo": [("seqno", "int"), ("cid", "int"), ("name", "text"), ("desc", "int"), ("coll", "text"), ("key", "int")],
    "foreign_key_list": [("id", "int"), ("seq", "int"), ("table", "text"), ("from", "text"), ("to", "text"), ("on_update", "text"), ("on_delete", "text"), ("match", "text")],
    "foreign_key_check": [("table", "text"), ("rowid", "int"), ("parent", "text"), ("fkid", "int")],
    "database_list": [("seq", "int"), ("name", "text"), ("file", "text")],
    "table_list": [("schema", "text"), ("name", "text"), ("type", "text"), ("ncol", "int"), ("wr", "int"), ("strict", "int")],
    "collation_list": [("seq", "int"), ("name", "text")],
    "compile_options": [("compile_options", "text")],
    "function_list": [("name", "text"), ("builtin", "int"), ("type", "text"), ("enc", "text"), ("narg", "int"), ("flags", "int")],
    "module_list": [("name", "text")],
    "pragma_list": [("name", "text")],
    "integrity_check": [("integrity_check", "text")],
    "quick_check": [("quick_check", "text")],
}
#: Pragmas that only give a value.
CONSTANTS = {
    "encoding": "UTF-8", "page_size": 4096, "page_count": 1, "cache_size": -2000, "journal_mode": "memory", "synchronous": 2, "auto_vacuum": 0, "freelist_count": 0,
    "locking_mode": "normal", "temp_store": 0, "application_id": 0, "busy_timeout": 0, "recursive_triggers": 0, "read_uncommitted": 0, "secure_delete": 0, "data_version": 1,
    "max_page_count": 1073741823, "mmap_size": 0, "query_only": 0, "threads": 0, "cell_size_check": 0, "checkpoint_fullfsync": 0, "fullfsync": 0, "defer_foreign_keys": 0,
    "automatic_index": 1, "analysis_limit": 0, "ignore_check_constraints": 0, "legacy_alter_table": 0, "reverse_unordered_selects": 0, "trusted_schema": 1, "writable_schema": 0,
    "wal_autocheckpoint": 1000, "journal_size_limit": -1, "hard_heap_limit": 0, "soft_heap_limit": 0, "cache_spill": 1, "legacy_file_format": 0, "full_column_names": 0, "short_column_names": 1,
    "count_changes": 0, "empty_result_callbacks": 0,
}


class Pragmas:
    def __init__(self, db):
        self.db = db

    def frame(self, rows: list[tuple], columns) -> DataFrame:
        return self.db.spark.createDataFrame(rows, ", ".join(f"`{n}` {_TYPES[t]}" for n, t in columns))

    def table(self, name: str, args: list):
        columns = COLUMNS.get(name)
        if columns is None:
            columns = [(name, "int" if isinstance(self.scalar(name), int) else "text")]
            rows = [(self.scalar(name),)]
        else:
            rows = self.rows(name, args[0] if args else None)
        view = f"p{next(_views)}"
        self.frame(rows, columns).createOrReplaceTempView(view)
        return view, columns

    def scalar(self, name: str):
        db = self.db
        live = {"foreign_keys": int(db.foreign_keys), "case_sensitive_like": int(db.case_sensitive_like), **db.catalog.pragmas}
        if name in live:
            return live[name]
        if name in CONSTANTS:
            return CONSTANTS[name]
        raise SqlError(f"no such table-valued function: pragma_{name}", "name")

    def run(self, s) -> DataFrame | None:
        name, value, db = s.name, s.value, self.db
        if name in COLUMNS:
            return self.frame(self.rows(name, value), COLUMNS[name])
        if value is not None:
            on = value in (1, True) or str(value).lower() in ("on", "yes", "true")
            if name == "foreign_keys":
                if not db.in_transaction:
                    db.foreign_keys = on
            elif name == "case_sensitive_like":
                db.case_sensitive_like = on
            elif name in ("user_version", "schema_version"):
                db.catalog.pragmas[name] = int(value)
            return None
        if name in ("optimize", "shrink_memory", "incremental_vacuum", "wal_checkpoint"):
            return None
        try:
            x = self.scalar(name)
        except SqlError:
            return None
        return self.frame([(x,)], [(name, "int" if isinstance(x, int) else "text")])

    def _table(self, name):
        try:
            return self.db.table(None, str(name))
        except SqlError:
            return None

    def _keys(self, t):
        """(name, key, unique, origin, partial) of a table's indexes, newest first."""
        out = []
        for i, k in enumerate(k for k in t.keys):
            out.append((f"sqlite_autoindex_{t.name}_{i + 1}", [("col", None, c) for c in k.columns], 1, k.origin, 0, [False] * len(k.columns)))
        for x in self.db.catalog_of(t).indexes.values():
            if x.table.lower() == t.name.lower():
                out.append((x.name, [e for e, _ in x.columns], int(x.unique), "c", int(x.where is not None), [d for _, d in x.columns]))
        return out[::-1]

    def rows(self, name: str, arg) -> list[tuple]:
        db = self.db
        if name in ("table_info", "table_xinfo"):
            t = self._table(arg)
            if t is None:
                view = db.catalog.views.get(str(arg).lower())
                if view is None:
                    return []
                from larkspur.plans.lower import Lowering

                rel = Lowering(db).query(view.select)
                return [(i, n, "", 0, None, 0, *((0,) if name == "table_xinfo" else ())) for i, n in enumerate(view.columns or [c.name for c in rel.columns])]
            out = []
            for c in t.columns:
                hidden = 0 if c.generated is None else 3 if c.stored else 2
                if name == "table_info" and hidden:
                    continue
                out.append((len(out), c.name, c.declared, int(c.notnull), c.default_text, c.pk, *((hidden,) if name == "table_xinfo" else ())))
            return out
        if name == "index_list":
            t = self._table(arg)
            return [(i, n, u, o, p) for i, (n, _, u, o, p, _) in enumerate(self._keys(t))] if t else []
        if name in ("index_info", "index_xinfo"):
            for t in db.catalog.tables.values():
                for n, es, *_, desc in self._keys(t):
                    if n.lower() == str(arg).lower():
                        out = []
                        for i, (e, d) in enumerate(zip(es, desc)):
                            plain = e[1] if e[0] == "collate" else e
                            cid = next((j for j, c in enumerate(t.columns) if plain[0] == "col" and c.name.lower() == plain[2].lower()), -2)
                            row = (i, cid, t.columns[cid].name if cid >= 0 else None)
                            coll = e[2] if e[0] == "collate" else (t.columns[cid].coll or "BINARY") if cid >= 0 else "BINARY"
                            out.append(row + ((int(bool(d)), coll, 1) if name == "index_xinfo" else ()))
                        if name == "index_xinfo":
                            out.append((len(es), -1, None, 0, "BINARY", 0))
                        return out
            return []
        if name == "foreign_key_list":
            t = self._table(arg)
            out = []
            for i, f in enumerate(reversed(t.foreigns) if t else []):
                for j, c in enumerate(f.columns):
                    out.append((i, j, f.parent, c, f.parent_columns[j] if f.parent_columns else None, f.on_update, f.on_delete, "NONE"))
            return out
        if name == "foreign_key_check":
            out = []
            for t in db.catalog.tables.values():
                if arg is not None and t.name.lower() != str(arg).lower():
                    continue
                for i, f in enumerate(t.foreigns):
                    p = db.table(None, f.parent)
                    tie = db._changer._tie(t, f, p, "n", "o")
                    some = " AND ".join(f"n.`{c}` IS NOT NULL" for c in f.columns)
                    for r in db.spark.sql(f"SELECT n.__rowid AS r FROM {t.view} n LEFT ANTI JOIN {p.view} o ON {tie} WHERE {some} ORDER BY 1").collect():
                        out.append((t.name, r["r"], f.parent, i))
            return out
        if name == "database_list":
            return [(0, "main", ""), *((i + 2, n, "") for i, n in enumerate(db.catalog.attached))]
        if name == "table_list":
            out = [("main", t.name, "virtual" if t.fts or t.rtree else "table", len(t.columns), int(t.without_rowid), int(t.strict)) for t in db.catalog.tables.values()]
            return [*out, *(("main", x.name, "view", len(x.columns or []), 0, 0) for x in db.catalog.views.values()), ("main", "sqlite_schema", "table", 5, 0, 0)]
        if name == "collation_list":
            return [(0, "RTRIM"), (1, "NOCASE"), (2, "BINARY")]
        if name == "function_list":
            out = [(f, 1, "s", "utf8", lo if lo == hi else -1, 0) for f, (lo, hi, _) in scalars.FUNCTIONS.items()]
            out += [(f, 1, "a", "utf8", -1, 0) for f in sorted(aggregates.NAMES)]
            return out + [(f, 1, "w", "utf8", -1, 0) for f in [*aggregates.RANKING, *aggregates.FRAME_VALUES]]
        if name == "module_list":
            return [(m,) for m in ("fts3", "fts4", "fts5", "fts5vocab", "rtree", "rtree_i32", "dbstat", "json_each", "json_tree", "generate_series", "bytecode", "tables_used")]
        if name == "pragma_list":
            return [(p,) for p in sorted({*COLUMNS, *CONSTANTS, "foreign_keys", "case_sensitive_like", "user_version", "schema_version", "optimize"})]
        if name in ("integrity_check", "quick_check"):
            return [("ok",)]
        return []

    def master(self, c):
        """Rows of the schema table."""
        rows, page = [], 2
        for t in c.tables.values():
            if not t.external or t.sql:
                virtual = t.fts or t.rtree or t.external
                rows.append(("table", t.name, t.name, 0 if virtual else page, t.sql))
                page += 1
                for i, k in enumerate(t.keys):
                    rows.append(("index", f"sqlite_autoindex_{t.name}_{i + 1}", t.name, page, None))
                    page += 1
        for x in c.indexes.values():
            rows.append(("index", x.name, x.table, page, x.sql))
            page += 1
        rows += [("view", x.name, x.name, 0, x.sql) for x in c.views.values()]
        rows += [("trigger", x.name, x.node.table, 0, x.sql) for x in c.triggers.values()]
        columns = [("type", "text"), ("name", "text"), ("tbl_name", "text"), ("rootpage", "int"), ("sql", "text")]
        view = f"p{next(_views)}"
        self.frame(rows, columns).createOrReplaceTempView(view)
        return view, columns

    def analyze(self, only: str | None) -> None:
        """Row counts into the statistics table."""
        from larkspur.sources import catalog as cat

        rows = []
        for t in self.db.catalog.tables.values():
            if not t.external and t.name != "sqlite_stat1" and (only is None or t.name.lower() == only.lower()):
                n = t.df.count()
                keys = self._keys(t)
                rows += [(t.name, k[0], f"{n} {max(1, n)}") for k in keys] or ([(t.name, None, str(n))] if n else [])
        table = cat.Table("sqlite_stat1", [cat.Col(c, "", "text") for c in ("tbl", "idx", "stat")], sql="CREATE TABLE sqlite_stat1(tbl,idx,stat)")
        cat.publish(table, self.db.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "__rowid bigint, tbl string, idx string, stat string"))
        self.db.catalog.tables["sqlite_stat1"] = table
