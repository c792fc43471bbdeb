"""Recursive descent over the dialect's statements, precedence climbing over its expressions.

Statements are Node objects. Expressions are tuples whose first item names the form:
('lit', v) ('col', table, name) ('param', key) ('un', op, e) ('bin', op, a, b) ('is', a, b, negated) ('in', e, what, negated)
('between', e, lo, hi, negated) ('like', op, a, b, escape, negated) ('case', base, ((when, then), ...), other) ('cast', e, type)
('collate', e, name) ('fn', name, args, opts) ('exists', select) ('sub', select) ('row', items) ('raise', action, message)
"""

from __future__ import annotations

from types import SimpleNamespace

from larkspur.errors import SqlError
from larkspur.plans.lexer import Token, tokenize


class Node(SimpleNamespace):
    """A statement or a clause."""

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return None


#: Words that end an expression or a source and so are no alias without AS.
_STOP = set(
    "FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT JOIN LEFT RIGHT FULL INNER CROSS NATURAL OUTER ON USING WINDOW SET VALUES RETURNING "
    "AS AND OR NOT IS IN LIKE GLOB MATCH REGEXP BETWEEN ISNULL NOTNULL COLLATE ESCAPE WHEN THEN ELSE END ASC DESC NULLS DO CONFLICT BEGIN SELECT WITH INDEXED "
    "ROWS RANGE GROUPS EXCLUDE PARTITION FILTER OVER".split()
)
_BINARY = [{"OR"}, {"AND"}, None, {"=", "==", "!=", "<>"}, {"<", "<=", ">", ">="}, {"&", "|", "<<", ">>"}, {"+", "-"}, {"*", "/", "%"}, {"||", "->", "->>"}]


class Parser:
    def __init__(self, sql: str):
        self.sql, self.toks, self.i, self.params = sql, tokenize(sql), 0, 0

    # -- tokens
    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def word(self, ahead: int = 0) -> str:
        t = self.toks[min(self.i + ahead, len(self.toks) - 1)]
        return t.value.upper() if t.kind == "id" else t.value if t.kind == "op" else ""

    def fail(self):
        t = self.tok
        raise SqlError("incomplete input" if t.kind == "end" else f'near "{self.sql[t.at : t.end]}": syntax error', "syntax")

    def accept(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            self.fail()

    def name(self) -> str:
        t = self.tok
        if t.kind in ("id", "qid", "str"):
            self.i += 1
            return t.value
        self.fail()

    def names(self) -> list[str]:
        self.expect("(")
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        self.expect(")")
        return out

    def qualified(self) -> tuple[str | None, str]:
        a = self.name()
        return (a, self.name()) if self.accept(".") else (None, a)

    # -- statements
    def script(self) -> list[Node]:
        out = []
        while self.tok.kind != "end":
            if self.accept(";"):
                continue
            start = self.tok.at
            s = self.statement()
            s.text = self.sql[start : self.toks[self.i - 1].end]
            out.append(s)
            if self.tok.kind != "end":
                self.expect(";")
        return out

    def statement(self) -> Node:
        w = self.word()
        if w == "EXPLAIN":
            self.i += 1
            plan = self.accept("QUERY", "PLAN")
            return Node(kind="explain", plan=plan, body=self.statement())
        if w in ("SELECT", "VALUES"):
            return self.select()
        if w == "WITH":
            ctes = self.ctes()
            s = self.statement()
            s.ctes = ctes
            return s
        method = getattr(self, f"s_{w.lower()}", None) if w.isalpha() else None
        return method() if method else self.fail()

    def ctes(self) -> Node:
        self.expect("WITH")
        out = Node(recursive=self.accept("RECURSIVE"), items=[])
        while True:
            name = self.name()
            columns = self.names() if self.word() == "(" else None
            self.expect("AS")
            self.accept("MATERIALIZED") or self.accept("NOT", "MATERIALIZED")
            self.expect("(")
            out.items.append(Node(name=name, columns=columns, body=self.select_with()))
            self.expect(")")
            if not self.accept(","):
                return out

    def select_with(self) -> Node:
        ctes = self.ctes() if self.word() == "WITH" else None
        s = self.select()
        s.ctes = ctes
        return s

    def select(self) -> Node:
        """A compound: arms joined from the left, and order and limit of the whole."""
        out = Node(kind="select", arms=[(None, self.core())], order=[], limit=None, offset=None)
        while True:
            if self.accept("UNION"):
                op = "UNION ALL" if self.accept("ALL") else "UNION"
            elif self.accept("INTERSECT"):
                op = "INTERSECT"
            elif self.accept("EXCEPT"):
                op = "EXCEPT"
            else:
                break
            out.arms.append((op, self.core()))
        out.order = self.order_by()
        if self.accept("LIMIT"):
            out.limit = self.expr()
            if self.accept("OFFSET"):
                out.offset = self.expr()
            elif self.accept(","):
                out.offset, out.limit = out.limit, self.expr()
        return out

    def order_by(self) -> list:
        out = []
        if self.accept("ORDER", "BY"):
            while True:
                e = self.expr()
                desc = self.accept("DESC") or (self.accept("ASC") and False)
                nulls = "FIRST" if self.accept("NULLS", "FIRST") else "LAST" if self.accept("NULLS", "LAST") else None
                out.append((e, bool(desc), nulls))
                if not self.accept(","):
                    break
        return out

    def exprs(self) -> list:
        out = [self.expr()]
        while self.accept(","):
            out.append(self.expr())
        return out

    def core(self) -> Node:
        if self.accept("VALUES"):
            rows = []
            while True:
                self.expect("(")
                rows.append(self.exprs())
                self.expect(")")
                if not self.accept(","):
                    break
            if len({len(r) for r in rows}) > 1:
                raise SqlError("all VALUES must have the same number of terms", "syntax")
            return Node(values=rows)
        self.expect("SELECT")
        out = Node(distinct=self.accept("DISTINCT"), items=[], source=None, where=None, group=[], having=None, windows={})
        self.accept("ALL")
        while True:
            out.items.append(self.result())
            if not self.accept(","):
                break
        if self.accept("FROM"):
            out.source = self.source_list()
        if self.accept("WHERE"):
            out.where = self.expr()
        if self.accept("GROUP", "BY"):
            out.group = self.exprs()
        if self.accept("HAVING"):
            out.having = self.expr()
        if self.accept("WINDOW"):
            while True:
                name = self.name()
                self.expect("AS")
                out.windows[name.lower()] = self.window()
                if not self.accept(","):
                    break
        return out

    def result(self):
        if self.accept("*"):
            return ("star", None, None)
        if self.tok.kind in ("id", "qid") and self.word(1) == "." and self.word(2) == "*":
            t = self.name()
            self.i += 2
            return ("star", t, None)
        start = self.tok.at
        e = self.expr()
        text = self.sql[start : self.toks[self.i - 1].end]
        return ("item", e, self.alias(), text)

    def alias(self) -> str | None:
        if self.accept("AS"):
            return self.name()
        t = self.tok
        if t.kind in ("qid", "str") or (t.kind == "id" and t.value.upper() not in _STOP):
            self.i += 1
            return t.value
        return None

    def source_list(self) -> Node:
        left = self.source()
        while True:
            if self.accept(","):
                left = Node(join="CROSS", left=left, right=self.source())
                continue
            natural = self.accept("NATURAL")
            how = next((w for w in ("LEFT", "RIGHT", "FULL") if self.accept(w)), None)
            if how:
                self.accept("OUTER")
            elif self.accept("INNER"):
                how = "INNER"
            elif self.accept("CROSS"):
                how = "CROSS"
            if not self.accept("JOIN"):
                if natural or how:
                    self.fail()
                return left
            left = Node(join=how or "INNER", natural=natural, left=left, right=self.source())
            if self.accept("ON"):
                left.on = self.expr()
            elif self.accept("USING"):
                left.using = self.names()

    def source(self) -> Node:
        if self.accept("("):
            if self.word() in ("SELECT", "VALUES", "WITH"):
                s = self.select_with()
                self.expect(")")
                return Node(select=s, alias=self.alias())
            inner = self.source_list()
            self.expect(")")
            inner.alias = self.alias()
            return inner
        schema, name = self.qualified()
        args = None
        if self.accept("("):
            args = [] if self.word() == ")" else self.exprs()
            self.expect(")")
        out = Node(schema=schema, table=name, args=args, alias=self.alias())
        if self.accept("INDEXED", "BY"):
            self.name()
        else:
            self.accept("NOT", "INDEXED")
        return out

    # -- changes
    def s_insert(self) -> Node:
        self.expect("INSERT")
        return self._insert(self.name().upper() if self.accept("OR") else "ABORT")

    def s_replace(self) -> Node:
        self.expect("REPLACE")
        return self._insert("REPLACE")

    def _insert(self, conflict: str) -> Node:
        self.expect("INTO")
        schema, table = self.qualified()
        out = Node(kind="insert", conflict=conflict, schema=schema, table=table, alias=self.name() if self.accept("AS") else None, columns=None, upsert=None)
        if self.word() == "(":
            out.columns = self.names()
        if self.accept("DEFAULT", "VALUES"):
            out.source = None
        else:
            out.source = self.select_with()
        if self.accept("ON", "CONFLICT"):
            u = Node(target=None, where=None, set=None, set_where=None)
            if self.accept("("):
                u.target = self.exprs()
                self.expect(")")
                if self.accept("WHERE"):
                    u.where = self.expr()
            self.expect("DO")
            if not self.accept("NOTHING"):
                self.expect("UPDATE", "SET")
                u.set = self.assignments()
                if self.accept("WHERE"):
                    u.set_where = self.expr()
            out.upsert = u
        out.returning = self.returning()
        return out

    def assignments(self) -> list[tuple[str, tuple]]:
        out = []
        while True:
            column = self.name()
            self.expect("=")
            out.append((column, self.expr()))
            if not self.accept(","):
                return out

    def returning(self):
        if not self.accept("RETURNING"):
            return None
        out = [self.result()]
        while self.accept(","):
            out.append(self.result())
        return out

    def s_update(self) -> Node:
        self.expect("UPDATE")
        conflict = self.name().upper() if self.accept("OR") else "ABORT"
        schema, table = self.qualified()
        out = Node(kind="update", conflict=conflict, schema=schema, table=table, alias=self.alias() if self.word() != "SET" else None)
        self.expect("SET")
        out.set = self.assignments()
        out.source = self.source_list() if self.accept("FROM") else None
        out.where = self.expr() if self.accept("WHERE") else None
        out.returning = self.returning()
        return out

    def s_delete(self) -> Node:
        self.expect("DELETE", "FROM")
        schema, table = self.qualified()
        out = Node(kind="delete", schema=schema, table=table, alias=self.alias())
        out.where = self.expr() if self.accept("WHERE") else None
        out.returning = self.returning()
        return out

    # -- definitions
    def s_create(self) -> Node:
        self.expect("CREATE")
        temp = self.accept("TEMP") or self.accept("TEMPORARY")
        if self.accept("VIRTUAL", "TABLE"):
            exists = self.accept("IF", "NOT", "EXISTS")
            schema, name = self.qualified()
            self.expect("USING")
            module, args, depth = self.name(), [], 0
            if self.accept("("):
                start = self.tok.at
                while not (depth == 0 and self.word() in (")", ",")) and self.tok.kind != "end" or depth == 0 and self.word() == ",":
                    if depth == 0 and self.word() == ",":
                        args.append(self.sql[start : self.tok.at].strip())
                        start = self.toks[self.i + 1].at
                    depth += {"(": 1, ")": -1}.get(self.word(), 0)
                    self.i += 1
                args.append(self.sql[start : self.tok.at].strip())
                self.expect(")")
            return Node(kind="create_virtual", schema=schema, name=name, exists=exists, module=module.lower(), args=[a for a in args if a])
        if self.accept("TABLE"):
            return self._create_table(temp)
        if self.accept("VIEW"):
            exists = self.accept("IF", "NOT", "EXISTS")
            schema, name = self.qualified()
            columns = self.names() if self.word() == "(" else None
            self.expect("AS")
            return Node(kind="create_view", schema=schema, name=name, exists=exists, columns=columns, select=self.select_with())
        if self.accept("TRIGGER"):
            return self._create_trigger()
        unique = self.accept("UNIQUE")
        self.expect("INDEX")
        exists = self.accept("IF", "NOT", "EXISTS")
        schema, name = self.qualified()
        self.expect("ON")
        table = self.name()
        self.expect("(")
        columns = self.indexed()
        self.expect(")")
        where = self.expr() if self.accept("WHERE") else None
        return Node(kind="create_index", unique=unique, exists=exists, schema=schema, name=name, table=table, columns=columns, where=where)

    def indexed(self) -> list:
        out = []
        while True:
            e = self.expr()
            out.append((e, self.accept("DESC") or (self.accept("ASC") and False)))
            if not self.accept(","):
                return out

    def _create_table(self, temp: bool) -> Node:
        exists = self.accept("IF", "NOT", "EXISTS")
        schema, name = self.qualified()
        out = Node(kind="create_table", temp=temp, exists=exists, schema=schema, name=name, columns=[], constraints=[], select=None)
        if self.accept("AS"):
            out.select = self.select_with()
            return out
        self.expect("(")
        while True:
            if self.word() in ("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN"):
                out.constraints.append(self.table_constraint())
            else:
                out.columns.append(self.column_def())
            if not self.accept(","):
                break
        self.expect(")")
        while True:
            if self.accept("STRICT"):
                out.strict = True
            elif self.accept("WITHOUT", "ROWID"):
                out.without_rowid = True
            else:
                break
            self.accept(",")
        return out

    def conflict(self) -> str | None:
        return self.name().upper() if self.accept("ON", "CONFLICT") else None

    def table_constraint(self) -> Node:
        name = self.name() if self.accept("CONSTRAINT") else None
        if self.accept("PRIMARY", "KEY"):
            out = Node(type="primary", columns=self._key_columns())
        elif self.accept("UNIQUE"):
            out = Node(type="unique", columns=self._key_columns())
        elif self.accept("CHECK"):
            out = self._check()
        else:
            self.expect("FOREIGN", "KEY")
            columns = self.names()
            out = self.references(columns)
        out.on_conflict = self.conflict()
        out.name = name
        return out

    def _key_columns(self) -> list[str]:
        self.expect("(")
        out = [e[2] if e[0] == "col" else e[1][2] if e[0] == "collate" else self.fail() for e, _ in self.indexed()]
        self.expect(")")
        return out

    def _check(self) -> Node:
        self.expect("(")
        start = self.tok.at
        e = self.expr()
        text = self.sql[start : self.toks[self.i - 1].end]
        self.expect(")")
        return Node(type="check", expr=e, text=text)

    def references(self, columns: list[str]) -> Node:
        self.expect("REFERENCES")
        out = Node(type="foreign", columns=columns, parent=self.name(), parent_columns=None, on_delete="NO ACTION", on_update="NO ACTION")
        if self.word() == "(":
            out.parent_columns = self.names()
        while True:
            if self.accept("ON", "DELETE"):
                out.on_delete = self._action()
            elif self.accept("ON", "UPDATE"):
                out.on_update = self._action()
            elif self.accept("MATCH"):
                self.name()
            elif self.accept("NOT", "DEFERRABLE") or self.accept("DEFERRABLE"):
                if self.accept("INITIALLY", "DEFERRED"):
                    out.deferred = True
                else:
                    self.accept("INITIALLY", "IMMEDIATE")
            else:
                return out

    def _action(self) -> str:
        for words in (("SET", "NULL"), ("SET", "DEFAULT"), ("NO", "ACTION"), ("CASCADE",), ("RESTRICT",)):
            if self.accept(*words):
                return " ".join(words)
        self.fail()

    def type_name(self) -> str:
        out = []
        while self.tok.kind in ("id", "qid") and self.word() not in ("CONSTRAINT", "PRIMARY", "NOT", "NULL", "UNIQUE", "CHECK", "DEFAULT", "COLLATE", "REFERENCES", "GENERATED", "AS", "AUTOINCREMENT"):
            out.append(self.name())
        if out and self.accept("("):
            args = []
            while not self.accept(")"):
                args.append(str(self.tok.value))
                self.i += 1
            out[-1] += "(" + "".join(args) + ")"
        return " ".join(out)

    def column_def(self) -> Node:
        out = Node(name=self.name(), checks=[])
        out.type = self.type_name()
        while True:
            if self.accept("CONSTRAINT"):
                self.name()
            if self.accept("PRIMARY", "KEY"):
                out.primary = True
                out.desc = self.accept("DESC") or (self.accept("ASC") and False)
                out.pk_conflict = self.conflict()
                out.autoincrement = self.accept("AUTOINCREMENT")
            elif self.accept("NOT", "NULL"):
                out.notnull = True
                out.null_conflict = self.conflict()
            elif self.accept("NULL"):
                pass
            elif self.accept("UNIQUE"):
                out.unique = True
                out.unique_conflict = self.conflict()
            elif self.word() == "CHECK":
                self.i += 1
                out.checks.append(self._check())
            elif self.accept("DEFAULT"):
                start = self.tok.at
                if self.accept("("):
                    out.default = self.expr()
                    self.expect(")")
                else:
                    out.default = self.unary()
                out.default_text = self.sql[start : self.toks[self.i - 1].end]
            elif self.accept("COLLATE"):
                out.collation = self.name().upper()
            elif self.word() == "REFERENCES":
                out.foreign = self.references([out.name])
            elif self.accept("GENERATED", "ALWAYS") or self.word() == "AS":
                self.expect("AS")
                self.expect("(")
                out.generated = self.expr()
                self.expect(")")
                out.stored = self.accept("STORED")
                self.accept("VIRTUAL")
            else:
                return out

    def _create_trigger(self) -> Node:
        exists = self.accept("IF", "NOT", "EXISTS")
        schema, name = self.qualified()
        when = "BEFORE"
        if self.accept("INSTEAD", "OF"):
            when = "INSTEAD OF"
        elif self.accept("AFTER"):
            when = "AFTER"
        else:
            self.accept("BEFORE")
        event, columns = self.name().upper(), None
        if event == "UPDATE" and self.accept("OF"):
            columns = [self.name()]
            while self.accept(","):
                columns.append(self.name())
        self.expect("ON")
        table = self.name()
        self.accept("FOR", "EACH", "ROW")
        cond = self.expr() if self.accept("WHEN") else None
        self.expect("BEGIN")
        body = []
        while not self.accept("END"):
            body.append(self.statement())
            self.expect(";")
        return Node(kind="create_trigger", exists=exists, schema=schema, name=name, when=when, event=event, columns=columns, table=table, cond=cond, body=body)

    def s_drop(self) -> Node:
        self.expect("DROP")
        what = self.name().lower()
        exists = self.accept("IF", "EXISTS")
        schema, name = self.qualified()
        return Node(kind="drop", what=what, exists=exists, schema=schema, name=name)

    def s_alter(self) -> Node:
        self.expect("ALTER", "TABLE")
        schema, table = self.qualified()
        out = Node(kind="alter", schema=schema, table=table)
        if self.accept("RENAME"):
            if self.accept("TO"):
                out.action, out.to = "rename", self.name()
            else:
                self.accept("COLUMN")
                out.action, out.column = "rename_column", self.name()
                self.expect("TO")
                out.to = self.name()
        elif self.accept("ADD"):
            self.accept("COLUMN")
            out.action, out.column = "add", self.column_def()
        else:
            self.expect("DROP")
            self.accept("COLUMN")
            out.action, out.column = "drop", self.name()
        return out

    # -- transactions and the rest
    def s_begin(self) -> Node:
        self.expect("BEGIN")
        self.accept("DEFERRED") or self.accept("IMMEDIATE") or self.accept("EXCLUSIVE")
        self.accept("TRANSACTION")
        return Node(kind="begin")

    def s_commit(self) -> Node:
        self.i += 1
        self.accept("TRANSACTION")
        return Node(kind="commit")

    s_end = s_commit

    def s_rollback(self) -> Node:
        self.i += 1
        self.accept("TRANSACTION")
        if self.accept("TO"):
            self.accept("SAVEPOINT")
            return Node(kind="rollback", to=self.name())
        return Node(kind="rollback", to=None)

    def s_savepoint(self) -> Node:
        self.i += 1
        return Node(kind="savepoint", name=self.name())

    def s_release(self) -> Node:
        self.i += 1
        self.accept("SAVEPOINT")
        return Node(kind="release", name=self.name())

    def s_pragma(self) -> Node:
        self.i += 1
        schema, name = self.qualified()
        value = None
        if self.accept("="):
            value = self._pragma_value()
        elif self.accept("("):
            value = self._pragma_value()
            self.expect(")")
        return Node(kind="pragma", schema=schema, name=name.lower(), value=value)

    def _pragma_value(self):
        sign = -1 if self.accept("-") else 1
        t = self.tok
        self.i += 1
        return sign * t.value if t.kind == "num" else t.value

    def s_attach(self) -> Node:
        self.i += 1
        self.accept("DATABASE")
        self.expr()
        self.expect("AS")
        return Node(kind="attach", name=self.name())

    def s_detach(self) -> Node:
        self.i += 1
        self.accept("DATABASE")
        return Node(kind="detach", name=self.name())

    def _plain(self) -> Node:
        kind = self.word().lower()
        self.i += 1
        name = self.qualified()[1] if self.tok.kind in ("id", "qid") else None
        return Node(kind=kind, name=name)

    s_analyze = s_reindex = s_vacuum = _plain

    # -- expressions
    def expr(self, level: int = 0):
        if level == 2:
            if self.word() == "NOT" and self.word(1) != "EXISTS":
                self.i += 1
                return ("un", "NOT", self.expr(2))
            return self.expr(3)
        if level == len(_BINARY):
            return self.postfix()
        left = self.expr(level + 1)
        while True:
            w = self.word()
            if level == 3:
                more = self.comparison(left)
                if more is not None:
                    left = more
                    continue
            if w not in _BINARY[level] or not w:
                return left
            self.i += 1
            left = ("bin", {"==": "=", "!=": "<>"}.get(w, w), left, self.expr(level + 1))

    def comparison(self, left):
        """The forms that rank with equality; None if none of them follows."""
        if self.accept("IS"):
            negated = self.accept("NOT")
            if self.accept("DISTINCT", "FROM"):
                return ("is", left, self.expr(4), not negated)
            return ("is", left, self.expr(4), negated)
        if self.accept("ISNULL"):
            return ("is", left, ("lit", None), False)
        if self.accept("NOTNULL") or self.accept("NOT", "NULL"):
            return ("is", left, ("lit", None), True)
        start, negated = self.i, self.accept("NOT")
        if self.accept("BETWEEN"):
            lo = self.expr(4)
            self.expect("AND")
            return ("between", left, lo, self.expr(4), negated)
        if self.accept("IN"):
            self.expect("(")
            if self.word() in ("SELECT", "VALUES", "WITH"):
                what = self.select_with()
            else:
                what = [] if self.word() == ")" else self.exprs()
            self.expect(")")
            return ("in", left, what, negated)
        for op in ("LIKE", "GLOB", "REGEXP", "MATCH"):
            if self.accept(op):
                right = self.expr(4)
                escape = self.expr(4) if self.accept("ESCAPE") else None
                return ("like", op, left, right, escape, negated)
        self.i = start
        return None

    def postfix(self):
        e = self.unary()
        while self.accept("COLLATE"):
            e = ("collate", e, self.name().upper())
        return e

    def unary(self):
        if self.word() in ("-", "+", "~"):
            op = self.word()
            self.i += 1
            e = self.postfix()
            if op == "-" and e[0] == "lit" and isinstance(e[1], (int, float)):
                return ("lit", -e[1] if e[1] != float(1 << 63) else -(1 << 63))
            return ("un", op, e)
        return self.primary()

    def primary(self):
        t, w = self.tok, self.word()
        if t.kind in ("num", "str", "blob"):
            self.i += 1
            return ("lit", t.value)
        if t.kind == "param":
            self.i += 1
            if t.value == "?":
                self.params += 1
                return ("param", self.params)
            if t.value[0] == "?":
                self.params = max(self.params, int(t.value[1:]))
                return ("param", int(t.value[1:]))
            return ("param", t.value)
        if self.accept("("):
            if self.word() in ("SELECT", "VALUES", "WITH"):
                s = self.select_with()
                self.expect(")")
                return ("sub", s)
            items = self.exprs()
            self.expect(")")
            return items[0] if len(items) == 1 else ("row", tuple(items))
        if w in ("NOT", "EXISTS") and (w == "EXISTS" or self.word(1) == "EXISTS"):
            negated = self.accept("NOT")
            self.expect("EXISTS", "(")
            s = self.select_with()
            self.expect(")")
            e = ("exists", s)
            return ("un", "NOT", e) if negated else e
        if self.accept("CASE"):
            base = None if self.word() == "WHEN" else self.expr()
            whens = []
            while self.accept("WHEN"):
                cond = self.expr()
                self.expect("THEN")
                whens.append((cond, self.expr()))
            other = self.expr() if self.accept("ELSE") else None
            self.expect("END")
            return ("case", base, tuple(whens), other)
        if w == "CAST" and self.word(1) == "(":
            self.i += 2
            e = self.expr()
            self.expect("AS")
            kind = self.type_name()
            self.expect(")")
            return ("cast", e, kind)
        if w == "RAISE" and self.word(1) == "(":
            self.i += 2
            action = self.name().upper()
            message = self.expr() if self.accept(",") else None
            self.expect(")")
            return ("raise", action, message)
        if w == "NULL":
            self.i += 1
            return ("lit", None)
        if w in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP") and self.word(1) != "(":
            self.i += 1
            return ("fn", w.lower(), (), Node())
        if t.kind in ("id", "qid"):
            if t.kind == "id" and w in _STOP and w not in ("LEFT", "RIGHT", "GLOB", "LIKE", "MATCH", "REGEXP", "REPLACE", "END", "FILTER", "ROWS", "RANGE", "GROUPS", "PARTITION", "OVER", "EXCLUDE", "WINDOW"):
                self.fail()
            self.i += 1
            if self.word() == "(" :
                self.i += 1
                return self.call(t.value.lower())
            if self.accept("."):
                second = self.name()
                if self.accept("."):
                    return ("col", second, self.name())
                return ("col", t.value, second)
            if w in ("TRUE", "FALSE") and t.kind == "id":
                return ("bool", w == "TRUE")
            return ("col", None, t.value, t.kind == "qid" and self.sql[t.at] == '"')
        self.fail()

    def call(self, name: str):
        opts, args = Node(), []
        if self.accept("*"):
            opts.star = True
        elif self.word() != ")":
            opts.distinct = self.accept("DISTINCT")
            args = self.exprs()
            opts.order = self.order_by()
        self.expect(")")
        if self.word() in ("IGNORE", "RESPECT") and self.word(1) == "NULLS":
            self.fail()
        if self.word() == "FILTER" and self.word(1) == "(":
            self.i += 2
            self.expect("WHERE")
            opts.filter = self.expr()
            self.expect(")")
        if self.accept("OVER"):
            opts.over = self.window() if self.word() == "(" else Node(base=self.name())
        return ("fn", name, tuple(args), opts)

    def window(self) -> Node:
        self.expect("(")
        out = Node(base=None, partition=[], order=[], frame=None)
        if self.tok.kind in ("id", "qid") and self.word() not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
            out.base = self.name()
        if self.accept("PARTITION", "BY"):
            out.partition = self.exprs()
        out.order = self.order_by()
        if self.word() in ("ROWS", "RANGE", "GROUPS"):
            mode = self.word()
            self.i += 1
            if self.accept("BETWEEN"):
                lo = self.bound()
                self.expect("AND")
                hi = self.bound()
            else:
                lo, hi = self.bound(), ("CURRENT", None)
            exclude = None
            if self.accept("EXCLUDE"):
                exclude = next((x for x in (("NO", "OTHERS"), ("CURRENT", "ROW"), ("GROUP",), ("TIES",)) if self.accept(*x)), None) or self.fail()
                exclude = None if exclude == ("NO", "OTHERS") else " ".join(exclude)
            out.frame = Node(mode=mode, lo=lo, hi=hi, exclude=exclude)
        self.expect(")")
        return out

    def bound(self):
        if self.accept("UNBOUNDED"):
            return ("UNBOUNDED " + ("PRECEDING" if self.accept("PRECEDING") else (self.expect("FOLLOWING") or "FOLLOWING")), None)
        if self.accept("CURRENT", "ROW"):
            return ("CURRENT", None)
        e = self.expr(3)
        return ("PRECEDING" if self.accept("PRECEDING") else (self.expect("FOLLOWING") or "FOLLOWING"), e)


def parse(sql: str) -> list[Node]:
    return Parser(sql).script()
