"""Typed SQL expressions of the dialect and the rules for numbers, text, truth and comparison.

An E carries Spark SQL text with its storage class, which is known when a statement is lowered: null, int (BIGINT), real (DOUBLE),
text (STRING), blob (BINARY), bool (a predicate, an integer 0 or 1 to the dialect) or ts (a timestamp of an outside table, text to
the dialect). any is text whose class varies from row to row, as JSON functions give it.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple


class _Missing:
    pass


MISSING = _Missing()


class E(NamedTuple):
    sql: str
    t: str
    aff: str = ""
    coll: str = ""
    const: object = MISSING
    json: bool = False


NUMERIC = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\Z")
_SPARK = {"null": "STRING", "int": "BIGINT", "real": "DOUBLE", "text": "STRING", "blob": "BINARY", "bool": "BIGINT", "ts": "STRING", "any": "STRING"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(s: str) -> str:
    return "`" + s.replace("`", "``") + "`"


def literal(v) -> E:
    if v is None:
        return E("CAST(NULL AS STRING)", "null", const=None)
    if isinstance(v, bool):
        return E(str(int(v)) + "L", "int", const=int(v))
    if isinstance(v, int):
        sql = f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L - 1L)"
        return E(sql if v >= 0 or v == -(1 << 63) else f"({sql})", "int", const=v)
    if isinstance(v, float):
        if math.isnan(v):
            return literal(None)
        if math.isinf(v):
            return E(f"CAST('{'-' if v < 0 else ''}Infinity' AS DOUBLE)", "real", const=v)
        return E(f"CAST('{v!r}' AS DOUBLE)", "real", const=v)
    if isinstance(v, (bytes, bytearray)):
        return E(f"X'{bytes(v).hex()}'", "blob", const=bytes(v))
    return E(quote(v), "text", const=v)


def affinity(declared: str | None) -> str:
    d = (declared or "").upper()
    if "INT" in d:
        return "INTEGER"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "TEXT"
    if not d or "BLOB" in d:
        return "BLOB"
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return "REAL"
    return "NUMERIC"


def spark_type(t: str) -> str:
    return _SPARK[t]


def real_text(x: float) -> str:
    """A real as text, 15 significant digits, with a point or an exponent."""
    if math.isinf(x):
        return "Inf" if x > 0 else "-Inf"
    s = f"{x:.15g}"
    if "e" in s:
        m, e = s.split("e")
        return f"{m if '.' in m else m + '.0'}e{e}"
    return s if "." in s else s + ".0"


def text(e: E) -> str:
    if e.const is not MISSING and e.t in ("int", "real"):
        return quote(str(e.const) if e.t == "int" else real_text(e.const))
    if e.t in ("text", "any", "null"):
        return e.sql
    if e.t == "ts":
        return f"date_format({e.sql}, 'yyyy-MM-dd HH:mm:ss')"
    if e.t == "bool":
        return f"CAST(CAST({e.sql} AS BIGINT) AS STRING)"
    if e.t == "blob":
        return f"decode({e.sql}, 'UTF-8')"
    if e.t == "real":
        s = f"CAST({e.sql} AS STRING)"
        return f"(CASE WHEN abs({e.sql}) >= 1e-4D AND abs({e.sql}) < 1e7D OR {e.sql} = 0D THEN {s} WHEN abs({e.sql}) >= 1e7D AND abs({e.sql}) < 1e15D THEN regexp_replace(format_number({e.sql}, '0.0###############'), ',', '') ELSE regexp_replace(regexp_replace({s}, 'E(\\\\d)', 'e+$1'), 'E-', 'e-') END)"
    return f"CAST({e.sql} AS STRING)"


def number(e: E) -> E:
    """The numeric value; text counts as its longest numeric start, 0 if there is none."""
    if e.t in ("int", "real"):
        return e._replace(aff="", coll="")
    if e.t == "null":
        return E("CAST(NULL AS BIGINT)", "int", const=None)
    if e.t == "bool":
        return E(f"CAST({e.sql} AS BIGINT)", "int")
    if e.const is not MISSING and e.t == "text":
        m = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", e.const)
        s = m.group().strip() if m else "0"
        return literal(float(s) if re.search("[.eE]", s) else int(s))
    head = f"regexp_extract({text(e)}, '^\\\\s*([+-]?(\\\\d+\\\\.?\\\\d*|\\\\.\\\\d+)([eE][+-]?\\\\d+)?)', 1)"
    return E(f"(CASE WHEN {e.sql} IS NULL THEN NULL ELSE coalesce(try_cast({head} AS DOUBLE), 0D) END)", "real")


def integer(e: E) -> str:
    e = number(e)
    return e.sql if e.t == "int" else f"try_cast({e.sql} AS BIGINT)"


def real(e: E) -> str:
    e = number(e)
    return e.sql if e.t == "real" else f"CAST({e.sql} AS DOUBLE)"


def truth(e: E) -> str:
    """A Spark predicate: not zero; text by its numeric start."""
    if e.t == "bool":
        return e.sql
    if e.t == "null":
        return "CAST(NULL AS BOOLEAN)"
    n = number(e)
    return f"({n.sql} <> 0)"


def value(e: E) -> str:
    """The expression as the dialect sees it, in its Spark type."""
    if e.t == "bool":
        return f"CAST({e.sql} AS BIGINT)"
    return text(e) if e.t == "ts" else e.sql


def cast_to(e: E, t: str) -> str:
    if e.t == t or (e.t, t) in (("any", "text"), ("text", "any")):
        return e.sql
    if e.t == "null":
        return f"CAST(NULL AS {spark_type(t)})"
    if t in ("text", "any"):
        return text(e)
    if t == "real":
        return real(e)
    if t == "int":
        return integer(e)
    if t == "blob":
        return f"CAST({text(e)} AS BINARY)"
    return value(e)


_RANK = {"int": 0, "bool": 0, "real": 1, "any": 2, "ts": 2, "text": 2, "blob": 3}


def unify(types: list[str]) -> str:
    """The common class: the wider number, else text; blobs only among themselves."""
    seen = [t for t in types if t != "null"]
    if not seen:
        return "null"
    if len(set(seen)) == 1:
        return {"bool": "int", "ts": "text"}.get(seen[0], seen[0])
    top = max(seen, key=_RANK.get)
    return {"bool": "int", "ts": "text"}.get(top, top)


def collate(sql: str, coll: str) -> str:
    if coll == "NOCASE":
        return f"translate({sql}, '{UPPER}', '{LOWER}')"
    if coll == "RTRIM":
        return f"rtrim({sql})"
    return sql


def _numeric_side(e: E) -> bool:
    return e.aff in ("INTEGER", "REAL", "NUMERIC")


def aligned(a: E, b: E) -> tuple[str, str] | int:
    """Both operands as Spark text of one type, or, where the classes settle it, -1 or 1 for the order."""
    num = ("int", "real", "bool")
    coll = a.coll or b.coll or "BINARY"
    if a.t == "ts" or b.t == "ts":
        x, y = (a, b) if a.t == "ts" else (b, a)
        if y.t == "ts":
            return a.sql, b.sql
        if y.t == "text" and y.const is not MISSING and re.match(r"\d{4}-\d\d-\d\d( \d\d:\d\d(:\d\d)?)?$", y.const):
            other = f"TIMESTAMP_NTZ {quote(y.const if len(y.const) > 10 else y.const + ' 00:00:00')}"
            if len(y.const) > 10:
                return (x.sql, other) if x is a else (other, x.sql)
        return (text(a), text(b)) if y.t in ("text", "any", "null") else (1 if x is a else -1)
    if a.t == "null" or b.t == "null":
        t = b.t if a.t == "null" else a.t
        return cast_to(a, "int" if t == "bool" else t), cast_to(b, "int" if t == "bool" else t)
    if a.t in num and b.t in num:
        if "real" in (a.t, b.t):
            return real(a), real(b)
        return integer(a), integer(b)
    if a.t in ("text", "any") and b.t in ("text", "any"):
        return collate(a.sql, coll), collate(b.sql, coll)
    if a.t == b.t == "blob":
        return a.sql, b.sql
    if "blob" in (a.t, b.t):
        return 1 if a.t == "blob" else -1
    # number against text
    n, s = (a, b) if a.t in num else (b, a)
    if _numeric_side(n) or s.t == "any":
        if s.const is not MISSING:
            if NUMERIC.match(s.const):
                v = number(s)
                pair = (real(n), real(v)) if "real" in (n.t, v.t) else (integer(n), v.sql)
                return pair if n is a else pair[::-1]
        else:
            x, y = real(n), f"coalesce(try_cast({s.sql} AS DOUBLE), CAST(if({s.sql} IS NULL, NULL, 'Infinity') AS DOUBLE))"
            return (x, y) if n is a else (y, x)
    elif s.aff == "TEXT":
        x, y = text(n), s.sql
        return (collate(x, coll), collate(y, coll)) if n is a else (collate(y, coll), collate(x, coll))
    return -1 if n is a else 1


_FLIP = {"=": lambda c: False, "<>": lambda c: True, "<": lambda c: c < 0, "<=": lambda c: c < 0, ">": lambda c: c > 0, ">=": lambda c: c > 0}


def compare(op: str, a: E, b: E) -> E:
    pair = aligned(a, b)
    if isinstance(pair, int):
        known = "TRUE" if _FLIP[op](pair) else "FALSE"
        return E(f"(CASE WHEN {a.sql} IS NOT NULL AND {b.sql} IS NOT NULL THEN {known} END)", "bool")
    return E(f"({pair[0]} {op} {pair[1]})", "bool")


def same(a: E, b: E) -> E:
    """IS: equal, and NULL equal to NULL."""
    pair = aligned(a, b)
    if isinstance(pair, int):
        return E(f"({a.sql} IS NULL AND {b.sql} IS NULL)", "bool")
    return E(f"({pair[0]} <=> {pair[1]})", "bool")


def arithmetic(op: str, a: E, b: E) -> E:
    a, b = number(a), number(b)
    whole = a.t == b.t == "int"
    if op in "+-*" and whole and all(isinstance(x.const, int) for x in (a, b)):
        exact = {"+": a.const + b.const, "-": a.const - b.const, "*": a.const * b.const}[op]
        return literal(exact if -(1 << 63) <= exact < 1 << 63 else float(exact))
    if op in "+-*":
        f = {"+": "try_add", "-": "try_subtract", "*": "try_multiply"}[op]
        return E(f"{f}({a.sql}, {b.sql})", "int") if whole else E(f"({real(a)} {op} {real(b)})", "real")
    if op == "/":
        return E(f"({a.sql} div nullif({b.sql}, 0L))", "int") if whole else E(f"({real(a)} / nullif({real(b)}, 0D))", "real")
    if op == "%":
        out = f"try_mod({integer(a)}, {integer(b)})"
        return E(out, "int") if whole else E(f"CAST({out} AS DOUBLE)", "real")
    x, y = integer(a), integer(b)
    if op in "&|":
        return E(f"({x} {op} {y})", "int")
    left, right = f"shiftleft({x}, CAST(abs({y}) AS INT))", f"shiftright({x}, CAST(least(abs({y}), 63L) AS INT))"
    left = f"(CASE WHEN abs({y}) >= 64 THEN 0L ELSE {left} END)"
    return E(f"(CASE WHEN {y} >= 0 THEN {left if op == '<<' else right} ELSE {right if op == '<<' else left} END)", "int")


def cast(e: E, declared: str) -> E:
    aff = affinity(declared)
    if aff == "TEXT":
        return E(text(e), "text", "TEXT", json=False)
    if aff == "BLOB":
        return E(e.sql if e.t == "blob" else f"CAST({text(e)} AS BINARY)", "blob", "BLOB")
    n = number(e if e.t != "blob" else E(text(e), "text"))
    if aff == "INTEGER":
        sql = n.sql if n.t == "int" else f"CAST(CASE WHEN {n.sql} >= 9.2e18D THEN 9223372036854775807L WHEN {n.sql} <= -9.2e18D THEN -9223372036854775807L - 1L ELSE {n.sql} END AS BIGINT)"
        return E(sql, "int", "INTEGER", const=int(n.const) if n.const not in (MISSING, None) and n.t == "int" else MISSING)
    if aff == "REAL":
        return E(real(n), "real", "REAL")
    return E(n.sql, n.t, "NUMERIC")
