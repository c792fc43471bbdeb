"""What Spark has no expression for: Arrow-batched functions, registered by name on a session."""

from __future__ import annotations

import re
import struct

import pandas as pd
import pyarrow as pa
from larkspur.functions import json_text as j
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_TEXT = {}


def _text(kind="string"):
    def add(f):
        _TEXT[f.__name__] = f, kind
        return f

    return add


def _doc(s):
    return j.from_jsonb(bytes(s)) if isinstance(s, (bytes, bytearray)) else j.quick(s)


@_text()
def lk_json(s):
    return j.text(_doc(s))


@_text("binary")
def lk_jsonb(s):
    return j.jsonb(_doc(s))


@_text("string")
def lk_from_jsonb(b):
    return j.text(j.from_jsonb(bytes(b)))


@_text()
def lk_json_extract(s, path):
    return j.sql_value(j.get(_doc(s), j.steps(path)))


@_text()
def lk_json_arrow(s, path):
    x = j.get(_doc(s), j.steps(path))
    return None if j.missing(x) else j.text(x)


@_text()
def lk_json_extract_many(s, paths):
    d = _doc(s)
    got = [j.get(d, j.steps(p)) for p in paths]
    return j.text([None if j.missing(x) else x for x in got])


@_text()
def lk_json_change(s, mode, pairs):
    d = _doc(s)
    for p, x in zip(pairs[::2], pairs[1::2]):
        path, value = j.steps(p), j.parse(x)
        if mode == "array_insert":
            d = j.array_insert(d, path, value)
        else:
            d = j.change(d, path, value, mode != "replace", mode != "insert")
    return j.text(d)


@_text()
def lk_json_remove(s, paths):
    d = _doc(s)
    for p in paths:
        d = j.remove(d, j.steps(p))
        if j.missing(d):
            return None
    return j.text(d)


@_text()
def lk_json_patch(s, patch):
    return j.text(j.merge_patch(_doc(s), _doc(patch)))


@_text()
def lk_json_type(s, path):
    x = j.get(_doc(s), j.steps(path))
    return None if j.missing(x) else j.kind(x)


@_text("bigint")
def lk_json_valid(s, flags):
    if isinstance(s, (bytes, bytearray)):
        try:
            j.from_jsonb(bytes(s))
        except (ValueError, IndexError):
            return 0
        return int(bool(flags & 12))
    for bit, strict in ((1, True), (2, False)):
        if flags & bit:
            try:
                j.parse(s, strict)
                return 1
            except ValueError:
                pass
    return 0


@_text("bigint")
def lk_json_error_position(s):
    try:
        j.parse(s)
        return 0
    except j.Bad as e:
        return e.at + 1


@_text("bigint")
def lk_json_array_length(s, path):
    x = j.get(_doc(s), j.steps(path))
    if j.missing(x):
        return None
    return len(x) if isinstance(x, list) and not isinstance(x, j.Obj) else 0


@_text()
def lk_json_pretty(s, indent):
    return j.pretty(_doc(s), indent)


@_text()
def lk_char(points):
    return "".join(chr(p) if p < 0x110000 else "�" for p in points if p is not None and p > 0)


@_text()
def lk_unistr(s):
    def one(m):
        return "\\" if m[0] == "\\\\" else chr(int(next(g for g in m.groups() if g), 16))

    out = re.sub(r"\\\\|\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\\+([0-9a-fA-F]{6})|\\([0-9a-fA-F]{4})", one, s)
    return out


@_text()
def lk_printf(fmt, args):
    """printf of the dialect; arguments come as text."""
    args, at = [] if args is None else list(args), 0

    def take():
        nonlocal at
        at += 1
        return args[at - 1] if at <= len(args) else None

    def num(x):
        m = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x or "")
        return float(m.group()) if m else 0.0

    def whole(x):
        m = re.fullmatch(r"\s*([+-]?\d+)\s*", x or "")
        return int(m[1]) if m else int(num(x))

    def one(m):
        flags, width, prec, kind = m[1], m[2], m[3], m[4]
        if kind == "%":
            return "%"
        if width == "*":
            width = str(whole(take()))
            if width[0] == "-":
                flags, width = flags + "-", width[1:]
        if prec == "*":
            prec = str(whole(take()))
        x = take()
        if kind in "di":
            n = whole(x)
            body = str(abs(n))
            if "," in flags:
                body = f"{abs(n):,}"
            if prec:
                body = body.rjust(int(prec), "0")
            sign = "-" if n < 0 else "+" if "+" in flags else " " if " " in flags else ""
        elif kind in "uxXo":
            n = whole(x) % (1 << 64)
            body, sign = {"u": f"{n}", "x": f"{n:x}", "X": f"{n:X}", "o": f"{n:o}"}[kind], ""
            if "#" in flags and n:
                body = {"x": "0x", "X": "0X", "o": "0"}.get(kind, "") + body
        elif kind in "feEgG":
            n = num(x)
            body = f"{abs(n):{',' if ',' in flags else ''}.{int(prec) if prec else 6}{kind}}"
            if "#" not in flags and "!" in flags and "." not in body:
                body += ".0"
            sign = "-" if n < 0 else "+" if "+" in flags else " " if " " in flags else ""
        elif kind == "c":
            body, sign = (x or "")[:1] * (int(prec) if prec else 1), ""
        else:
            s = "" if x is None else x
            if kind in "qQw":
                s = s.replace("'", "''") if kind != "w" else s.replace('"', '""')
                s = ("NULL" if x is None else f"'{s}'") if kind == "Q" else "(NULL)" if x is None and kind == "q" else s
            body, sign = s[: int(prec)] if prec else s, ""
        if width and len(sign + body) < int(width):
            if "-" in flags:
                return (sign + body).ljust(int(width))
            if "0" in flags and kind in "dixXoufeEgG":
                return sign + body.rjust(int(width) - len(sign), "0")
            return (sign + body).rjust(int(width))
        return sign + body

    return re.sub(r"%([-+ 0#,!]*)(\d+|\*)?(?:\.(\d+|\*))?(?:ll|l)?([diuxXofeEgGcsqQwz%])", one, fmt)


@_text()
def lk_fold(s):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()


@_text("bigint")
def lk_ieee_mantissa(x):
    return j.ieee754(x)[0]


@_text("bigint")
def lk_ieee_exponent(x):
    return j.ieee754(x)[1]


@_text("double")
def lk_ieee_make(m, e):
    try:
        return float(m) * 2.0**e if abs(e) < 1000 else float(m) * 2.0 ** (e / 2) * 2.0 ** (e - e / 2)
    except OverflowError:
        return float("inf") if m > 0 else float("-inf")


@_text("binary")
def lk_ieee_blob(x):
    return struct.pack(">d", x)


@_text("double")
def lk_ieee_from_blob(b):
    return struct.unpack(">d", bytes(b))[0] if len(b) == 8 else None


@_text("double")
def lk_ieee_inc(x, n):
    bits = (struct.unpack(">Q", struct.pack(">d", x))[0] + int(n)) & (1 << 64) - 1
    out = struct.unpack(">d", struct.pack(">Q", bits))[0]
    return None if out != out else out


def _batched(f, kind):
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            if row[0] is None or (isinstance(row[0], float) and row[0] != row[0]):
                out.append(None)
            else:
                out.append(f(*row))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)


_ROWS = "array<struct<key:string,value:string,type:string,atom:string,id:bigint,parent:bigint,fullkey:string,path:string>>"


def _rows(tree: bool):
    """json_each or json_tree of a batch of documents, as arrays that inline() turns into rows."""

    def run(docs: pa.Array, paths: pa.Array) -> pa.Array:
        names, kinds = [n for n, _ in EACH], [pa.int64() if t == "int" else pa.string() for _, t in EACH]
        columns, offsets = [[] for _ in names], [0]
        for doc, path in zip(docs.to_pylist(), paths.to_pylist()):
            if doc is not None and path is not None:
                d = _doc(doc)
                x = d if path == "$" else j.get(d, j.steps(path))
                for row in () if j.missing(x) else j.rows(x, path, tree):
                    for column, value in zip(columns, row):
                        column.append(value)
            offsets.append(len(columns[0]))
        table = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table)

    return F.arrow_udf(run, _ROWS)


EACH = (("key", "any"), ("value", "any"), ("type", "text"), ("atom", "any"), ("id", "int"), ("parent", "int"), ("fullkey", "text"), ("path", "text"))


def register(spark: SparkSession) -> None:
    """Registers all functions once for a session."""
    if getattr(spark, "_larkspur_udfs", False):
        return
    from larkspur.functions import fts

    for name, (f, kind) in _TEXT.items():
        spark.udf.register(name, _batched(f, kind))
    spark.udf.register("lk_json_each", _rows(False))
    spark.udf.register("lk_json_tree", _rows(True))
    for name, (f, kind) in fts.FUNCTIONS.items():
        spark.udf.register(name, _batched(f, kind))
    spark._larkspur_udfs = True
