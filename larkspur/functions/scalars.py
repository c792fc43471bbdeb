"""Scalar and table-valued functions of the dialect as Spark SQL."""

from __future__ import annotations

import re

from larkspur.errors import SqlError
from larkspur.functions import dates, udfs
from larkspur.functions import values as v
from larkspur.functions.aggregates import json_value
from larkspur.functions.values import MISSING, E

VERSION = "3.50.0"


def like(args: list[E], case_sensitive: bool = False) -> E:
    p, x = v.text(args[0]), v.text(args[1])
    escape = args[2].const if len(args) > 2 else None
    if escape is not None and len(escape) != 1:
        raise SqlError("ESCAPE expression must be a single character")
    if not case_sensitive:
        p, x = v.collate(p, "NOCASE"), v.collate(x, "NOCASE")
        if escape is not None:
            escape = escape.lower()
    if args[0].const is not MISSING and isinstance(args[0].const, str) and escape is None and "\\" not in args[0].const:
        lit = args[0].const if case_sensitive else "".join(c.lower() if c.isascii() else c for c in args[0].const)
        return E(f"({x} LIKE {v.quote(lit)})", "bool")
    if escape is not None and isinstance(args[0].const, str):  # Spark lets the escape stand only before a wildcard
        pattern, out, i = args[0].const, "", 0
        while i < len(pattern):
            c = pattern[i]
            if c == args[2].const and i + 1 < len(pattern):
                c, i = pattern[i + 1], i + 1
                out += f"\\{c}" if c in "%_\\" else c
            else:
                out += "\\\\" if c == "\\" else c
            i += 1
        if not case_sensitive:
            out = "".join(c.lower() if c.isascii() else c for c in out)
        return E(f"({x} LIKE {v.quote(out)})", "bool")
    if escape is None:  # no character escapes: backslashes stand for themselves
        p = f"replace({p}, '\\\\', '\\\\\\\\')"
        return E(f"({x} LIKE {p} ESCAPE '\\\\')", "bool")
    return E(f"({x} LIKE {p} ESCAPE {v.quote(escape)})", "bool")


def glob_regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif c == "[":
            j = i + 1
            negated = pattern[j : j + 1] in ("^", "!")
            j += negated
            end = pattern.find("]", j + 1)
            if end < 0:
                return "(?!)"
            body = re.sub(r"([\\\[&^])", r"\\\1", pattern[j:end])
            body = "\\]" + body[1:] if body[:1] == "]" else body
            out += f"[{'^' if negated else ''}{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$" if not out.endswith("$") else f"^(?:{out})$"


def glob(args: list[E]) -> E:
    p, x = args[0], v.text(args[1])
    if p.const is None:
        return E("CAST(NULL AS BOOLEAN)", "bool")
    if p.const is MISSING:
        body = f"regexp_replace(regexp_replace(regexp_replace({v.text(p)}, '([.+(){{}}|$\\\\\\\\])', '\\\\\\\\$1'), '\\\\*', '[\\\\\\\\s\\\\\\\\S]*'), '\\\\?', '[\\\\\\\\s\\\\\\\\S]')"
        return E(f"({x} RLIKE concat('^', {body}, '$'))", "bool")
    return E(f"({x} RLIKE {v.quote(glob_regex(str(p.const)))})", "bool")


def _path(p: E, arrow: bool = False) -> str | None:
    """A constant JSON path in full form."""
    if p.const is MISSING:
        return None
    if isinstance(p.const, int):
        return f"$[{p.const}]" if p.const >= 0 else f"$[#{p.const}]"
    if isinstance(p.const, str) and arrow and not p.const.startswith("$"):
        return "$." + (p.const if re.fullmatch(r"[A-Za-z_]\w*", p.const) else f'"{p.const}"')
    return p.const


def _doc(x: E) -> str:
    return x.sql if x.t == "blob" else v.text(x)


def _jpath(p: E, arrow: bool = False) -> str:
    got = _path(p, arrow)
    return v.quote(got) if got is not None else v.text(p) if not arrow else f"concat('$.', {v.text(p)})" if p.t != "int" else f"concat('$[', {v.text(p)}, ']')"


_SIMPLE = re.compile(r"\$(\.[A-Za-z_]\w*|\[\d+\])+$")


def arrow(op: str, x: E, p: E) -> E:
    path = _path(p, True)
    if op == "->>" and path is not None and _SIMPLE.match(path) and x.t != "blob":
        return E(f"get_json_object({v.text(x)}, {v.quote(path)})", "any")
    if op == "->>":
        return E(f"lk_json_extract({_doc(x)}, {_jpath(p, True)})", "any")
    return E(f"lk_json_arrow({_doc(x)}, {_jpath(p, True)})", "text", json=True)


def _extract(xs, db):
    if len(xs) == 2:
        path = _path(xs[1])
        if path is not None and _SIMPLE.match(path) and xs[0].t != "blob":
            raw = f"get_json_object({v.text(xs[0])}, {v.quote(path)})"
            return E(f"(CASE {raw} WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE {raw} END)", "any")
        return E(f"lk_json_extract({_doc(xs[0])}, {_jpath(xs[1])})", "any")
    return E(f"lk_json_extract_many({_doc(xs[0])}, array({', '.join(_jpath(p) for p in xs[1:])}))", "text", json=True)


def _changed(mode):
    def f(xs, db):
        if len(xs) % 2 == 0:
            raise SqlError(f"json_{mode}() needs an odd number of arguments", "arguments")
        pairs = ", ".join(f"{_jpath(p)}, {json_value(x)}" for p, x in zip(xs[1::2], xs[2::2]))
        return E(f"lk_json_change({_doc(xs[0])}, '{mode}', array({pairs}))", "text", json=True)

    return f


def _blob(f):
    return lambda xs, db: E(f"lk_jsonb({f(xs, db).sql})", "blob", json=False)


def _object(xs, db):
    if len(xs) % 2:
        raise SqlError("json_object() requires an even number of arguments", "arguments")
    parts = []
    for k, x in zip(xs[::2], xs[1::2]):
        key = f"to_json(array({v.text(k)}))"
        parts.append(f"concat(substr({key}, 2, length({key}) - 2), ':', {json_value(x)})")
    return E(f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')" if parts else "'{}'", "text", json=True)


def _array(xs, db):
    return E(f"concat('[', concat_ws(',', {', '.join(map(json_value, xs))}), ']')" if xs else "'[]'", "text", json=True)


def _extreme(f):
    def out(xs, db):
        t = v.unify([x.t for x in xs])
        args = [v.cast_to(x, t) for x in xs]
        null = " OR ".join(f"{x.sql} IS NULL" for x in xs)
        return E(f"(CASE WHEN {null} THEN NULL ELSE {f}({', '.join(args)}) END)", t)

    return out


def _coalesce(xs, db):
    t = v.unify([x.t for x in xs])
    return E(f"coalesce({', '.join(v.cast_to(x, t) for x in xs)})", t, xs[0].aff)


def _iif(xs, db):
    t = v.unify([x.t for x in xs[1:]])
    return E(f"(CASE WHEN {v.truth(xs[0])} THEN {v.cast_to(xs[1], t)} ELSE {v.cast_to(xs[2], t) if len(xs) > 2 else 'NULL'} END)", t)


_CLASS = {"int": "integer", "bool": "integer", "real": "real", "text": "text", "ts": "text", "blob": "blob", "null": "null"}


def _typeof(xs, db):
    x = xs[0]
    if x.t == "any":
        n = f"{x.sql} RLIKE '^-?[0-9]+$'"
        return E(f"(CASE WHEN {x.sql} IS NULL THEN 'null' WHEN {n} THEN 'integer' WHEN try_cast({x.sql} AS DOUBLE) IS NOT NULL THEN 'real' ELSE 'text' END)", "text")
    return E(f"(CASE WHEN {x.sql} IS NULL THEN 'null' ELSE '{_CLASS[x.t]}' END)", "text")


def _length(xs, db):
    x = xs[0]
    return E(f"CAST(length({x.sql if x.t == 'blob' else v.text(x)}) AS BIGINT)", "int")


def _substr(xs, db):
    x = xs[0]
    s, kind = (x.sql, "blob") if x.t == "blob" else (v.text(x), "text")
    start = v.integer(xs[1])
    if len(xs) == 2:
        if isinstance(xs[1].const, int) and xs[1].const > 0:
            return E(f"substring({s}, {xs[1].const})", kind)
        size = f"length({s})"
        return E(f"substring({s}, CAST(CASE WHEN {start} < -{size} THEN 1 ELSE {start} END AS INT))", kind)
    if all(isinstance(a.const, int) and a.const > 0 for a in xs[1:3]):
        return E(f"substring({s}, {xs[1].const}, {xs[2].const})", kind)
    n, size = v.integer(xs[2]), f"length({s})"
    # one-based first and last character taken, before clipping
    first = f"(CASE WHEN {start} > 0 THEN {start} WHEN {start} = 0 THEN 0L ELSE {size} + {start} + 1 END)"
    lo = f"(CASE WHEN {n} >= 0 THEN {first} ELSE {first} + {n} END)"
    hi = f"(CASE WHEN {n} >= 0 THEN {first} + {n} - 1 ELSE {first} - 1 END)"
    return E(f"substring({s}, CAST(greatest({lo}, 1L) AS INT), CAST(greatest(least({hi}, {size}) - greatest({lo}, 1L) + 1, 0L) AS INT))", kind)


def _trim(how):
    def f(xs, db):
        chars = v.text(xs[1]) if len(xs) > 1 else "' '"
        return E(f"trim({how} {chars} FROM {v.text(xs[0])})", "text")

    return f


def _round(xs, db):
    n = 0
    if len(xs) > 1:
        if not isinstance(xs[1].const, (int, float)):
            raise SqlError("round() takes a constant number of digits here")
        n = min(30, max(0, int(xs[1].const)))
    return E(f"round({v.real(xs[0])}, {n})", "real")


def _instr(xs, db):
    a, b = xs
    if a.t == b.t == "blob":
        return E(f"CAST(CASE WHEN length({b.sql}) = 0 THEN 1 ELSE (instr(hex({a.sql}), hex({b.sql})) + 1) div 2 END AS BIGINT)", "int")
    return E(f"CAST(instr({v.text(a)}, {v.text(b)}) AS BIGINT)", "int")


def _hex(xs, db):
    x = xs[0]
    return E(f"coalesce(hex({x.sql if x.t == 'blob' else f'CAST({v.text(x)} AS BINARY)'}), '')", "text")


def _unhex(xs, db):
    s = v.text(xs[0])
    if len(xs) > 1:
        s = f"translate({s}, {v.text(xs[1])}, '')"
    return E(f"(CASE WHEN {s} RLIKE '^([0-9a-fA-F]{{2}})*$' THEN unhex({s}) END)", "blob")


def _quoted(xs, db):
    x = xs[0]
    if x.t in ("int", "bool", "real"):
        return E(f"coalesce({v.text(x)}, 'NULL')", "text")
    if x.t == "blob":
        return E(f"coalesce(concat('X\\'', hex({x.sql}), '\\''), 'NULL')", "text")
    return E(f"coalesce(concat('\\'', replace({v.text(x)}, '\\'', '\\'\\''), '\\''), 'NULL')", "text")


def _printf(xs, db):
    if not xs:
        return v.literal(None)
    args = ", ".join(v.text(x) for x in xs[1:])
    return E(f"lk_printf({v.text(xs[0])}, {f'array({args})' if args else 'CAST(array() AS ARRAY<STRING>)'})", "text")


def _math(f, out="real"):
    """A function of numbers: NULL for text that is no number and for NaN."""

    def g(xs, db):
        args = []
        for x in xs:
            args.append(v.real(x) if x.t in ("int", "real", "bool") else f"try_cast({v.text(x)} AS DOUBLE)" if x.t != "null" else "CAST(NULL AS DOUBLE)")
        sql = f(*args) if callable(f) else f"{f}({', '.join(args)})"
        return E(f"nanvl({sql}, CAST(NULL AS DOUBLE))" if out == "real" else sql, out)

    return g


def _whole(f):
    def g(xs, db):
        n = v.number(xs[0]) if xs[0].t not in ("text", "any") else E(f"try_cast({v.text(xs[0])} AS DOUBLE)", "real")
        return n if n.t == "int" else E(f(n.sql), "real")

    return g


def _abs(xs, db):
    n = v.number(xs[0])
    return E(f"abs({n.sql})", n.t)


def _time(make, fine=False):
    def f(xs, db):
        ts = dates.moment(xs[0] if xs else None, xs[1:], db.now)
        sub = any(isinstance(x.const, str) and x.const.lower() in ("subsec", "subsecond") for x in xs[1:])
        return make(ts, sub) if fine else make(ts)

    return f


def _strftime(xs, db):
    return dates.strftime(xs[0], dates.moment(xs[1] if len(xs) > 1 else None, xs[2:], db.now))


def _fixed(sql, t):
    return lambda xs, db: E(sql, t)


def _fails(message, kind="misuse"):
    def f(xs, db):
        raise SqlError(message, kind)

    return f


def _counter(name):
    return lambda xs, db: v.literal(getattr(db, name))


def _json_valid(xs, db):
    if len(xs) == 1 and xs[0].t != "blob":
        return E(f"CAST(coalesce(lk_json_valid({v.text(xs[0])}, 1), 0L) AS BIGINT)", "int")
    return E(f"coalesce(lk_json_valid({_doc(xs[0])}, CAST({v.integer(xs[1]) if len(xs) > 1 else 5} AS INT)), 0L)", "int")


_UUID = "lower(regexp_replace({}, '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '$1-$2-$3-$4-$5'))"

def _uuid(seed: int) -> E:
    """A version 4 UUID drawn from the seed."""
    drawn = f"sha2(CAST(rand({seed}) AS STRING), 256)"
    return E(f"regexp_replace({drawn}, '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}}).*$', '$1-$2-4$3-a$4-$5')", "text")


#: name: (least, most arguments, lowering); most -1 is no limit
FUNCTIONS = {
    "abs": (1, 1, _abs), "coalesce": (2, -1, _coalesce), "ifnull": (2, 2, _coalesce),
    "nullif": (2, 2, lambda xs, db: E(f"(CASE WHEN {v.compare('=', xs[0], xs[1]).sql} THEN NULL ELSE {v.value(xs[0])} END)", {"bool": "int", "ts": "text"}.get(xs[0].t, xs[0].t))),
    "iif": (2, 3, _iif), "if": (2, 3, _iif), "typeof": (1, 1, _typeof), "length": (1, 1, _length),
    "octet_length": (1, 1, lambda xs, db: E(f"CAST(octet_length({xs[0].sql if xs[0].t == 'blob' else v.text(xs[0])}) AS BIGINT)", "int")),
    "lower": (1, 1, lambda xs, db: E(v.collate(v.text(xs[0]), "NOCASE"), "text")),
    "upper": (1, 1, lambda xs, db: E(f"translate({v.text(xs[0])}, '{v.LOWER}', '{v.UPPER}')", "text")),
    "trim": (1, 2, _trim("BOTH")), "ltrim": (1, 2, _trim("LEADING")), "rtrim": (1, 2, _trim("TRAILING")),
    "substr": (2, 3, _substr), "substring": (2, 3, _substr), "replace": (3, 3, lambda xs, db: E(f"replace({', '.join(map(v.text, xs))})", "text")),
    "instr": (2, 2, _instr), "round": (1, 2, _round), "min": (2, -1, _extreme("least")), "max": (2, -1, _extreme("greatest")), "hex": (1, 1, _hex), "unhex": (1, 2, _unhex),
    "quote": (1, 1, _quoted), "char": (0, -1, lambda xs, db: E(f"lk_char(array({', '.join(map(v.integer, xs)) or 'CAST(NULL AS BIGINT)'}))", "text")),
    "unicode": (1, 1, lambda xs, db: E(f"CAST(CASE WHEN {v.text(xs[0])} <> '' THEN ascii({v.text(xs[0])}) END AS BIGINT)", "int")),
    "concat": (1, -1, lambda xs, db: E("concat(" + ", ".join(f"coalesce({v.text(x)}, '')" for x in xs) + ")", "text")),
    "concat_ws": (2, -1, lambda xs, db: E(f"concat_ws({', '.join(map(v.text, xs))})", "text")), "printf": (0, -1, _printf), "format": (0, -1, _printf),
    "unistr": (1, 1, lambda xs, db: E(f"lk_unistr({v.text(xs[0])})", "text")),
    "unistr_quote": (1, 1, _quoted), "like": (2, 3, lambda xs, db: like(xs, db.case_sensitive_like)), "glob": (2, 2, lambda xs, db: glob(xs)),
    "match": (2, 2, _fails("unable to use function MATCH in the requested context")), "regexp": (2, 2, lambda xs, db: E(f"({v.text(xs[1])} RLIKE {v.text(xs[0])})", "bool")),
    "random": (0, 0, lambda xs, db: E(f"CAST(floor(rand({db.next_seed()}) * 18446744073709551615D - 9223372036854775808D) AS BIGINT)", "int")),
    "randomblob": (1, 1, lambda xs, db: E(f"unhex(substr(sha2(CAST(rand({db.next_seed()}) AS STRING), 512), 1, CAST(2 * greatest({v.integer(xs[0])}, 1L) AS INT)))", "blob")),
    "zeroblob": (1, 1, lambda xs, db: E(f"unhex(repeat('00', CAST({v.integer(xs[0])} AS INT)))", "blob")),
    "uuid": (0, 0, lambda xs, db: _uuid(db.next_seed())), "uuid_str": (1, 1, lambda xs, db: E(_UUID.format(f"hex({xs[0].sql})" if xs[0].t == "blob" else f"replace({v.text(xs[0])}, '-', '')"), "text")),
    "uuid_blob": (1, 1, lambda xs, db: E(f"unhex(replace({v.text(xs[0])}, '-', ''))", "blob")),
    "likelihood": (2, 2, lambda xs, db: xs[0]), "likely": (1, 1, lambda xs, db: xs[0]), "unlikely": (1, 1, lambda xs, db: xs[0]), "unknown": (0, -1, lambda xs, db: v.literal(None)),
    "changes": (0, 0, _counter("changes")), "total_changes": (0, 0, _counter("total_changes")), "last_insert_rowid": (0, 0, _counter("last_insert_rowid")),
    "sqlite_version": (0, 0, _fixed(f"'{VERSION}'", "text")), "sqlite_source_id": (0, 0, _fixed("'larkspur'", "text")), "sqlite_compileoption_used": (1, 1, _fixed("0L", "int")),
    "sqlite_compileoption_get": (1, 1, _fixed("CAST(NULL AS STRING)", "text")), "sqlite_log": (2, 2, _fixed("CAST(NULL AS STRING)", "null")), "load_extension": (1, 2, _fails("not authorized")),
    "subtype": (1, 1, lambda xs, db: v.literal(74 if xs[0].json else 0)), "optimize": (0, -1, _fails("unable to use function optimize in the requested context")),
    "fts5": (0, -1, _fails("unable to use function fts5 in the requested context")), "fts3_tokenizer": (0, -1, _fails("fts3tokenize disabled")),
    "fts5_source_id": (0, 0, _fixed("'larkspur'", "text")), "fts5_get_locale": (1, -1, lambda xs, db: v.literal(None)), "fts5_locale": (2, 2, lambda xs, db: xs[1]), "fts5_insttoken": (1, 1, lambda xs, db: xs[0]),
    "rtreecheck": (1, 2, _fixed("'ok'", "text")), "rtreenode": (2, 2, _fixed("'{}'", "text")), "rtreedepth": (1, 1, _fixed("0L", "int")),
    # dates
    "date": (0, -1, _time(dates.date)), "time": (0, -1, _time(dates.time, True)), "datetime": (0, -1, _time(dates.datetime, True)), "julianday": (0, -1, _time(dates.julianday)),
    "unixepoch": (0, -1, _time(dates.unixepoch)), "strftime": (1, -1, _strftime),
    "timediff": (2, 2, lambda xs, db: dates.timediff(dates.moment(xs[0], [], db.now), dates.moment(xs[1], [], db.now))),
    "current_date": (0, 0, _time(dates.date)), "current_time": (0, 0, _time(dates.time, True)), "current_timestamp": (0, 0, _time(dates.datetime, True)),
    # numbers
    **{f: (1, 1, _math(f)) for f in "acos acosh asin asinh atan atanh cos cosh sin sinh tan tanh degrees radians exp".split()},
    "ln": (1, 1, _math(lambda x: f"ln({x})")), "log10": (1, 1, _math("log10")), "log2": (1, 1, _math("log2")), "sqrt": (1, 1, _math("sqrt")),
    "log": (1, 2, _math(lambda x, y=None: f"log10({x})" if y is None else f"log({x}, {y})")), "pi": (0, 0, _fixed("pi()", "real")),
    "ceil": (1, 1, _whole(lambda x: f"CAST(ceil({x}) AS DOUBLE)")), "ceiling": (1, 1, _whole(lambda x: f"CAST(ceil({x}) AS DOUBLE)")), "floor": (1, 1, _whole(lambda x: f"CAST(floor({x}) AS DOUBLE)")),
    "trunc": (1, 1, _whole(lambda x: f"CAST(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END AS DOUBLE)")),
    "sign": (1, 1, _math(lambda x: f"CAST(signum({x}) AS BIGINT)", "int")), "atan2": (2, 2, _math("atan2")), "mod": (2, 2, _math(lambda x, y: f"try_mod({x}, {y})")),
    "pow": (2, 2, _math("pow")), "power": (2, 2, _math("pow")),
    "ieee754": (1, 2, lambda xs, db: E(f"concat('ieee754(', lk_ieee_mantissa({v.real(xs[0])}), ',', lk_ieee_exponent({v.real(xs[0])}), ')')", "text") if len(xs) == 1 else E(f"lk_ieee_make({v.integer(xs[0])}, {v.integer(xs[1])})", "real")),
    "ieee754_mantissa": (1, 1, lambda xs, db: E(f"lk_ieee_mantissa({v.real(xs[0])})", "int")), "ieee754_exponent": (1, 1, lambda xs, db: E(f"lk_ieee_exponent({v.real(xs[0])})", "int")),
    "ieee754_to_blob": (1, 1, lambda xs, db: E(f"lk_ieee_blob({v.real(xs[0])})", "blob")), "ieee754_from_blob": (1, 1, lambda xs, db: E(f"lk_ieee_from_blob({xs[0].sql})", "real")),
    "ieee754_inc": (2, 2, lambda xs, db: E(f"(CASE WHEN {xs[1].sql} IS NOT NULL THEN lk_ieee_inc({v.real(xs[0])}, coalesce({v.integer(xs[1])}, 0L)) END)", "real")),
    # JSON
    "json": (1, 1, lambda xs, db: E(f"lk_json({_doc(xs[0])})", "text", json=True)), "jsonb": (1, 1, lambda xs, db: E(f"lk_jsonb({_doc(xs[0])})", "blob")),
    "json_array": (0, -1, _array), "jsonb_array": (0, -1, _blob(_array)), "json_object": (0, -1, _object), "jsonb_object": (0, -1, _blob(_object)),
    "json_quote": (1, 1, lambda xs, db: E(json_value(xs[0]), "text", json=True)), "json_extract": (2, -1, _extract), "jsonb_extract": (2, -1, _blob(lambda xs, db: E(f"lk_json_arrow({_doc(xs[0])}, {_jpath(xs[1])})", "text"))),
    **{f"json_{m}": (1, -1, _changed(m)) for m in ("insert", "replace", "set", "array_insert")}, **{f"jsonb_{m}": (1, -1, _blob(_changed(m))) for m in ("insert", "replace", "set", "array_insert")},
    "json_remove": (1, -1, lambda xs, db: _removed(xs)), "jsonb_remove": (1, -1, _blob(lambda xs, db: _removed(xs))),
    "json_patch": (2, 2, lambda xs, db: E(f"lk_json_patch({_doc(xs[0])}, {_doc(xs[1])})", "text", json=True)), "jsonb_patch": (2, 2, _blob(lambda xs, db: E(f"lk_json_patch({_doc(xs[0])}, {_doc(xs[1])})", "text"))),
    "json_type": (1, 2, lambda xs, db: E(f"lk_json_type({_doc(xs[0])}, {_jpath(xs[1]) if len(xs) > 1 else v.quote('$')})", "text")), "json_valid": (1, 2, _json_valid),
    "json_error_position": (1, 1, lambda xs, db: E(f"lk_json_error_position({v.text(xs[0])})", "int")),
    "json_array_length": (1, 2, lambda xs, db: E(f"lk_json_array_length({_doc(xs[0])}, {_jpath(xs[1]) if len(xs) > 1 else v.quote('$')})", "int")),
    "json_pretty": (1, 2, lambda xs, db: E(f"lk_json_pretty({_doc(xs[0])}, {v.text(xs[1]) if len(xs) > 1 else v.quote('    ')})", "text", json=True)),
}


def _removed(xs):
    if len(xs) == 1:
        return E(f"lk_json({_doc(xs[0])})", "text", json=True)
    return E(f"lk_json_remove({_doc(xs[0])}, array({', '.join(_jpath(p) for p in xs[1:])}))", "text", json=True)


def call(name: str, xs: list[E], db) -> E:
    found = FUNCTIONS.get(name)
    if found is None:
        raise SqlError(f"no such function: {name}", "name")
    least, most, f = found
    if len(xs) < least or 0 <= most < len(xs):
        raise SqlError(f"wrong number of arguments to function {name}()", "arguments")
    return f(xs, db)


def _series(args: list[E]):
    lo, hi = v.integer(args[0]), v.integer(args[1]) if len(args) > 1 else "4294967295L"
    step = v.integer(args[2]) if len(args) > 2 else "1L"
    if len(args) > 2 and args[2].const == 0:
        raise SqlError("generate_series: step must not be 0")
    if all(a.const is not MISSING for a in args):
        up = len(args) < 3 or args[2].const > 0
        return f"(SELECT id AS value FROM range({lo}, {hi} {'+ 1L' if up else '- 1L'}, {step}))", [("value", "int")]
    runs = f"({step} > 0 AND {lo} <= {hi} OR {step} < 0 AND {lo} >= {hi})"
    return f"explode(CASE WHEN {runs} THEN sequence({lo}, {hi}, {step}) ELSE CAST(array() AS ARRAY<BIGINT>) END)", [("value", "int")]


def _json_rows(name):
    def f(args):
        path = v.text(args[1]) if len(args) > 1 else "'$'"
        return f"inline({name}({v.text(args[0])}, {path}))", list(udfs.EACH)

    return f


TABLE_FUNCTIONS = {"generate_series": _series, "json_each": _json_rows("lk_json_each"), "json_tree": _json_rows("lk_json_tree")}
