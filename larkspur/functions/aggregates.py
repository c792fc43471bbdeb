"""Aggregates and window functions of the dialect as Spark SQL."""

from __future__ import annotations

from larkspur.errors import SqlError
from larkspur.functions import values as v
from larkspur.functions.values import E

NAMES = set("count sum avg total min max group_concat string_agg json_group_array jsonb_group_array json_group_object jsonb_group_object".split())


def json_value(e: E) -> str:
    """Never null: the JSON text of a value."""
    if e.t == "null":
        return "'null'"
    if e.json:
        out = e.sql
    elif e.t in ("int", "bool"):
        out = f"CAST({v.integer(e)} AS STRING)"
    elif e.t == "real":
        out = v.text(e)
    elif e.t == "blob":
        raise SqlError("JSON cannot hold BLOB values", "mismatch")
    else:
        out = f"regexp_replace(to_json(array({v.text(e)})), '^\\\\[|\\\\]$', '')"
    return f"coalesce({out}, 'null')"


def _args(name: str, xs: list[E], star) -> None:
    want = {"group_concat": (1, 2), "string_agg": (2, 2), "json_group_object": (2, 2), "jsonb_group_object": (2, 2), "count": (0, 1)}.get(name, (1, 1))
    if not want[0] <= len(xs) <= want[1]:
        raise SqlError(f"wrong number of arguments to function {name}()", "arguments")


def aggregate(name: str, xs: list[E], opts, filt: str | None, order: list[tuple[E, bool]]) -> E:
    """An aggregate over a group."""
    if name.startswith("jsonb_"):
        return _binary(aggregate(name.replace("jsonb_", "json_"), xs, opts, filt, order))
    _args(name, xs, opts.star)
    tail = f" FILTER (WHERE {filt})" if filt else ""
    distinct = "DISTINCT " if opts.distinct else ""
    x = xs[0] if xs else None
    if name == "count":
        return E(f"count({'*' if x is None else distinct + v.value(x)}){tail}", "int")
    if name == "sum":
        n = v.number(x)
        return E(f"sum({distinct}{n.sql}){tail}", n.t)
    if name == "avg":
        return E(f"avg({distinct}{v.real(x)}){tail}", "real")
    if name == "total":
        return E(f"coalesce(sum({distinct}{v.real(x)}){tail}, 0D)", "real")
    if name in ("min", "max"):
        if x.coll in ("NOCASE", "RTRIM"):
            return E(f"{name}_by({x.sql}, {v.collate(x.sql, x.coll)}){tail}", x.t, x.aff, x.coll)
        return E(f"{name}({v.value(x)}){tail}", {"bool": "int", "ts": "text"}.get(x.t, x.t), x.aff, x.coll)
    if name in ("group_concat", "string_agg"):
        sep = v.text(xs[1]) if len(xs) > 1 else "','"
        item = v.text(x)
        if order and not opts.distinct:
            by = ", ".join(v.value(o) + (" DESC" if d else "") for o, d in order)
            return E(f"listagg({item}, {sep}) WITHIN GROUP (ORDER BY {by}){tail}", "text")
        if opts.distinct:
            down = bool(order and order[0][1])
            return E(f"listagg(DISTINCT {item}, {sep}) WITHIN GROUP (ORDER BY {item}{' DESC' if down else ''}){tail}", "text")
        return E(f"listagg({item}, {sep}){tail}", "text")
    if name.endswith("group_array"):
        item = json_value(x)
        if order:
            by = ", ".join(f"{v.value(o)} AS o{i}" for i, (o, _) in enumerate(order))
            got = f"array_sort(collect_list(struct({by}, {item} AS v)){tail}"
            got += ")" if not order[0][1] else ", (a, b) -> CASE WHEN a > b THEN -1 WHEN a < b THEN 1 ELSE 0 END)"
            return E(f"concat('[', array_join({got}.v, ','), ']')", "text", json=True)
        return E(f"concat('[', array_join(collect_list({distinct}{item}){tail}, ','), ']')", "text", json=True)
    key = f"to_json(array({v.text(x)}))"
    pair = f"CASE WHEN {v.text(x)} IS NOT NULL THEN concat(substr({key}, 2, length({key}) - 2), ':', {json_value(xs[1])}) END"
    if order:
        by = ", ".join(f"{v.value(o)} AS o{i}" for i, (o, _) in enumerate(order))
        return E(f"concat('{{', array_join(array_sort(collect_list(struct({by}, {pair} AS v)){tail}).v, ','), '}}')", "text", json=True)
    return E(f"concat('{{', array_join(collect_list({pair}){tail}, ','), '}}')", "text", json=True)


def _binary(e: E) -> E:
    return E(f"lk_jsonb({e.sql})", "blob")


def windowed(name: str, xs: list[E], opts, spec: str, filt: str | None) -> E:
    """An aggregate over a frame; FILTER and DISTINCT, which Spark lacks there, by rewriting."""
    if name not in NAMES:
        raise SqlError(f"{name}() may not be used as a window function", "misuse")
    if name.startswith("jsonb_"):
        return _binary(windowed(name.replace("jsonb_", "json_"), xs, opts, spec, filt))
    _args(name, xs, opts.star)
    x = xs[0] if xs else None

    def kept(sql: str) -> str:
        return f"CASE WHEN {filt} THEN {sql} END" if filt else sql

    if opts.distinct:
        return from_list(name, f"collect_set({kept(v.value(x))}) OVER {spec}", x, xs)
    if name == "count":
        return E(f"count({kept('1' if x is None else v.value(x))}) OVER {spec}", "int")
    if name == "sum":
        n = v.number(x)
        return E(f"sum({kept(n.sql)}) OVER {spec}", n.t)
    if name == "avg":
        return E(f"avg({kept(v.real(x))}) OVER {spec}", "real")
    if name == "total":
        return E(f"coalesce(sum({kept(v.real(x))}) OVER {spec}, 0D)", "real")
    if name in ("min", "max"):
        return E(f"{name}({kept(v.value(x))}) OVER {spec}", x.t, x.aff, x.coll)
    return from_list(name, f"collect_list({kept(_item(name, xs))}) OVER {spec}", x, xs)


def _item(name: str, xs: list[E]) -> str:
    if name in ("group_concat", "string_agg"):
        return v.text(xs[0])
    if name.endswith("group_array"):
        return json_value(xs[0])
    if name.endswith("group_object"):
        key = f"to_json(array({v.text(xs[0])}))"
        return f"concat(substr({key}, 2, length({key}) - 2), ':', {json_value(xs[1])})"
    return v.value(xs[0])


def from_list(name: str, values: str, x: E | None, xs: list[E]) -> E:
    """An aggregate of an array of its non-null inputs."""
    if name == "count":
        return E(f"CAST(size({values}) AS BIGINT)", "int")
    if name in ("min", "max"):
        return E(f"array_{name}({values})", x.t, x.aff, x.coll)
    if name in ("sum", "avg", "total"):
        n = v.number(x)
        kind, zero = ("BIGINT", "0L") if n.t == "int" and name == "sum" else ("DOUBLE", "0D")
        total = f"aggregate({values}, {zero}, (a, b) -> a + CAST(b AS {kind}))"
        if name == "total":
            return E(total, "real")
        if name == "sum":
            return E(f"CASE WHEN size({values}) > 0 THEN {total} END", n.t)
        return E(f"({total} / nullif(CAST(size({values}) AS DOUBLE), 0D))", "real")
    if name in ("group_concat", "string_agg"):
        sep = v.text(xs[1]) if len(xs) > 1 else "','"
        return E(f"CASE WHEN size({values}) > 0 THEN array_join({values}, {sep}) END", "text")
    a, b = ("[", "]") if name.endswith("array") else ("{", "}")
    return E(f"concat('{a}', array_join({values}, ','), '{b}')", "text", json=True)


#: Aggregates that the pieces of a frame give by themselves.
IN_PIECES = {"count", "sum", "avg", "total", "min", "max"}


def in_pieces(name: str, xs: list[E], pieces: list[str | None], filt: str | None) -> E:
    """An aggregate over a frame that is cut into pieces, each a window of its own or None for the row itself, so that no frame is collected."""
    x = xs[0] if xs else None

    def over(f: str, sql: str) -> list[str]:
        item = f"CASE WHEN {filt} THEN {sql} END" if filt else sql
        alone = f"CAST(({item}) IS NOT NULL AS BIGINT)" if f == "count" else f"({item})"
        return [alone if p is None else f"{f}({item}) OVER {p}" for p in pieces]

    def total(parts: list[str], zero: str) -> str:
        return " + ".join(f"coalesce({p}, {zero})" for p in parts) or zero

    if name in ("min", "max"):
        parts = over(name, v.value(x))
        best = {"min": "least", "max": "greatest"}[name]
        sql = f"{best}({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else f"CAST(NULL AS {v.spark_type(x.t)})"
        return E(sql, {"bool": "int", "ts": "text"}.get(x.t, x.t), x.aff, x.coll)
    count = total(over("count", "1" if x is None else v.value(x)), "0L")
    if name == "count":
        return E(f"({count})", "int")
    n = v.number(x)
    if name == "sum" and n.t == "int":
        return E(f"(CASE WHEN ({count}) > 0 THEN {total(over('sum', n.sql), '0L')} END)", "int")
    added = total(over("sum", v.real(x)), "0D")
    if name == "total":
        return E(f"({added})", "real")
    return E(f"(CASE WHEN ({count}) > 0 THEN ({added}){f' / ({count})' if name == 'avg' else ''} END)", "real")


def excluded(name: str, xs: list[E], opts, spec: str, rank: str, key: str, how: str, filt: str | None) -> E:
    """An aggregate over a frame without the current row, its peers, or its peers but itself: the frame's rows are collected with their
    peer number and row number, and those that are excluded filtered out."""
    item = "1" if not xs else _item(name, xs) if name != "sum" else v.number(xs[0]).sql
    if filt:
        item = f"CASE WHEN {filt} THEN {item} END"
    keep = {"CURRENT ROW": f"x.k <> {key}", "GROUP": f"x.g <> {rank}", "TIES": f"(x.g <> {rank} OR x.k = {key})"}[how]
    rows = f"filter(collect_list(struct({rank} AS g, {key} AS k, {item} AS v)) OVER {spec}, x -> {keep} AND x.v IS NOT NULL)"
    values = f"transform({rows}, x -> x.v)"
    if name in ("first_value", "last_value"):
        rows = rows.replace(" AND x.v IS NOT NULL", "")
        return E(f"element_at(transform({rows}, x -> x.v), {1 if name == 'first_value' else -1})", xs[0].t)
    if opts.distinct:
        values = f"array_distinct({values})"
    return from_list(name, values, xs[0] if xs else None, xs)


def _rank(f: str):
    return lambda xs, spec: E(f"CAST({f}() OVER {spec} AS BIGINT)", "int")


def _share(f: str):
    return lambda xs, spec: E(f"{f}() OVER {spec}", "real")


def _ntile(xs, spec):
    n = xs[0].const
    if not isinstance(n, int) or n < 1:
        raise SqlError("argument of ntile must be a positive integer")
    return E(f"CAST(ntile({n}) OVER {spec} AS BIGINT)", "int")


def _shift(f: str):
    def out(xs, spec):
        n = xs[1].const if len(xs) > 1 else 1
        x = xs[0]
        t = v.unify([x.t, xs[2].t]) if len(xs) > 2 else {"bool": "int", "ts": "text"}.get(x.t, x.t)
        if len(xs) > 2:
            return E(f"{f}({v.cast_to(x, t)}, {n}, {v.cast_to(xs[2], t)}) OVER {spec}", t)
        return E(f"{f}({v.value(x)}, {n}) OVER {spec}", t)

    return out


RANKING = {
    "row_number": _rank("row_number"), "rank": _rank("rank"), "dense_rank": _rank("dense_rank"), "percent_rank": _share("percent_rank"),
    "cume_dist": _share("cume_dist"), "ntile": _ntile, "lag": _shift("lag"), "lead": _shift("lead"),
}


def _nth(xs, spec):
    n = xs[1].const
    if not isinstance(n, int) or n < 1:
        raise SqlError("second argument to nth_value must be a positive integer")
    return E(f"nth_value({v.value(xs[0])}, {n}) OVER {spec}", xs[0].t)


FRAME_VALUES = {
    "first_value": lambda xs, spec: E(f"first_value({v.value(xs[0])}) OVER {spec}", xs[0].t),
    "last_value": lambda xs, spec: E(f"last_value({v.value(xs[0])}) OVER {spec}", xs[0].t),
    "nth_value": _nth,
}
