"""Date and time functions over Spark timestamps without a zone."""

from __future__ import annotations

import re

from larkspur.functions import values as v
from larkspur.functions.values import MISSING, E

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_JULIAN = 2440587.5


def moment(x: E | None, modifiers: list[E], now: str) -> str:
    """A TIMESTAMP_NTZ expression, NULL where the input or a modifier is not understood."""
    mods = [m.const if isinstance(m.const, str) else None for m in modifiers]
    unix = bool(mods) and mods[0] is not None and mods[0].lower() == "unixepoch"
    auto = bool(mods) and mods[0] is not None and mods[0].lower() == "auto"
    if x is None or x.const == "now":
        ts = f"TIMESTAMP_NTZ '{now}'"
    elif x.t == "ts":
        ts = f"CAST({x.sql} AS TIMESTAMP_NTZ)"
    elif x.t in ("int", "real", "bool"):
        ts = _from_number(v.real(x), unix, auto)
    elif x.t == "null":
        return "CAST(NULL AS TIMESTAMP_NTZ)"
    else:
        s = f"trim({v.text(x)})"
        only_time = f"{s} RLIKE '^[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?$'"
        full = f"{s} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?)?$'"
        zoned = f"{s} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)? ?(Z|[+-][0-9]{{2}}:[0-9]{{2}})$'"
        number = f"{s} RLIKE '^[+-]?[0-9]+([.][0-9]*)?$'"
        ts = (
            f"(CASE WHEN {full} THEN try_cast({s} AS TIMESTAMP_NTZ) WHEN {only_time} THEN try_cast(concat('2000-01-01 ', {s}) AS TIMESTAMP_NTZ) "
            f"WHEN {zoned} THEN CAST(try_cast({s} AS TIMESTAMP) AS TIMESTAMP_NTZ) "
            f"WHEN {number} THEN {_from_number(f'try_cast({s} AS DOUBLE)', unix, auto)} END)"
        )
    for m in mods[1:] if unix or auto else mods:
        ts = _modified(ts, m)
    return ts


def _from_number(n: str, unix: bool, auto: bool) -> str:
    epoch = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    days = f"timestampadd(MICROSECOND, CAST(round(({n} - {_JULIAN}D) * 86400000D) * 1000 AS BIGINT), {epoch})"
    secs = f"timestampadd(MICROSECOND, CAST(round({n} * 1000D) * 1000 AS BIGINT), {epoch})"
    if unix:
        return secs
    if auto:
        return f"(CASE WHEN {n} >= 0D AND {n} < 5373484.5D THEN {days} ELSE {secs} END)"
    return f"(CASE WHEN {n} >= 0D AND {n} < 5373484.5D THEN {days} END)"


def _modified(ts: str, m: str | None) -> str:
    none = "CAST(NULL AS TIMESTAMP_NTZ)"
    if m is None:
        return none
    m = m.strip().lower()
    if m in ("utc", "localtime", "subsec", "subsecond", "floor", "ceiling"):
        return ts
    if m.startswith("weekday "):
        n = m[8:].strip()
        if n not in "0123456" or len(n) != 1:
            return none
        return f"timestampadd(DAY, CAST(pmod({n} - (dayofweek({ts}) - 1), 7) AS INT), {ts})"
    if m.startswith("start of "):
        unit = m[9:].strip()
        return f"CAST(date_trunc('{unit.upper()}', {ts}) AS TIMESTAMP_NTZ)" if unit in ("day", "month", "year") else none
    found = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(second|minute|hour|day|month|year)s?", m)
    if not found:
        clock = re.fullmatch(r"([+-])(\d\d):(\d\d)(?::(\d\d(?:\.\d+)?))?", m)
        if not clock:
            return none
        seconds = int(clock[2]) * 3600 + int(clock[3]) * 60 + float(clock[4] or 0)
        return f"timestampadd(MICROSECOND, {int(seconds * 1e6) * (-1 if clock[1] == '-' else 1)}L, {ts})"
    n, unit = float(found[1]), found[2]
    if unit in _UNITS:
        return f"timestampadd(MICROSECOND, {round(n * _UNITS[unit] * 1e6)}L, {ts})"
    months = int(n) * (12 if unit == "year" else 1)
    # days past the end of the month run into the next one
    first = f"date_trunc('MONTH', {ts})"
    moved = f"timestampadd(MONTH, {months}, CAST({first} AS TIMESTAMP_NTZ))"
    return f"timestampadd(MICROSECOND, timestampdiff(MICROSECOND, CAST({first} AS TIMESTAMP_NTZ), {ts}), {moved})"


def date(ts: str) -> E:
    return E(f"date_format({ts}, 'yyyy-MM-dd')", "text")


def time(ts: str, fine: bool = False) -> E:
    return E(f"date_format({ts}, '{'HH:mm:ss.SSS' if fine else 'HH:mm:ss'}')", "text")


def datetime(ts: str, fine: bool = False) -> E:
    return E(f"date_format({ts}, '{'yyyy-MM-dd HH:mm:ss.SSS' if fine else 'yyyy-MM-dd HH:mm:ss'}')", "text")


def micros(ts: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})"


def julianday(ts: str) -> E:
    return E(f"({micros(ts)} / 86400000000D + {_JULIAN}D)", "real")


def unixepoch(ts: str) -> E:
    return E(f"CAST(floor({micros(ts)} / 1000000D) AS BIGINT)", "int")


def strftime(fmt: E, ts: str) -> E:
    if fmt.const is MISSING or fmt.const is None:
        return E("CAST(NULL AS STRING)", "text")
    yday, dow = f"dayofyear({ts})", f"(dayofweek({ts}) - 1)"
    pieces = {
        "Y": f"date_format({ts}, 'yyyy')", "m": f"date_format({ts}, 'MM')", "d": f"date_format({ts}, 'dd')", "H": f"date_format({ts}, 'HH')", "M": f"date_format({ts}, 'mm')",
        "S": f"date_format({ts}, 'ss')", "f": f"date_format({ts}, 'ss.SSS')", "j": f"lpad(CAST({yday} AS STRING), 3, '0')", "w": f"CAST({dow} AS STRING)",
        "u": f"CAST(pmod({dow} + 6, 7) + 1 AS STRING)", "s": f"CAST({unixepoch(ts).sql} AS STRING)", "J": f"CAST({julianday(ts).sql} AS STRING)",
        "W": f"lpad(CAST(({yday} - 1 + 7 - pmod({dow} + 6, 7)) div 7 AS STRING), 2, '0')", "U": f"lpad(CAST(({yday} - 1 + 7 - {dow}) div 7 AS STRING), 2, '0')",
        "F": f"date_format({ts}, 'yyyy-MM-dd')", "T": f"date_format({ts}, 'HH:mm:ss')", "R": f"date_format({ts}, 'HH:mm')", "e": f"lpad(CAST(day({ts}) AS STRING), 2, ' ')",
        "I": f"date_format({ts}, 'hh')", "k": f"lpad(CAST(hour({ts}) AS STRING), 2, ' ')", "p": f"CASE WHEN hour({ts}) < 12 THEN 'AM' ELSE 'PM' END", "%": "'%'",
    }
    out, rest = [], fmt.const
    for m in re.finditer(r"%(.)|([^%]+)|(%)$", rest, re.S):
        out.append(pieces.get(m[1], v.quote("%" + m[1])) if m[1] else v.quote(m[2] or m[3]))
    body = f"concat({', '.join(out)})" if out else "''"
    return E(f"(CASE WHEN {ts} IS NOT NULL THEN {body} END)", "text")


def timediff(a: str, b: str) -> E:
    """The calendar difference: whole years and months first, then days and time."""
    lo, hi = f"least({a}, {b})", f"greatest({a}, {b})"
    months = f"timestampdiff(MONTH, {lo}, {hi})"
    rest = f"timestampdiff(MICROSECOND, timestampadd(MONTH, CAST({months} AS INT), {lo}), {hi})"
    sec = f"({rest} div 1000000)"
    part = f"concat(lpad(CAST({months} div 12 AS STRING), 4, '0'), '-', lpad(CAST({months} % 12 AS STRING), 2, '0'), '-', lpad(CAST({sec} div 86400 AS STRING), 2, '0'), ' ', lpad(CAST({sec} % 86400 div 3600 AS STRING), 2, '0'), ':', lpad(CAST({sec} % 3600 div 60 AS STRING), 2, '0'), ':', lpad(CAST({sec} % 60 AS STRING), 2, '0'), '.', lpad(CAST({rest} % 1000000 div 1000 AS STRING), 3, '0'))"
    return E(f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN concat(CASE WHEN {a} >= {b} THEN '+' ELSE '-' END, {part}) END)", "text")
