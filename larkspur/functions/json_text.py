"""JSON text with its key order, repeated keys and number spelling kept: parsing, paths, changes, rendering, JSONB.

Values are None, True, False, str, Num (the number as written), list, and Obj, a list of pairs.
"""

from __future__ import annotations

import json
import re
import struct


class Num(str):
    """A number as it was written."""


class Obj(list):
    """Pairs of an object, in order."""


class Bad(ValueError):
    def __init__(self, at: int):
        super().__init__(f"malformed JSON at {at}")
        self.at = at


_SPACE = re.compile(r"(?:[ \t\r\n\f\v\xa0﻿]|//[^\n]*\n?|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity|NaN)")
_STRICT_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_STRICT_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


class _Reader:
    def __init__(self, s: str, strict: bool):
        self.s, self.i, self.strict = s, 0, strict

    def space(self):
        m = re.compile(r"[ \t\r\n]*").match(self.s, self.i) if self.strict else _SPACE.match(self.s, self.i)
        self.i = m.end()

    def value(self, depth=0):
        if depth > 1000:
            raise Bad(self.i)
        self.space()
        s, i = self.s, self.i
        c = s[i : i + 1]
        if c == "{":
            out = Obj()
            self.i += 1
            while True:
                self.space()
                if s[self.i : self.i + 1] == "}" and (not out or not self.strict or s[self.i - 1] != ","):
                    self.i += 1
                    return out
                if out:
                    pass
                key = self.key()
                self.space()
                self.eat(":")
                out.append((key, self.value(depth + 1)))
                self.space()
                if s[self.i : self.i + 1] == ",":
                    self.i += 1
                    if self.strict:
                        self.space()
                        if s[self.i : self.i + 1] == "}":
                            raise Bad(self.i)
                elif s[self.i : self.i + 1] != "}":
                    raise Bad(self.i)
        if c == "[":
            out = []
            self.i += 1
            while True:
                self.space()
                if s[self.i : self.i + 1] == "]":
                    self.i += 1
                    return out
                out.append(self.value(depth + 1))
                self.space()
                if s[self.i : self.i + 1] == ",":
                    self.i += 1
                    self.space()
                    if self.strict and s[self.i : self.i + 1] == "]":
                        raise Bad(self.i)
                elif s[self.i : self.i + 1] != "]":
                    raise Bad(self.i)
        if c in ('"', "'"):
            return self.string()
        for word, v in (("true", True), ("false", False), ("null", None)):
            if s.startswith(word, i):
                self.i += len(word)
                return v
        m = (_STRICT_NUMBER if self.strict else _NUMBER).match(s, i)
        if not m or not m.group():
            raise Bad(i)
        self.i = m.end()
        return _number(m.group())

    def eat(self, c):
        if self.s[self.i : self.i + 1] != c:
            raise Bad(self.i)
        self.i += 1

    def key(self):
        if self.s[self.i : self.i + 1] in ('"', "'"):
            return self.string()
        m = None if self.strict else _NAME.match(self.s, self.i)
        if not m:
            raise Bad(self.i)
        self.i = m.end()
        return m.group()

    def string(self):
        s, quote = self.s, self.s[self.i]
        m = _STRICT_STRING.match(s, self.i)
        if m:
            self.i = m.end()
            return json.loads(m.group())
        if self.strict:
            raise Bad(self.i)
        out, i = [], self.i + 1
        plain = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
        while True:
            c = s[i : i + 1]
            if not c:
                raise Bad(i)
            if c == quote:
                self.i = i + 1
                return "".join(out)
            if c != "\\":
                out.append(c)
                i += 1
                continue
            e = s[i + 1 : i + 2]
            if e in ("u", "x"):
                n = 4 if e == "u" else 2
                h = s[i + 2 : i + 2 + n]
                if not re.fullmatch(f"[0-9a-fA-F]{{{n}}}", h):
                    raise Bad(i)
                out.append(chr(int(h, 16)))
                i += 2 + n
            else:
                out.append("" if e == "\n" else plain.get(e, e))
                i += 2


def _number(s: str):
    """A number in canonical spelling: what JSON proper lacks is rewritten."""
    sign, body = ("-", s[1:]) if s[0] == "-" else ("", s.lstrip("+"))
    if body == "NaN":
        return None
    if body == "Infinity":
        return Num(sign + "9.0e+999")
    if body[:2].lower() == "0x":
        return Num(sign + str(int(body, 16)))
    if body[0] == ".":
        body = "0" + body
    return Num(sign + re.sub(r"\.(?=[eE]|$)", ".0", body))


def parse(s: str, strict: bool = False):
    r = _Reader(s, strict)
    out = r.value()
    r.space()
    if r.i != len(s):
        raise Bad(r.i)
    return out


def _no_constant(word: str):
    raise ValueError(word)


_DECODER = json.JSONDecoder(object_pairs_hook=Obj, parse_int=Num, parse_float=Num, parse_constant=_no_constant)


def quick(s: str):
    """parse(s): by the decoder of the standard library where s is JSON proper, else by the reader above."""
    try:
        return _DECODER.decode(s)
    except (ValueError, RecursionError):
        return parse(s)


def text(x) -> str:
    """Minified text."""
    if x is None or x is True or x is False:
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, Num):
        return str(x)
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, Obj):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + text(v) for k, v in x) + "}"
    return "[" + ",".join(map(text, x)) + "]"


def pretty(x, indent: str = "    ", level: int = 0) -> str:
    pad, end = indent * (level + 1), indent * level
    if isinstance(x, Obj) and x:
        return "{\n" + ",\n".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {pretty(v, indent, level + 1)}" for k, v in x) + f"\n{end}}}"
    if isinstance(x, list) and x and not isinstance(x, Obj):
        return "[\n" + ",\n".join(pad + pretty(v, indent, level + 1) for v in x) + f"\n{end}]"
    return text(x)


def kind(x) -> str:
    if x is None or x is True or x is False:
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, Num):
        return "real" if "." in x or "e" in x or "E" in x else "integer"
    return "text" if isinstance(x, str) else "object" if isinstance(x, Obj) else "array"


_STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(#(?:-\d+)?|\d+)\]')


def steps(path: str) -> list:
    """Keys (str), indexes (int >= 0), and positions from the end as ('#', n)."""
    if not path.startswith("$"):
        raise Bad(0)
    out, i = [], 1
    while i < len(path):
        m = _STEP.match(path, i)
        if not m:
            raise Bad(i)
        i = m.end()
        if m[3] is not None:
            out.append(("#", int(m[3][2:] or 0)) if m[3][0] == "#" else int(m[3]))
        else:
            out.append(m[1] if m[1] is not None else m[2])
    return out


_NONE = object()


def _at(x, step):
    """The child's position in the list that holds it, or None."""
    if isinstance(step, str):
        if isinstance(x, Obj):
            for i in range(len(x) - 1, -1, -1):
                if x[i][0] == step:
                    return i
        return None
    if isinstance(x, Obj) or not isinstance(x, list):
        return None
    i = step if isinstance(step, int) else len(x) - step[1]
    return i if 0 <= i < len(x) else None


def get(x, path: list):
    for s in path:
        i = _at(x, s)
        if i is None:
            return _NONE
        x = x[i][1] if isinstance(x, Obj) else x[i]
    return x


def missing(x) -> bool:
    return x is _NONE


def change(x, path: list, value, create: bool, replace: bool):
    """x with the value at the path; create where it is missing, replace where it is there."""
    if not path:
        return value if replace else x
    s, rest = path[0], path[1:]
    i = _at(x, s)
    if i is not None:
        out = Obj(x) if isinstance(x, Obj) else list(x)
        if isinstance(x, Obj):
            out[i] = (x[i][0], change(x[i][1], rest, value, create, replace))
        else:
            out[i] = change(x[i], rest, value, create, replace)
        return out
    if not create:
        return x
    made = value
    for r in reversed(rest):
        if isinstance(r, str):
            made = Obj([(r, made)])
        elif r in (0, ("#", 0)):
            made = [made]
        else:
            return x
    if isinstance(s, str):
        return Obj([*x, (s, made)]) if isinstance(x, Obj) else x
    if isinstance(x, list) and not isinstance(x, Obj) and (s == len(x) or s == ("#", 0)):
        return [*x, made]
    return x


def array_insert(x, path: list, value):
    """x with the value put before the element at the path."""
    *head, last = path
    def go(y, p):
        if not p:
            if not isinstance(y, list) or isinstance(y, Obj) or isinstance(last, str):
                return y
            i = last if isinstance(last, int) else len(y) - last[1]
            return [*y[:i], value, *y[i:]] if 0 <= i <= len(y) else y
        i = _at(y, p[0])
        if i is None:
            return y
        if isinstance(y, Obj):
            return Obj([*y[:i], (y[i][0], go(y[i][1], p[1:])), *y[i + 1 :]])
        return [*y[:i], go(y[i], p[1:]), *y[i + 1 :]]

    return go(x, head)


def remove(x, path: list):
    if not path:
        return _NONE
    i = _at(x, path[0])
    if i is None:
        return x
    make = Obj if isinstance(x, Obj) else list
    if len(path) == 1:
        return make([*x[:i], *x[i + 1 :]])
    inner = remove(x[i][1] if make is Obj else x[i], path[1:])
    return make([*x[:i], (x[i][0], inner) if make is Obj else inner, *x[i + 1 :]])


def merge_patch(x, patch):
    if not isinstance(patch, Obj):
        return patch
    out = Obj(x) if isinstance(x, Obj) else Obj()
    for k, p in patch:
        i = _at(out, k)
        if p is None:
            if i is not None:
                del out[i]
        elif i is not None:
            out[i] = (k, merge_patch(out[i][1], p))
        else:
            out.append((k, merge_patch(None, p)))
    return out


def sql_value(x) -> str | None:
    """A value as SQL sees it, as text: booleans are 1 and 0, containers their JSON."""
    if x is _NONE or x is None:
        return None
    if isinstance(x, bool):
        return str(int(x))
    return str(x) if isinstance(x, str) else text(x)


# -- JSONB: a header of type and size, then the payload


def jsonb(x) -> bytes:
    if x is None or x is True or x is False:
        return bytes([{None: 0, True: 1, False: 2}[x]])
    if isinstance(x, Num):
        body, code = x.encode(), 5 if "." in x or "e" in x or "E" in x else 3
    elif isinstance(x, str):
        raw = json.dumps(x, ensure_ascii=False)[1:-1]
        body, code = raw.encode(), 7 if raw == x else 8
        if raw != x:
            body, code = x.encode(), 10
    elif isinstance(x, Obj):
        body, code = b"".join(jsonb(k) + jsonb(v) for k, v in x), 12
    else:
        body, code = b"".join(map(jsonb, x)), 11
    n = len(body)
    if n < 12:
        return bytes([code | n << 4]) + body
    for size, mark in ((1, 12), (2, 13), (4, 14), (8, 15)):
        if n < 1 << 8 * size:
            return bytes([code | mark << 4]) + n.to_bytes(size, "big") + body
    raise ValueError("too long")


def _head(b: bytes, i: int) -> tuple[int, int, int]:
    if i >= len(b):
        raise Bad(i)
    code, n = b[i] & 15, b[i] >> 4
    i += 1
    if n >= 12:
        size = 1 << (n - 12)
        n, i = int.from_bytes(b[i : i + size], "big"), i + size
    if i + n > len(b):
        raise Bad(i)
    return code, i, n


def from_jsonb(b: bytes):
    def read(i):
        code, i, n = _head(b, i)
        end, raw = i + n, b[i : i + n]
        if code in (0, 1, 2):
            return (None, True, False)[code], end
        if code in (3, 4, 5, 6):
            return _number(raw.decode()), end
        if code in (7, 10):
            return raw.decode(), end
        if code in (8, 9):
            return _Reader('"' + raw.decode() + '"', code == 8).string(), end
        items = []
        while i < end:
            x, i = read(i)
            items.append(x)
        if code == 11:
            return items, end
        if code == 12:
            return Obj(zip(items[::2], items[1::2])), end
        raise Bad(i)

    out, end = read(0)
    if end != len(b):
        raise Bad(end)
    return out


def rows(x, root: str, tree: bool):
    """json_each and json_tree: (key, value, type, atom, id, parent, fullkey, path); ids are JSONB offsets."""

    def name(k):
        return f".{k}" if k.isascii() and k.isalnum() and k[0].isalpha() else f".{json.dumps(k, ensure_ascii=False)}"

    def header(y):
        b = jsonb(y)
        return len(b) - _head(b, 0)[2]

    def row(key, y, at, parent, full, path):
        leaf = not isinstance(y, list)
        return (key, sql_value(y) if leaf else text(y), kind(y), sql_value(y) if leaf else None, at, parent, full, path)

    def walk(y, at, full):
        inner = at + header(y)
        if isinstance(y, Obj):
            for k, c in y:
                size = len(jsonb(k))
                yield k, c, inner, inner + size, full + name(k)
                inner += size + len(jsonb(c))
        elif isinstance(y, list):
            for k, c in enumerate(y):
                yield str(k), c, inner, inner, f"{full}[{k}]"
                inner += len(jsonb(c))

    def deep(key, y, at, body, parent, full, path):
        yield row(key, y, at, parent, full, path)
        for k, c, i, b, f in walk(y, body, full):
            yield from deep(k, c, i, b, at, f, full)

    if tree:
        yield from deep(None, x, 0, 0, None, root, root)
    elif isinstance(x, list):
        for k, c, i, _, f in walk(x, 0, root):
            yield row(k, c, i, None, f, root)
    else:
        yield row(None, x, 0, None, root, root)


def ieee754(x: float) -> tuple[int, int]:
    """Mantissa and exponent with x = mantissa * 2 ** exponent, the mantissa odd or 0."""
    bits = struct.unpack(">q", struct.pack(">d", x))[0]
    e, m = bits >> 52 & 0x7FF, bits & ((1 << 52) - 1)
    if e == 0:
        e = 1
    else:
        m |= 1 << 52
    e -= 1075
    if m == 0:
        return 0, 0
    while m % 2 == 0:
        m, e = m // 2, e + 1
    return (-m if bits < 0 else m), e
