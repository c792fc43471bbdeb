"""Tokens of the dialect."""

from __future__ import annotations

import re
from typing import NamedTuple

from larkspur.errors import SqlError


class Token(NamedTuple):
    kind: str  # id, qid, str, num, blob, param, op, end
    value: object
    at: int
    end: int


_RULES = re.compile(
    r"""(?P<space>[ \t\r\n\f]+|--[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<blob>[xX]'[^']*')
    |(?P<num>0[xX][0-9a-fA-F]+|(?:\d[\d_]*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<str>'(?:[^']|'')*')
    |(?P<qid>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\])
    |(?P<id>[^\W\d][\w$]*)
    |(?P<param>\?\d*|[:@$][A-Za-z_]\w*)
    |(?P<op>->>|->|\|\||<<|>>|<=|>=|<>|==|!=|[-+*/%&|~<>=(),.;])""",
    re.S | re.X,
)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _RULES.match(sql, at)
        if not m:
            raise SqlError(f'unrecognized token: "{sql[at]}"', "syntax")
        kind, text, at = m.lastgroup, m.group(), m.end()
        if kind == "space":
            continue
        value: object = text
        if kind == "blob":
            try:
                value = bytes.fromhex(text[2:-1])
            except ValueError:
                raise SqlError(f'unrecognized token: "{text}"', "syntax") from None
        elif kind == "num":
            text = text.replace("_", "")
            if text[:2].lower() == "0x":
                value = int(text, 16)
                value -= (value >> 63) << 64
            else:
                value = float(text) if re.search(r"[.eE]", text) else int(text)
                if isinstance(value, int) and value >= 1 << 63:
                    value = float(value)
        elif kind == "str":
            value = text[1:-1].replace("''", "'")
        elif kind == "qid":
            value = text[1:-1].replace(text[-1] * 2, text[-1])
        out.append(Token(kind, value, m.start(), at))
    out.append(Token("end", None, len(sql), len(sql)))
    return out
