"""Full-text search: tokenizers, the MATCH grammar, and its evaluation over token arrays.

A query is parsed once. Terms, prefixes, phrases, NEAR groups and their boolean combinations become patterns that Spark looks for in the texts
themselves, without cutting them into terms; the porter tokenizer, queries that differ from row to row and the functions
that need character positions (highlight, snippet, offsets, matchinfo) run Arrow-batched.
"""

from __future__ import annotations

import itertools
import math
import re
import struct
from functools import lru_cache

from larkspur.errors import SqlError
from larkspur.functions import values as v
from larkspur.functions.values import E

#: Letters, marks and numbers make words.
WORD = r"[\p{L}\p{M}\p{N}]+"
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def porter(w: str) -> str:
    """The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w

    def cons(s, i):
        return s[i] not in "aeiou" and not (s[i] == "y" and i > 0 and cons(s, i - 1))

    def m(s):
        shape = re.sub(r"(.)\1*", r"\1", "".join("c" if cons(s, i) else "v" for i in range(len(s))))
        return shape.count("vc")

    def vowel(s):
        return any(not cons(s, i) for i in range(len(s)))

    def double(s):
        return len(s) > 1 and s[-1] == s[-2] and cons(s, len(s) - 1)

    def cvc(s):
        return len(s) > 2 and cons(s, len(s) - 3) and not cons(s, len(s) - 2) and cons(s, len(s) - 1) and s[-1] not in "wxy"

    def first(s, rules, least):
        for end, new in rules:
            if s.endswith(end):
                stem = s[: len(s) - len(end)]
                return stem + new if m(stem) > least else s
        return s

    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            stem = w[: -len(end)]
            if w.endswith(end) and vowel(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    pairs = "ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,logi log"
    w = first(w, [tuple(p.split()) for p in pairs.split(",")], 0)
    w = first(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    for end in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split():
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if m(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if m(stem) > 1 or (m(stem) == 1 and not cvc(stem)):
            w = stem
    if m(w) > 1 and double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def tokens(text: str, how: str) -> list[tuple[str, int, int]]:
    """(term, start, end) of each token."""
    import regex
    import unicodedata

    parts = how.split() or ["unicode61"]
    stem = parts[0] == "porter"
    base = (parts[1] if len(parts) > 1 else "unicode61") if stem else parts[0]
    if base == "trigram":
        low = text if "case_sensitive" in parts and parts[parts.index("case_sensitive") + 1] == "1" else text.lower()
        return [(low[i : i + 3], i, i + 3) for i in range(len(low) - 2)]
    out = []
    for hit in regex.finditer("[A-Za-z0-9]+" if base == "ascii" else WORD, text):
        term = hit.group().lower()
        if base != "ascii":
            term = "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))
        out.append((porter(term) if stem else term, hit.start(), hit.end()))
    return out


def _terms(text, how):
    return [t for t, _, _ in tokens(text, how)]


# -- the grammar: OR binds least, then AND (written or implied) and NOT; phrases, prefixes, NEAR and column filters

_LEX = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<near>NEAR\s*\()|(?P<word>[^\s"(){}:*+^,-]+)|(?P<op>[(){}:*+^,-]))')


class Query:
    """('phrase', terms, prefix, columns) ('near', phrases, n, columns) ('and', a, b) ('or', a, b) ('not', a, b)"""

    def __init__(self, text: str, how: str, columns: list[str]):
        self.how, self.columns, self.toks, self.i = how, [c.lower() for c in columns], [], 0
        at = 0
        text = text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise SqlError(f'fts5: syntax error near "{text[at]}"', "syntax")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.root = self.either(None) if self.toks else None
        if self.i < len(self.toks):
            raise SqlError(f'fts5: syntax error near "{self.toks[self.i][1]}"', "syntax")

    def peek(self, k=0):
        return self.toks[self.i + k] if self.i + k < len(self.toks) else (None, None)

    def either(self, cols):
        left = self.both(cols)
        while self.peek() == ("word", "OR"):
            self.i += 1
            left = ("or", left, self.both(cols))
        return left

    def both(self, cols):
        left = self.unit(cols)
        while True:
            kind, word = self.peek()
            if (kind, word) == ("word", "NOT"):
                self.i += 1
                left = ("not", left, self.unit(cols))
            elif (kind, word) == ("word", "AND"):
                self.i += 1
                left = ("and", left, self.unit(cols))
            elif kind is None or word in (")", ",") or (kind, word) == ("word", "OR"):
                return left
            else:
                left = ("and", left, self.unit(cols))

    def unit(self, cols):
        kind, word = self.peek()
        if kind is None:
            raise SqlError('fts5: syntax error near ""', "syntax")
        if (kind, word) == ("op", "-") or (kind, word) == ("op", "{") or (kind == "word" and self.peek(1) == ("op", ":")):
            negate = word == "-"
            self.i += negate
            names = []
            if self.peek() == ("op", "{"):
                self.i += 1
                while self.peek() != ("op", "}"):
                    names.append(self.peek()[1].lower())
                    self.i += 1
                self.i += 1
            else:
                names.append(self.peek()[1].strip('"').lower())
                self.i += 1
            if self.peek() != ("op", ":"):
                raise SqlError("fts5: syntax error near column filter", "syntax")
            self.i += 1
            for n in names:
                if n not in self.columns:
                    raise SqlError(f"no such column: {n}", "name")
            picked = [i for i, c in enumerate(self.columns) if (c in names) != negate]
            return self.unit([c for c in picked if cols is None or c in cols])
        if (kind, word) == ("op", "("):
            self.i += 1
            out = self.either(cols)
            self.close()
            return out
        if kind == "near":
            self.i += 1
            phrases, n = [], 10
            while self.peek() != ("op", ")"):
                if self.peek() == ("op", ","):
                    n = int(self.peek(1)[1])
                    self.i += 2
                else:
                    phrases.append(self.phrase(cols))
            self.close()
            return ("near", phrases, n, cols)
        return self.phrase(cols)

    def close(self):
        if self.peek() != ("op", ")"):
            raise SqlError("fts5: unterminated query", "syntax")
        self.i += 1

    def phrase(self, cols):
        start = self.peek() == ("op", "^")
        self.i += start
        terms, prefix = [], False
        while True:
            kind, word = self.peek()
            if kind not in ("quoted", "word"):
                raise SqlError(f'fts5: syntax error near "{word or ""}"', "syntax")
            self.i += 1
            raw = word[1:-1].replace('""', '"') if kind == "quoted" else word
            terms += _terms(raw, self.how)
            if self.peek() == ("op", "*"):
                self.i += 1
                prefix = True
            if self.peek() == ("op", "+"):
                self.i += 1
                continue
            return ("phrase", terms, prefix, cols, start)

    def phrases(self) -> list:
        def walk(n):
            if n is None:
                return
            if n[0] == "phrase":
                yield n
            elif n[0] == "near":
                yield from n[1]
            else:
                yield from walk(n[1])
                if n[0] != "not":
                    yield from walk(n[2])

        return list(walk(self.root))


def _plain_letters() -> tuple[str, str]:
    """Precomposed letters and what is left of them without their marks."""
    import unicodedata

    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]) and chr(code).lower() == chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


_MARKED, _BASE = _plain_letters()


def token_array(text: str, how: str) -> str:
    """Spark SQL for the array of terms of a text."""
    parts = how.split() or ["unicode61"]
    t = f"coalesce({text}, '')"
    if parts[0] == "ascii":
        return f"regexp_extract_all({v.collate(t, 'NOCASE')}, '[a-z0-9]+', 0)"
    if parts[0] == "trigram":
        return f"(CASE WHEN length({t}) < 3 THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(1, greatest(length({t}) - 2, 1)), i -> substring({_trigram_text(text, parts)}, i, 3)) END)"
    if parts[0] == "unicode61":
        return f"regexp_extract_all({_normal(t)}, '[\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]+', 0)"
    return f"lk_fts_terms({t}, {v.quote(how)})"


def _trigram_text(text: str, parts: list[str]) -> str:
    exact = "case_sensitive" in parts and parts[parts.index("case_sensitive") + 1] == "1"
    return f"coalesce({text}, '')" if exact else f"lower(coalesce({text}, ''))"


def _trigram(how: str) -> bool:
    return how.split()[:1] == ["trigram"]


def _normal(t: str) -> str:
    """Spark SQL for a text as unicode61 reads it: lower case, without marks."""
    return f"regexp_replace(translate(lower({t}), '{_MARKED}', '{_BASE}'), '(?<=[\\\\p{{L}}\\\\p{{N}}])\\\\p{{M}}+', '')"


def searched(text: str, how: str) -> str:
    """The text that patterns of a query are looked for in: the column itself where the tokenizer lets it, else its terms between blanks."""
    if _trigram(how):
        return _trigram_text(text, how.split())
    base = (how.split() or ["unicode61"])[0]
    if base == "ascii":
        return f"coalesce({text}, '')"
    return _normal(f"coalesce({text}, '')") if base == "unicode61" else f"concat(' ', array_join({token_array(text, how)}, ' '), ' ')"


def _letters(how: str) -> tuple[str, str]:
    """Flags of the patterns, and what a term is made of, as the inside of a character class."""
    base = (how.split() or ["unicode61"])[0]
    return {"ascii": ("(?i)", "A-Za-z0-9"), "unicode61": ("", r"\p{L}\p{M}\p{N}")}.get(base, ("", "^ "))


def _others(letters: str) -> str:
    return letters[1:] if letters.startswith("^") else "^" + letters


def token_count(column: str, how: str) -> str:
    if _trigram(how):
        return f"greatest(length({column}) - 2, 0)"
    return f"regexp_count({column}, {v.quote(f'[{_letters(how)[1]}]+')})"


def _pattern(phrase, how: str, apart: bool = False) -> str:
    """A regular expression for a phrase; apart: only its first term is part of the match, so that matches may overlap."""
    terms, prefix = [re.escape(t) for t in phrase[1]], phrase[2]
    letters = _letters(how)[1]
    end = "" if prefix else f"(?![{letters}])"
    gap = f"[{_others(letters)}]+"
    rest = gap.join(terms[1:])
    if apart and rest:
        return f"(?<![{letters}]){terms[0]}(?={gap}{rest}{end})"
    return f"(?<![{letters}]){gap.join(terms)}{end}"


def _found(column: str, phrase, how: str) -> str:
    if not phrase[1]:
        return "FALSE"
    if _trigram(how):
        terms = phrase[1]
        return f"{'startswith' if phrase[4] else 'contains'}({column}, {v.quote(terms[0] + ''.join(t[-1] for t in terms[1:]))})"
    flags, letters = _letters(how)
    head = f"^[{_others(letters)}]*" if phrase[4] else ""
    return f"({column} RLIKE {v.quote(flags + head + _pattern(phrase, how))})"


def count_places(column: str, phrase, how: str) -> str:
    """How often a phrase occurs in a column."""
    if not phrase[1]:
        return "0"
    if phrase[4]:
        return f"CAST({_found(column, phrase, how)} AS INT)"
    if _trigram(how):
        whole = phrase[1][0] + "".join(t[-1] for t in phrase[1][1:])
        return f"regexp_count({column}, {v.quote(f'(?={re.escape(whole)})')})"
    return f"regexp_count({column}, {v.quote(_letters(how)[0] + _pattern(phrase, how, True))})"


def predicate(q: Query, columns: list[str]) -> str:
    def walk(n):
        if n[0] in ("and", "or"):
            return f"({walk(n[1])} {n[0].upper()} {walk(n[2])})"
        if n[0] == "not":
            return f"({walk(n[1])} AND NOT {walk(n[2])})"
        cols = [c for c in (range(len(columns)) if n[3] is None else n[3]) if columns[c] is not None]
        if n[0] == "phrase":
            return "(" + (" OR ".join(_found(columns[c], n, q.how) for c in cols) or "FALSE") + ")"
        return "(" + (" OR ".join(_near(columns[c], n[1], n[2], q.how) for c in cols) or "FALSE") + ")"

    return walk(q.root) if q.root else "FALSE"


#: Phrases of a NEAR up to which all orders of them become one pattern each; beyond, texts are searched token by token.
NEAR_PATTERNS = 5


def _near(column: str, phrases: list, n: int, how: str) -> str:
    """Whether the phrases occur in some order with at most n tokens between neighbours."""
    if any(not p[1] for p in phrases):
        return "FALSE"
    if _trigram(how):
        forms = [re.escape(p[1][0] + "".join(t[-1] for t in p[1][1:])) for p in phrases]
        gap, flags = f"(?:.){{0,{n}}}?", "(?s)"
    else:
        flags, letters = _letters(how)
        forms = [_pattern(p, how) + (f"[{letters}]*" if p[2] else "") for p in phrases]
        gap = f"(?:[{_others(letters)}]+[{letters}]+){{0,{n}}}?[{_others(letters)}]+"
    tests = [f"{column} RLIKE {v.quote(flags + gap.join(order))}" for order in itertools.permutations(forms)]
    return f"({' OR '.join(dict.fromkeys(tests))})"


def match(low, a, b, scope) -> E:
    """table MATCH query or column MATCH query. The query may be any expression; one that depends on the row is parsed for each of its values."""
    s, name = scope, a[2].lower() if a[0] == "col" else ""
    pattern = low.expr(b, scope)
    query = pattern.const
    if query is v.MISSING:
        try:
            query = low.constant(b, "MATCH")
        except SqlError:
            query = None
    while s is not None:
        for table, (conf, alias, view) in s.fts.items():
            cols, how = conf["columns"], conf["tokenize"]
            if name == table or name in [c.lower() for c in cols] and (a[1] is None or a[1].lower() == table):
                only = None if name == table else [c.lower() for c in cols].index(name)
                if query is None and pattern.const is not v.MISSING:
                    return E("CAST(NULL AS BOOLEAN)", "bool")
                q = None if query is None else Query(str(query), how, cols)
                if q is not None:
                    s.fts[table] = (conf | {"query": q}, alias, view)
                if q is None or any(n[0] == "near" and len(n[1]) > NEAR_PATTERNS for n in _parts(q.root)):
                    texts = ", ".join(f"coalesce({alias}.{v.ident(c)}, '')" for c in cols)
                    asked = v.text(pattern) if q is None else v.quote(str(query))
                    return E(f"lk_fts_match(array({texts}), {asked}, {v.quote(how)}, array({', '.join(map(v.quote, cols))}), {-1 if only is None else only})", "bool")
                arrays = [searched(f"{alias}.{v.ident(c)}", how) if only in (None, i) else None for i, c in enumerate(cols)]
                return E(predicate(q, arrays), "bool")
        s = s.outer
    raise SqlError("unable to use function MATCH in the requested context", "misuse")


def _parts(n):
    if n is not None:
        yield n
        if n[0] in ("and", "or", "not"):
            yield from _parts(n[1])
            yield from _parts(n[2])


def rank(low, table: str, scope) -> E:
    """The hidden column rank: bm25 where the statement has a MATCH, else NULL."""
    s = scope
    while table not in s.fts:
        s = s.outer
    if s.fts[table][0].get("query") is None:
        return E("CAST(NULL AS DOUBLE)", "real")
    return auxiliary(low, "bm25", [("col", None, table)], scope)


def bm25_sql(columns: list[str], how: str, phrases: list, stats: list[float], n: float, average: float, weights: list[float]) -> str:
    """The score of a row from the corpus statistics: document count, mean length and each phrase's document frequency."""
    length = " + ".join(token_count(c, how) for c in columns)
    parts = []
    for p, df in zip(phrases, stats):
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF) if n - df + 0.5 > 0 else LEAST_IDF
        tf = " + ".join(f"{w!r}D * {count_places(c, p, how)}" for c, w in zip(columns, weights))
        parts.append(f"{idf!r}D * (({tf}) * {K1 + 1}D) / (({tf}) + {K1}D * ({1 - B}D + {B}D * ({length}) / {average!r}D))")
    return f"(-1D * ({' + '.join(parts) or '0D'}))"


def auxiliary(low, name: str, args, scope) -> E:
    """bm25, highlight, snippet, offsets and matchinfo of the row that MATCH selected."""
    table, s = args[0][2].lower(), scope
    while s is not None and table not in s.fts:
        s = s.outer
    if s is None:
        raise SqlError(f"no such cursor: {table}", "misuse")
    conf, alias, view = s.fts[table]
    q, cols, how = conf.get("query"), conf["columns"], conf["tokenize"]
    if q is None:
        raise SqlError(f"unable to use function {name} in the requested context", "misuse")
    rest = [low.expr(x, scope) for x in args[1:]]
    if name == "bm25":
        weights = [float(r.const) for r in rest] + [1.0] * (len(cols) - len(rest))
        columns = [searched(f"{alias}.{v.ident(c)}", how) for c in cols]
        n, average, stats = statistics(low.db.spark, view, cols, how, q.phrases())
        return E(bm25_sql(columns, how, q.phrases(), stats, n, average, weights), "real")
    packed = v.quote(repr([(p[1], p[2], p[3]) for p in q.phrases()]))
    if name == "highlight":
        c = rest[0].const
        return E(f"lk_fts_highlight({alias}.{v.ident(cols[c])}, {c}, {packed}, {v.quote(how)}, {v.text(rest[1])}, {v.text(rest[2])})", "text")
    texts = f"array({', '.join(f'coalesce({alias}.{v.ident(c)}, {v.quote(str())})' for c in cols)})"
    if name == "snippet":
        c = rest[0].const
        return E(f"lk_fts_snippet({texts}, {c}, {packed}, {v.quote(how)}, {v.text(rest[1])}, {v.text(rest[2])}, {v.text(rest[3])}, {rest[4].const})", "text")
    if name == "offsets":
        return E(f"lk_fts_offsets({texts}, {packed}, {v.quote(how)})", "text")
    return E(f"lk_fts_matchinfo({texts}, {packed}, {v.quote(how)}, {v.quote(rest[0].const if rest else 'pcx')})", "blob")


def statistics(spark, view: str, cols: list[str], how: str, phrases: list):
    """(documents, mean length, document frequency of each phrase) in one aggregation over the table."""
    inner = ", ".join(f"{searched(v.ident(c), how)} AS a{i}" for i, c in enumerate(cols))
    freq = [f"count_if({' OR '.join(_found(f'a{i}', p, how) for i in range(len(cols)) if p[3] is None or i in p[3]) or 'FALSE'}) AS d{k}" for k, p in enumerate(phrases)]
    total = " + ".join(token_count(f"a{i}", how) for i in range(len(cols)))
    row = spark.sql(f"SELECT count(*) AS n, avg({total}) AS m{''.join(', ' + f for f in freq)} FROM (SELECT {inner} FROM {view})").first()
    return float(row["n"]), float(row["m"] or 1.0) or 1.0, [float(row[f"d{k}"]) for k in range(len(phrases))]


# -- functions on the executors


def _hits(text, column, phrases, how):
    """(first token, last token, phrase) of each hit in a column's text, and its tokens."""
    toks = tokens(text or "", how)
    terms, out = [t for t, _, _ in toks], []
    for k, (want, prefix, cols) in enumerate(phrases):
        if not want or (cols is not None and column not in cols):
            continue
        for i in range(len(terms) - len(want) + 1):
            part = terms[i : i + len(want)]
            if part[:-1] == want[:-1] and (part[-1].startswith(want[-1]) if prefix else part[-1] == want[-1]):
                out.append((i, i + len(want) - 1, k))
    return sorted(out), toks


def _unpack(packed):
    import ast

    return ast.literal_eval(packed)


def _mark(text, toks, hits, lo, hi, a, b):
    out, at, end = [], toks[lo][1] if lo < len(toks) and lo else 0, len(text) if hi >= len(toks) else toks[hi - 1][2]
    merged = []
    for i, j, _ in hits:
        i, j = max(i, lo), min(j, hi - 1)
        if i > j:
            continue
        if merged and i <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], j)
        else:
            merged.append([i, j])
    for i, j in merged:
        out += [text[at : toks[i][1]], a, text[toks[i][1] : toks[j][2]], b]
        at = toks[j][2]
    return "".join(out) + text[at:end]


@lru_cache(1000)
def _query(text, how, columns):
    return Query(text, how, list(columns))


def lk_fts_match(texts, text, how, columns, only):
    """Whether the row's texts meet a query, token by token."""
    if text is None:
        return None
    q = _query(text, how, tuple(columns))
    terms = [_terms(t, how) if only in (-1, i) else [] for i, t in enumerate(texts)]

    def places(p, c):
        _, want, prefix, cols, start = p
        if not want or (cols is not None and c not in cols):
            return []
        out = []
        for i in range(len(terms[c]) - len(want) + 1):
            part = terms[c][i : i + len(want)]
            if part[:-1] == want[:-1] and (part[-1].startswith(want[-1]) if prefix else part[-1] == want[-1]) and not (start and i):
                out.append((i, i + len(want) - 1))
        return out

    def chained(found, left, end, n):
        if not left:
            return True
        return any(0 <= i - end - 1 <= n and chained(found, left - {k}, j, n) for k in left for i, j in found[k])

    def near(n, c):
        found = [places(p, c) for p in n[1]]
        every = frozenset(range(len(found)))
        return all(found) and any(chained(found, every - {k}, j, n[2]) for k in every for _, j in found[k])

    def walk(n):
        if n[0] == "and":
            return walk(n[1]) and walk(n[2])
        if n[0] == "or":
            return walk(n[1]) or walk(n[2])
        if n[0] == "not":
            return walk(n[1]) and not walk(n[2])
        if n[0] == "phrase":
            return any(places(n, c) for c in range(len(terms)))
        return any(near(n, c) for c in range(len(terms)) if n[3] is None or c in n[3])

    return bool(q.root) and walk(q.root)


def lk_fts_terms(text, how):
    return _terms(text, how)


def lk_fts_highlight(text, column, packed, how, a, b):
    hits, toks = _hits(text, column, _unpack(packed), how)
    return _mark(text, toks, hits, 0, len(toks), a, b)


def lk_fts_snippet(texts, column, packed, how, a, b, dots, n):
    phrases = _unpack(packed)
    pick = [column] if column >= 0 else list(range(len(texts)))
    best = next((c for c in pick if _hits(texts[c], c, phrases, how)[0]), pick[0])
    hits, toks = _hits(texts[best], best, phrases, how)
    lo = max(0, min(hits[0][0] - n // 4 if hits else 0, max(0, len(toks) - n)))
    hi = min(len(toks), lo + n)
    return (dots if lo else "") + _mark(texts[best], toks, hits, lo, hi, a, b) + (dots if hi < len(toks) else "")


def lk_fts_offsets(texts, packed, how):
    out = []
    for c, text in enumerate(texts):
        hits, toks = _hits(text, c, _unpack(packed), how)
        for i, j, k in hits:
            start = len(text[: toks[i][1]].encode())
            out.append(f"{c} {k} {start} {len(text[toks[i][1] : toks[j][2]].encode())}")
    return " ".join(out)


def lk_fts_matchinfo(texts, packed, how, fmt):
    phrases, out = _unpack(packed), []
    per = [[sum(1 for *_, h in _hits(t, c, phrases, how)[0] if h == k) for c, t in enumerate(texts)] for k in range(len(phrases))]
    for f in fmt:
        if f == "p":
            out.append(len(phrases))
        elif f == "c":
            out.append(len(texts))
        elif f in "yx":
            for row in per:
                for n in row:
                    out += [n] if f == "y" else [n, n, int(n > 0)]
        elif f == "s":
            out += [max((row[c] for row in per), default=0) for c in range(len(texts))]
        elif f == "l":
            out += [len(tokens(t, how)) for t in texts]
    return struct.pack(f"<{len(out)}I", *out)


FUNCTIONS = {
    "lk_fts_terms": (lk_fts_terms, "array<string>"), "lk_fts_match": (lk_fts_match, "boolean"), "lk_fts_highlight": (lk_fts_highlight, "string"), "lk_fts_snippet": (lk_fts_snippet, "string"),
    "lk_fts_offsets": (lk_fts_offsets, "string"), "lk_fts_matchinfo": (lk_fts_matchinfo, "binary"),
}
