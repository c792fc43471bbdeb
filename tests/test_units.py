"""Parts that need no session."""

import subprocess
import sys

import pytest
from larkspur.errors import SqlError
from larkspur.functions import json_text as j
from larkspur.functions import values as v
from larkspur.functions.fts import Query, porter, tokens
from larkspur.functions.scalars import glob_regex
from larkspur.functions.udfs import lk_printf, lk_unistr
from larkspur.plans.parser import parse


def test_json_round_trips():
    for s in ['{"b":1,"a":[1,2.0,null,true],"b":"x\\n"}', "[]", "{}", '"é"', "1e5", "-0.5"]:
        assert j.text(j.parse(s, True)) == s
        assert j.text(j.from_jsonb(j.jsonb(j.parse(s)))) == s
    assert j.text(j.parse("{a: 'x', b: [1,], /* c */ c: +.5}")) == '{"a":"x","b":[1],"c":0.5}'
    for bad in ("{", "[1 2]", "{'a':1}", "[1,]", "tru", "01"):
        with pytest.raises(ValueError):
            j.parse(bad, True)


def test_json_changes():
    d = j.parse('{"a":{"b":[1,2,3]}}')
    assert j.text(j.change(d, j.steps("$.a.b[#]"), j.Num("4"), True, True)) == '{"a":{"b":[1,2,3,4]}}'
    assert j.text(j.change(d, j.steps("$.x.y"), True, True, True)) == '{"a":{"b":[1,2,3]},"x":{"y":true}}'
    assert j.text(j.remove(d, j.steps("$.a.b[#-1]"))) == '{"a":{"b":[1,2]}}'
    assert j.text(j.array_insert(d, j.steps("$.a.b[1]"), j.Num("9"))) == '{"a":{"b":[1,9,2,3]}}'
    assert j.text(j.merge_patch(d, j.parse('{"a":{"b":null,"c":1}}'))) == '{"a":{"c":1}}'


def test_affinity_and_reals():
    assert [v.affinity(t) for t in ("INT", "VARCHAR(3)", "BLOB", "", "DOUBLE", "DECIMAL", "FLOATING POINT")] == ["INTEGER", "TEXT", "BLOB", "BLOB", "REAL", "NUMERIC", "INTEGER"]
    assert [v.real_text(x) for x in (1.0, 0.1 + 0.2, 1e20, 1.5e-7, -0.5)] == ["1.0", "0.3", "1.0e+20", "1.5e-07", "-0.5"]


def test_glob_patterns():
    import re

    for pattern, text, ok in [("a*c", "abbc", True), ("[a-c]?", "bz", True), ("[^a]", "a", False), ("*.txt", "x.txt", True), ("[]]", "]", True), ("a.c", "abc", False)]:
        assert bool(re.search(glob_regex(pattern), text)) == ok


def test_printf_and_unistr():
    assert lk_printf("%5.1f|%-4d|%+d|%,d|%c|%%|%s", ["2.25", "7", "3", "1234567", "xyz", None]) == "  2.2|7   |+3|1,234,567|x|%|"
    assert lk_unistr("a\\u00e9\\\\b") == "aé\\b"


def test_porter_and_tokens():
    words = "caresses ponies running hopping relational conditional happy feed agreed probate controlling".split()
    assert [porter(w) for w in words] == "caress poni run hop relat condit happi feed agre probat control".split()
    assert [t for t, _, _ in tokens("Café, naïve!", "unicode61")] == ["cafe", "naive"]
    assert [t for t, _, _ in tokens("abcd", "trigram")] == ["abc", "bcd"]


def test_match_grammar():
    q = Query('title: one AND (two OR "three four"*) NOT NEAR(a b, 4)', "ascii", ["title", "body"])
    assert q.root[0] == "not" and q.root[2][0] == "near" and q.root[2][2] == 4
    for bad in ('"open', "(a", "nope: x", "a AND"):
        with pytest.raises(SqlError):
            Query(bad, "ascii", ["title"])


def test_precedence():
    def expr(s):
        return parse(f"SELECT {s}")[0].arms[0][1].items[0][1]

    assert expr("NOT a = b")[:2] == ("un", "NOT")
    assert expr("1 + 2 * 3") == ("bin", "+", ("lit", 1), ("bin", "*", ("lit", 2), ("lit", 3)))
    assert expr("a OR b AND c")[1] == "OR"
    assert expr("-1") == ("lit", -1)


def test_the_rest_works_without_the_corpus_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith('larkspur.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
