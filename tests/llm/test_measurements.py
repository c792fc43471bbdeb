import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from larkspur.llm import bpe_codec, mixing, quality_rules, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "", "a", "Don't stop, they'll go!", "  two  spaces\n\n\tand tabs ", "é漢字 Σσς 123٣²½ İ", "a" * 5000, "ab" * 3000, "<|endoftext|>x<|startoftext|> y <|endoftext|>",
    "a\x1cb\x85c d", "#tag|pipe <b>&amp;</b>", "word " * 3000, "ünïcödé " * 50, "''s't", "🙂 🙂🙂",
]


def test_token_counts_agree_with_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df.drop("n_tokens"), path, ("doc_id",)).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)


def test_token_counts_with_newer_letters(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = [*"aÀé e\u0301Σ9 \u1c89\ua7cb\ua7dc\U00010d40\U0001e5d0\U00013808\U00016d68\U00016d67\U000113c2\U000113b8", "don't "]
    counter = token_counts.counter(path)
    for _ in range(1500):
        t = "".join(rng.choices(alphabet, k=rng.randint(1, 12)))
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), ascii(t)


def test_token_counts_with_clashing_names_and_without_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "two words", "clash", None), (1, "two words", "clash", None)], "doc_id long, text string, n_tokens string, __text string")
    got = token_counts.count_tokens(df, path, ("doc_id", "n_tokens", "__text", "text")).collect()
    assert [(r["doc_id"], r["text"], r["n_tokens"], r["__text"]) for r in got] == [(1, "two words", 2, None)] * 2
    assert token_counts.count_tokens(df.limit(0), path, ("doc_id",)).count() == 0


def test_codec_without_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.decode(bpe_codec.encode(df, path), path).count() == bpe_codec.digest(df, path).count() == 0


def test_whole_tokens_are_proven():
    counter = token_counts.counter(public_tokenizers.path("word_bpe_49k.json"))
    v = counter.v
    assert all(len(v.merge(v.strings[i])) == 1 for i in list(v.whole)[::37])
    assert all(len(v.merge(s)) > 1 for s, i in list(v.ids.items())[::11] if i not in v.whole)


def test_codec_agrees_with_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(99, None, 7)], "doc_id long, text string, ids int")
    coded = bpe_codec.decode(bpe_codec.encode(df, path), path)
    for r in coded.collect():
        t = r["text"] or ""
        assert r["ids"] == library.encode(t, add_special_tokens=False).ids
        assert r["decoded"] == t == library.decode(r["ids"], skip_special_tokens=False)


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_rules_against_brute_force():
    texts = [*TEXTS, "\n\na b c a b c\n a\n\n", "x y\nx y\n", "a b a b", "\n", None, "l1\nl1\n l1\nl1 "]
    parts = [quality_rules.measure_chunk(buf, off) for _, buf, off in quality_rules.tb.chunks(pa.array(texts), 50)]
    got = [tuple(x[k][i].item() for k in x) for x in parts for i in range(len(x["n_words"]))]
    assert got == [brute_rules(t) for t in texts]


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, bad, "farm") for i in range(60)] + [(200, good, "farm"), (201, good, None), (202, None, "new"), (203, good, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    assert all(kept[i] for i in range(40)) and not kept[200] and kept[201] and not kept[202] and kept[203]
    left = {r["doc_id"] for r in quality_rules.filter_documents(df).collect()}
    assert left == {i for i, k in kept.items() if k}
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_mixing_meets_margins_and_budget(spark):
    rows = [(i, " ".join(["w"] * (20 + i % 30)) + ("\na | b" if i % 7 == 0 else ""), f"s{i % 3}" if i % 11 else None, "en" if i % 4 else "de") for i in range(600)]
    rows += [(9000, None, "s0", "en"), (9001, "", "s0", "en"), (None, "word " * 30, "s1", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    total = sum(r["n_tokens"] for r in out)
    assert abs(sum(r["n_tokens"] * r["prob"] for r in out) / total - mixing.RATE) < 0.01
    assert all(0 <= r["prob"] <= 1 for r in out) and not any(r["kept"] for r in out if r["n_tokens"] == 0)
    cells = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in out}
    for at, margin in enumerate(("source", "lang")):
        by = Counter()
        for r in out:
            by[r[margin]] += r["n_tokens"]
        scale = sum(n**0.5 for n in by.values())
        for k, n in by.items():
            assert abs(sum(w for c, w in cells.items() if c[at] == k) - n**0.5 / scale) < 0.02
    left = {r["doc_id"] for r in mixing.sample(df).collect()}
    assert left == {r["id"] for r in out if r["kept"]}
    assert mixing.sample(df.limit(0)).count() == 0
