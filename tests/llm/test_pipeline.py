"""The pipeline, stage by stage, against brute force."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from larkspur.llm import bpe_codec, mixing, quality_rules
from larkspur.llm import textbytes as tb

from tests.llm.test_line_dedup import WORD
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_measurements import brute_rules
from tests.llm.test_ngram_join import brute_links

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]
    notice = "all rights reserved by the owners of this page and of its parts"
    rows = []
    for i in range(90):
        if i % 6 == 5:
            w = rows[-1]["text"].split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        else:
            text = "\n".join(" ".join(rng.choices(words, k=rng.randint(15, 40))) for _ in range(rng.randint(2, 5)))
        if i % 4 == 0:
            text += "\n" + notice
        if i % 10 == 9:
            text = "same old words " * 40
        rows.append({"doc_id": i, "text": text, "lang": ("en", "de")[i % 2], "source": f"s{i % 3}", "n_chars": len(text)})
    rows.append({"doc_id": 500, "text": None, "lang": "en", "source": "s0", "n_chars": 0})
    return rows


def brute_mix(docs):
    cells = Counter()
    size = {}
    for r in docs:
        t = r["text"] or ""
        symbols, lines = sum(t.count(c) for c in "#*$%&<>{}"), t.count("\n") + 1
        topic = "table" if " | " in t else "symbols" if symbols * 20 > len(t) else "lines" if len(t) < lines * 80 else "prose"
        size[r["doc_id"]] = ((r["source"], r["lang"], topic), len(t.split()))
        cells[size[r["doc_id"]][0]] += len(t.split())
    w = {c: float(n) for c, n in cells.items()}
    goal = []
    for m in range(3):
        by = Counter()
        for c, n in cells.items():
            by[c[m]] += n
        total = sum(n**0.5 for n in by.values())
        goal.append({k: n**0.5 / total for k, n in by.items()})
    for _ in range(mixing.SWEEPS):
        for m in range(3):
            by = Counter()
            for c, x in w.items():
                by[c[m]] += x
            w = {c: x * goal[m][c[m]] / by[c[m]] for c, x in w.items()}
    budget = scale = mixing.RATE * sum(cells.values())
    for _ in range(mixing.STEPS):
        scale *= budget / sum(min(cells[c], scale * w[c]) for c in cells)
    kept = set()
    for d, (c, n) in size.items():
        u = int(hashlib.md5(f"{d}:0".encode()).hexdigest()[:13], 16) / 16**13
        if n and u < min(1.0, scale * w[c] / cells[c]):
            kept.add(d)
    return kept


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    from larkspur.llm.store import cut

    docs = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([tuple(r.values()) for r in docs], schema)
    stages = [f for _, f in corpus_pipeline.STAGES]

    def rows(df):
        return {r["doc_id"]: r.asDict() for r in df.collect()}

    df = cut(stages[0](spark, df, ""))
    got = rows(df)
    assert set(got) == {r["doc_id"] for r in docs if not brute_rules(r["text"])[-1]}

    want = brute_lines(sorted((i, r["text"]) for i, r in got.items()))
    df = cut(stages[1](spark, df, ""))
    got = rows(df)
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, t in want.items() if WORD.search(t)}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    links = brute_links(sorted((i, r["text"]) for i, r in got.items()))
    df = cut(stages[2](spark, df, ""))
    got = rows(df)
    assert set(map(str, got)) == {i for i, _, c in links if i == c}

    df = cut(stages[3](spark, df, ""))
    kept = brute_mix(list(got.values()))
    got = rows(df)
    assert set(got) == kept

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages[4](spark, df, "").collect():
        text = got[r["doc_id"]]["text"]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run_equals_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(r.values()) for r in corpus()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_an_empty_table_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, component string, __text string, dropped string, weight double, n int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(2000)]
    rows = [(i, " ".join(rng.choices(words, k=80)), "en", f"s{i % 2}", 1, "k", "c", "t", "d", 0.5, 7) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0", 1, "k", "c", "t", "d", 0.5, 7), (None, None, None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, f"{tmp_path}/some")
        assert docs.columns == columns
    assert {r["doc_id"] for r in docs.select("doc_id", "key", "__text").collect()} <= set(range(40))
    assert 0 < corpus_pipeline.run(spark, f"{tmp_path}/some").count() <= 40


def test_workers_give_back_what_other_stages_took(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "some words of a text " * 40, "s") for i in range(4)], "doc_id long, text string, source string").coalesce(1)

    def held(batches):
        import pyarrow as pa
        from larkspur.llm import bpe_codec

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"held": [bpe_codec.codec.cache_info().currsize] * batch.num_rows})

    assert bpe_codec.digest(docs, path).count() == 4
    assert [r["held"] for r in docs.mapInArrow(held, "held long").collect()] == [1] * 4  # the next task of this stage has it
    assert quality_rules.measure(docs).where("n_words > 0").count() == 4
    assert [r["held"] for r in docs.mapInArrow(held, "held long").collect()] == [0] * 4


def test_tasks_trim_what_they_freed():
    """Freed below a block that stays, memory goes back only when asked for."""

    def size():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    def run(batches):
        blocks = [np.ones(64 << 10, np.uint8) for _ in range(2000)]
        stay.append(blocks[-1])
        del blocks
        yield from batches

    stay, before = [], size()
    assert list(tb.lean(run)([1, 2])) == [1, 2]
    assert size() - before < 40 << 20
