import hashlib
import random
import re
import time

import numpy as np
from larkspur.llm import line_dedup as ld
from larkspur.llm.graph import components
from larkspur.llm.store import cut
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows, percent=80):
    """What stays of each (id, text) by comparing all lines with all others."""
    lines = []
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                s = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
                lines.append((i, k, {s[j : j + 5] for j in range(max(1, len(s) - 4))}))
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a][2], lines[b][2]
            if 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    first = {}
    for a, (i, k, _) in enumerate(lines):
        r = find(a)
        first[r] = min(first.get(r, (i, k)), (i, k))
    gone = {}
    for a, (i, k, _) in enumerate(lines):
        if first[find(a)] != (i, k):
            gone.setdefault(i, set()).add(k)
    return {i: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(i, ())) for i, text in rows}


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijé漢", k=rng.randint(2, 9))) for _ in range(300)]
    pool = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 40)))
            if rng.random() < 0.4:
                w = line.split(" ")
                w[rng.randrange(len(w))] = rng.choice(words)
                line = " ".join(w)
            lines.append(rng.choice(["", " "]) + (line.upper() if rng.random() < 0.1 else line))
            if rng.random() < 0.2:
                lines.append("")
        rows.append((i, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, "\n \n"), (503, "abc"), (504, "abc\nabc\n"), (505, "word " * 3000)]


def test_against_all_pairs(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    want = brute(rows)
    gone = {i for i, t in rows if t and WORD.search(t) and not WORD.search(want[i])}
    got = {r["doc_id"]: r["text"] for r in ld.dedup(df).collect()}
    wrong = [i for i, _ in rows if (got.get(i, "gone") if i in gone else got[i]) != ("gone" if i in gone else want[i])]
    assert len(wrong) <= 1, wrong  # MinHash may miss a pair at the very threshold


def test_query(spark, tmp_path):
    rows = corpus(2)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    got = {r["doc_id"]: r["kept_sha256"] for r in ld.query(spark, str(tmp_path)).collect()}
    wrong = [i for i, _ in rows if got[i] != hashlib.sha256((want[i] or "").encode()).hexdigest()]
    assert len(wrong) <= 1, wrong


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup(df).count() == 0


def test_pairs_across_each_number_of_bins(spark):
    rng = random.Random(3)
    rows = []
    for n in (52, 100, 196, 388):
        for _ in range(15):
            line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n + n // 40))
            rows += [(len(rows), line[: n - 1]), (len(rows) + 1, line)]
    for _ in range(15):  # sizes in different shingles, not in characters
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=48))
        rows += [(len(rows), line), (len(rows) + 1, line * 12)]
    want = brute(rows)
    got = {r["doc_id"] for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i for i, _ in rows if want[i]}


def test_crowd_that_shares_a_passage(spark):
    rng = random.Random(4)

    def some(k):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))

    passage, rows = some(44), []
    for _ in range(700):  # similarity 0.74 to each other
        rows.append((len(rows), passage + some(7)))
    for i in range(60):  # 0.84 to one of them
        rows.append((len(rows), rows[i][1][:-4] + some(4)))
    want = brute(rows)
    got = {r["doc_id"] for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i for i, _ in rows if want[i]}


def test_crossing_pairs_equal_all_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    for trial in range(60):
        pool = [np.unique(rng.integers(0, 60 if trial % 2 else 5000, rng.integers(1, 40))) for _ in range(4)]
        sets = []
        for _ in range(60):
            base = pool[rng.integers(len(pool))]
            keep = base[rng.random(len(base)) < rng.choice([0.8, 0.9, 0.97, 1.0])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 10**6, rng.integers(0, 4))])).astype(np.uint64))
        sets = [x if len(x) else np.array([7], np.uint64) for x in sets]
        second, of = rng.random(60) < 0.5, rng.integers(0, 25, 60)
        want, every = set(), set()
        for i in range(60):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if of[i] != of[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    every.add(frozenset((of[i], of[j])))
                    if second[i] != second[j]:
                        want.add(frozenset((of[i], of[j])))
        for dense in (ld.DENSE, 0, 10**9):
            with monkeypatch.context() as m:
                m.setattr(ld, "DENSE", dense)
                m.setattr(ld, "SLICE", 200)
                if second.any() and not second.all():
                    assert {frozenset(p) for p in ld.crossing(sets, second, of, 80).T.tolist()} == want
                    inner = ld.crossing(sets, None, of, 80)
                    assert want <= {frozenset(p) for p in inner.T.tolist()} == every


def test_recall_in_large_families(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(500)]
    for length in (18, 24):
        base, rows = rng.choices(words, k=length), []
        for _ in range(600):
            w = list(base)
            for k in rng.sample(range(length), 2):
                w[k] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
        want = brute(rows)
        got = {r["doc_id"] for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        drops = {i for i, _ in rows if not want[i]}
        missed = len(drops & got)
        assert not {i for i, _ in rows if want[i]} - got  # none goes that all pairs would keep
        assert missed <= 0.01 * len(drops), (length, missed, len(drops))


def test_null_ids_and_repeated_rows(spark):
    line = "a line that stands in many documents of this corpus"
    rows = [(None, line), (3, line + "\nown words of three"), (3, line + "\nown words of three"), (2, line), (None, "another text altogether")]
    got = sorted((r["doc_id"] or -1, r["text"]) for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, "another text altogether"), (2, line), (3, "own words of three"), (3, "own words of three")]


def test_shuffled_sides_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(corpus(5), "doc_id long, text string").repartition(3)
    want = sorted(map(str, ld.dedup(df).collect()))
    monkeypatch.setattr(ld, "BROADCAST_KEYS", -1)
    assert sorted(map(str, ld.dedup(df).collect())) == want


def test_maps_rule_out_pairs_and_no_similar_one():
    rng, size = np.random.default_rng(8), 300
    base = rng.integers(0, 10**6, 5 * size)
    sets = [np.unique(base[a : a + size]) for a in (0, 10, 20, 30, 100, 150, 2 * size, 3 * size)]
    n = np.array([len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    i, j = np.nonzero(np.tri(len(sets), k=-1, dtype=bool))
    left = set(zip(*(x.tolist() for x in ld._unruled(i, j, n, np.repeat(np.arange(len(sets)), n), column, 80))))
    alike = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert len(alike) == 6 and alike <= left and not any((a, b) in left for a in (6, 7) for b in range(4))


def test_hash_of_a_line_follows_its_bytes_alone():
    rng = random.Random(12)
    texts = ["".join(rng.choices("ab é漢", k=rng.randint(1, 40))) for _ in range(400)]
    apart = [int(ld.lines_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[4][0]) if WORD.search(t) else None for t in texts]
    raw = [t.encode() for t in texts]
    together = ld.lines_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert together[4].tolist() == [a for a in apart if a is not None]
    lines = {t.strip(" ") for t in texts if WORD.search(t)}
    assert len(set(together[4].tolist())) == len(lines)


def test_components_in_one_task_are_those_of_the_rounds(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([(rng.randrange(400), rng.choice([None, *range(400)])) for _ in range(300)] + [(-(10**12), 399)], "a long, b long").repartition(3)
    want = sorted(map(tuple, components(df).collect()))
    assert sorted(map(tuple, components(df, in_task=1000).collect())) == want
    assert components(df.limit(0), in_task=1000).count() == 0


def test_large_bands_of_one_component_are_taken_as_one(spark):
    bands = {1: range(0, 30), 2: range(2, 32), 3: range(1, 31), 4: range(100, 130), 5: range(130, 160)}
    comp = {x: 7 if x % 10 else x for x in range(100)} | {x: 9 if x % 10 else x for x in range(100, 200)}
    rows = [(b, comp[x], x) for b, lines in bands.items() for x in lines]
    size = {(b, c): sum(r[0] == b and r[1] == c for r in rows) for b, c, _ in rows}
    lines = spark.createDataFrame([(b, c, x, size[b, c], 30, 7 if b < 4 else 9) for b, c, x in rows], "band long, component long, line long, n long, total long, main long")
    got = ld.taken_together(lines, lines.select("band", "component", "n", "total", "main").distinct()).collect()
    assert sorted(r["line"] for r in got if r["band"] == 7) == list(range(32))  # the first three bands have 32 lines of 90
    assert {(r["n"], r["total"]) for r in got if r["band"] == 7 and r["component"] == 7} == {(28, 32)}
    assert sorted((r["band"], r["line"]) for r in got if r["band"] != 7) == [(b, x) for b in (4, 5) for x in bands[b]]  # no line in common
    assert len(ld._dealt(spark.createDataFrame(got)).select("line").collect()) < len(ld._dealt(lines.drop("main")).select("line").collect())


def test_large_bands_lose_no_line(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 16)
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(500)]
    base, rows = rng.choices(words, k=18), []
    for _ in range(400):
        w = list(base)
        for k in rng.sample(range(18), 2):
            w[k] = rng.choice(words)
        rows.append((len(rows), " ".join(w)))
    want = brute(rows)
    got = {r["doc_id"] for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    drops = {i for i, _ in rows if not want[i]}
    assert not {i for i, _ in rows if want[i]} - got and len(drops & got) <= 0.01 * len(drops), (len(drops & got), len(drops))


def test_map_of_keys_rules_out_others_and_no_key(spark, monkeypatch):
    rng = np.random.default_rng(13)
    keys, others = (rng.integers(-(2**63), 2**63 - 1, 900) for _ in range(2))
    lines = spark.createDataFrame([(int(k),) for k in keys], "line long")
    for part in (4, 9, 20):
        monkeypatch.setattr(ld, "PART_BITS", part)
        marks = ld._marks(lines, len(keys))
        assert len(marks) == 1024 and ld._marked(marks, keys).all() and ld._marked(marks, others).mean() < 0.2
    assert not ld._marked(ld._marks(lines.limit(0), 0), others).any()


def test_lines_that_a_crowded_map_lets_through_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(corpus(7), "doc_id long, text string").repartition(3)
    want = sorted(map(str, ld.dedup(df).collect()))
    monkeypatch.setattr(ld, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(ld, "MAP_BITS", 4)
    assert sorted(map(str, ld.dedup(df).collect())) == want


def _shuffled(spark):
    store = spark.sparkContext._jsc.sc()
    store.listenerBus().waitUntilEmpty(30_000)
    stages = store.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_moved_only_of_lines_with_a_partner(spark, tmp_path, monkeypatch):
    rng = random.Random(14)
    lines = ["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(1000)) for _ in range(400)]
    lines += [x[:-9] + "another" for x in lines[:100]]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(ld, "BROADCAST_KEYS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        assert ld.dropped_lines(df).count() == 100
        moved = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved < 3000 * 500  # the texts have 3,000 bytes each


def test_files_of_a_shuffle_go_when_its_result_is_written(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    rows = cut(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_join_on_buckets_moves_one_side(spark):
    held = cut(spark.range(500).selectExpr("id * 3 as line", "string(id) as line_text").groupBy("line").agg(F.min("line_text").alias("line_text")), by="line")
    pairs = spark.range(900).selectExpr("id as a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = pairs.join(held.select(F.col("line").alias("a"), "line_text"), "a")
        assert {(r["a"], r["line_text"]) for r in joined.collect()} == {(3 * i, str(i)) for i in range(300)}
        assert joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables("default") if t.name.startswith("larkspur_")]
