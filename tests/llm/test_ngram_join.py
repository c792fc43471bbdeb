import random
import re

from larkspur.llm import ngram_join as nj


def brute_links(rows, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_id = {}
    for a, (i, _) in enumerate(rows):
        if i is None:
            continue
        if i in by_id:
            root[find(a)] = find(by_id[i])
        by_id[i] = a
        for b in range(a):
            if rows[b][0] is not None and sets[a] and sets[b]:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return sorted((str(i), len(s), str(low.get(find(a)) if i is not None else None)) for a, ((i, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    lines = ["all rights reserved by us here.", "One more common line of words", "short"]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            w = rng.choice(texts[-40:]).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append("\n".join(rng.choices(lines + passages, k=rng.randint(1, 4))))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(1, 120))) + rng.choice(["", "\n" + rng.choice(passages)]))
    base = " ".join(rng.choices(words, k=100)).split(" ")
    for i in range(60):
        w = list(base)
        w[i] = f"x{i}"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [(9001, None), (9002, ""), (9003, " \n\t"), (None, texts[3]), (9004, texts[3]), (9004, "another text under one id"), (9005, "w1 " * 4000)]


def answer(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nj, "PART_ROWS", 7)
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert answer(nj.links(df)) == brute_links(rows)


def test_part_components_follow_chains():
    import numpy as np

    sets = [np.arange(i, i + 40, dtype=np.int64) for i in range(0, 60, 3)] + [np.arange(500, 540, dtype=np.int64)]
    root = nj.part_components(sets, 80)
    assert list(root[:-1]) == [0] * 20 and root[-1] == 20


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string, key string, n long, component string")
    assert nj.links(df).count() == 0
    rows = [(1, "a b c d e f", "k", 5, "c"), (2, "a b c d e f", "k", 5, "c"), (3, "z", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n long, component string")
    assert sorted(r["doc_id"] for r in nj.keep_one(df).collect()) == [1, 3]


def crowds(seed):
    """Documents that share a passage of most of their words, at similarities on either side of the threshold, of many sizes."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for length in (12, 40, 90):
        passage = rng.choices(words, k=length)
        for _ in range(70):
            own = rng.randint(0, length // 4)
            text = [f"u{rng.randrange(10**9)}" for _ in range(own)]
            k = rng.randint(0, own)
            rows.append((len(rows), " ".join(text[:k] + passage + text[k:])))
    halves = [rng.choices(words, k=30) for _ in range(5)]
    for _ in range(60):
        rows.append((len(rows), " ".join(rng.choice(halves) + rng.choice(halves) + rng.choices(words, k=rng.randint(0, 3)))))
    return rows


def test_the_matrix_alone_finds_every_link(spark, monkeypatch):
    """Step 3 without the links of step 2."""
    alone = lambda classes, percent: classes.select("rep", nj.F.col("rep").alias("block"))
    none = lambda classes, parts, percent: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(nj, "PART_ROWS", 5)
    for rows in (corpus(3), crowds(4)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        with monkeypatch.context() as m:
            m.setattr(nj, "_blocks", alone)
            m.setattr(nj, "_starred", none)
            assert answer(nj.links(df)) == brute_links(rows)
        assert answer(nj.links(df)) == brute_links(rows)


def test_other_thresholds_and_the_shuffled_side(spark, monkeypatch):
    monkeypatch.setattr(nj, "BROADCAST_KEYS", -1)
    rows = crowds(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent in (50, 100):
        assert answer(nj.links(df, percent)) == brute_links(rows, percent)
