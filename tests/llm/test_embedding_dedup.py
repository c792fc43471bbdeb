import numpy as np
from larkspur.llm import embedding_dedup as ed
from larkspur.llm.graph import components, local_roots


def brute(rows, threshold=ed.THRESHOLD):
    n = len(rows)
    ok = [
        i is not None and l is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, l in rows
    ]
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    low = {}
    for a in range(n):
        if rows[a][0] is not None:
            low[find(a)] = min(low.get(find(a), rows[a][0]), rows[a][0])
    return sorted(
        (str(rows[a][0]), links[a], str(low.get(find(a))), rows[a][0] is not None and rows[a][0] == low[find(a)]) for a in range(n)
    )


def answer(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ed, "CELL_ROWS", 20)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(220):
        v = base[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.1, 0.35])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(300, rows[5][1], rows[5][2]), (301, rows[5][1], rows[5][2]), (302, rows[5][1], None)]
    rows += [(303, None, 1), (304, [0.0] * 8, 1), (305, [float("nan")] + [1.0] * 7, 1), (306, [None] + [1.0] * 7, 1)]
    rows += [(307, [], 1), (308, [1.0] * 4, 1), (309, [2.0] * 4, 1), (None, rows[5][1], rows[5][2]), (310, [float("inf")] + [1.0] * 7, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert answer(ed.near_duplicates(df)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ed.near_duplicates(df).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(7, None)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    edges = [(a, b) for a, b in pairs if b is not None and a != b]
    root = local_roots(1200, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert got == {int(x): int(root[x]) for e in edges for x in e}


def test_long_vectors_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=4000)
    vectors = [base, base + rng.normal(size=4000) * 0.05, rng.normal(size=4000), base * 3]
    rows = [(i, v.tolist(), "a", "x", 9, 1.5) for i, v in enumerate(vectors)] + [(9, [1.0], "a", "x", 9, 1.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, rep string, weight int, angle double")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ed.near_duplicates(df).collect())
    assert got == [(0, 2, 0, True), (1, 2, 0, False), (2, 0, 2, True), (3, 2, 0, False), (9, 0, 9, True)]
