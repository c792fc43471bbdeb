import itertools
import random

from larkspur.llm import chat_format as cf


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and (not roles or bool(body))


def brute_cost(roles):
    """Least cost over all ways to merge, relabel and insert."""
    best = [0 if not roles else 10**9]

    def go(i, out, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            for k, more in enumerate(([], ["user"], ["assistant"], ["user", "assistant"])):
                if legal(out + more):
                    best[0] = min(best[0], cost + len(more) * cf.INSERT)
            return
        for r in ("system", "user", "assistant"):
            change = 0 if r == roles[i] else cf.RELABEL
            if out and out[-1] == r:
                go(i + 1, out, cost + change + cf.MERGE)
            for more in ([], ["user"], ["assistant"]):
                go(i + 1, out + more + [r], cost + change + len(more) * cf.INSERT)

    go(0, [], 0)
    return best[0]


def test_least_cost():
    kinds = ["system", "user", "assistant", None]
    for n in range(5):
        for roles in itertools.product(kinds, repeat=n):
            assert cf.repair([cf.role_number(r) for r in roles])[0] == brute_cost(list(roles)), roles


def rendered(roles, texts):
    _, path, extra = cf.repair([cf.role_number(r) for r in roles])
    return "".join(p for *_, p in cf.pieces(path, texts, extra))


def test_conversations_over_many_tasks(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(900 if conv == 7 else rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["a", "b\nc", "", None])))
    monkeypatch.setattr(cf, "partitions", lambda spark: 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = cf.format_turns(df).collect()
    assert sum(r["turn"] is not None for r in out) == len(rows)
    for conv in [*range(30), None]:
        mine = [r for r in rows if r[0] == conv]
        got = sorted((r["step"], r["piece"], r["role"], r["action"]) for r in out if r["conv"] == conv)
        assert "".join(g[1] for g in got) == rendered([m[2] for m in mine], [m[3] for m in mine])
        assert legal([g[2] for g in got if not g[3].endswith("merge")])


def test_empty(spark):
    assert cf.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_texts_repeated_rows_and_clashing_names(spark):
    long = "x" * 300_000
    rows = [(1, 0, "user", long, "p", 5, "s"), (1, 1, "assistant", "ok", "p", 5, "s"), (1, 1, "assistant", "ok", "p", 5, "s"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, pos int, step string")
    out = sorted(((r["conv"] or 0, r["step"], r["turn"], r["role"], r["action"], r["piece"]) for r in cf.format_turns(df).collect()), key=lambda r: r[:2])
    assert [r[2:] for r in out if r[0]] == [(0, "user", "keep", "<|user|>\n" + long), (1, "assistant", "keep", "<|end|>\n<|assistant|>\nok"), (1, "assistant", "merge", "\n\nok")]
    assert "".join(r[5] for r in out if not r[0]) == rendered([None], [None])


def test_other_column_names(spark):
    df = spark.createDataFrame([("c", 1, "user", "hi")], "thread string, n int, who string, said string")
    out = sorted((r["step"], r["role"], r["piece"]) for r in cf.format_turns(df, "thread", "n", "who", "said").collect())
    assert [r[1:] for r in out] == [("user", "<|user|>\nhi"), ("assistant", "<|end|>\n<|assistant|>\n")]
