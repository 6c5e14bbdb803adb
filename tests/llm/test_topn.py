import random

from interlock.llm.topn import top_n_per_group


def brute(rows, n):
    best = {}
    for g, a, b, s in rows:
        if a is not None and b is not None and s is not None:
            k = (g, a, b)
            best[k] = min(s, best.get(k, s))
    out = set()
    for g in {k[0] for k in best}:
        mine = sorted((s, a, b) for (h, a, b), s in best.items() if h == g)
        out |= {(g, i + 1, a, b, s) for i, (s, a, b) in enumerate(mine[:n])}
    return out


def test_equals_brute_force_with_hot_group_ties_and_nulls(spark):
    r = random.Random(1)
    rows = [(1 if r.random() < 0.4 else r.choice([2, 3, None]), r.choice([None, *range(40)]), r.choice([None, 0, 1]), r.choice([None, *range(9)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g long, a long, b int, s int")
    got = {tuple(x) for x in top_n_per_group(df, ["g"], ["a", "b"], "s", 5, salts=4).collect()}
    assert got == brute(rows, 5)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "salt long, i0 long, s int, r int, g0 int")
    assert [tuple(x) for x in top_n_per_group(df, ["salt"], ["i0"], "s", 1).collect()] == [(1, 1, 2, 3)]
    assert top_n_per_group(df.limit(0), ["salt"], ["i0"], "s", 1).count() == 0
    assert top_n_per_group(df, ["salt"], ["i0"], "s", 0).count() == 0
