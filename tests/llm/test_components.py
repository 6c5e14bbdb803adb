import datetime as dt
import random

from interlock.llm.components import connected_components, latest_decisions, smallest_member, view_groups


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in up}


def test_chain_star_and_random(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(r.randint(2000, 2300), r.randint(2000, 2300)) for _ in range(150)]
    pairs += [(5, 5), (None, 7), (61, 60), (61, 60), (9000, 9000)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {tuple(x) for x in smallest_member(connected_components(df)).collect()}
    assert got == brute(pairs)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(3, 3), (None, 1)], "a long, b long")).count() == 0


def test_only_the_latest_decision_counts(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    rows = [(1, 2, True, t(1)), (2, 1, False, t(2)), (3, 4, None, t(1)), (4, 3, True, t(3)), (5, 6, True, None), (6, 6, True, t(1)), (7, 8, True, t(1))]
    df = spark.createDataFrame(rows, "a long, b long, confirmed boolean, checked_at timestamp_ntz")
    assert {tuple(x) for x in latest_decisions(df).where("confirmed").collect()} == {(3, 4, True), (5, 6, True), (6, 6, True), (7, 8, True)}
    usable = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7)], "piece_id long")
    assert {tuple(x) for x in view_groups(df, usable).collect()} == {(3, 3), (4, 3), (5, 5), (6, 5)}
