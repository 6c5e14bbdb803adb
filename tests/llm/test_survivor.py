import datetime as dt
from collections import defaultdict

import numpy as np
import pytest

from interlock.llm import survivor
from interlock.llm.survivor import fused_groups, fused_views, most_central, truth_discovery, view_sources
from tests.shapes import SIDES, piece


def test_reliable_sources_win_against_a_split_vote(spark):
    rows = [(f"o{i}", "f", s, v) for i in range(12) for s, v in (("good", 1.0), ("fair", 1.0), ("bad", 2.0))]
    rows += [("x", "f", "good", 5.0), ("x", "f", "bad", 6.0), ("x", "f", None, None), ("y", "f", "bad", 3.0), ("y", "f", "bad", 3.0)]
    df = spark.createDataFrame(rows, "object string, field string, source string, value double")
    got = {(r["object"], r["value"]) for r in truth_discovery(df).collect()}
    assert got == {*((f"o{i}", 1.0) for i in range(12)), ("x", 5.0), ("y", 3.0)}


def test_ties_go_to_the_larger_value_and_empty_gives_none(spark):
    df = spark.createDataFrame([("x", "f", "a", 1.0), ("x", "f", "b", 2.0), (None, "f", "a", 1.0)], "object string, field string, source string, value double")
    assert [(r["object"], r["value"]) for r in truth_discovery(df).collect()] == [("x", 2.0)]
    assert truth_discovery(df.limit(0)).count() == 0


def at(day):
    return dt.datetime(2026, 1, day)


def test_the_latest_alone_wins_and_sources_decide_within_it(spark):
    rows = [("x", "f", s, 1.0, at(1)) for s in "abcdefg"] + [("x", "f", "late", 2.0, at(2)), ("y", "f", "z", 3.0, None), ("y", "f", "q", 9.0, at(1))]
    rows += [(f"o{i}", "f", s, v, at(5)) for i in range(9) for s, v in (("good", 1.0), ("fair", 1.0), ("bad", 7.0))] + [("t", "f", "good", 1.0, at(3)), ("t", "f", "bad", 8.0, at(3))]
    df = spark.createDataFrame(rows, "object string, field string, source string, value double, at timestamp_ntz")
    got = {r["object"]: r["value"] for r in truth_discovery(df).collect()}
    assert got["x"] == 2.0 and got["y"] == 9.0 and got["t"] == 1.0 and got["o3"] == 1.0


def plain(rows, rounds=40, tolerance=1e-3):
    """The same iteration over Python dictionaries."""
    once = {}
    for o, f, s, v, t in rows:
        once[o, f, s, v] = max(t, once.get((o, f, s, v), t))
    facts = defaultdict(list)
    for (o, f, s, v), t in once.items():
        facts[o, f].append((s, v, t))
    fought = {k: [(s, v, t == max(x[2] for x in c)) for s, v, t in c] for k, c in facts.items() if len({v for _, v, _ in c}) > 1}
    calm = defaultdict(int)
    for k, c in facts.items():
        for s, _, _ in c:
            calm[s] += k not in fought
    w = dict.fromkeys(calm, 1.0)

    def winners():
        out = {}
        for k, c in fought.items():
            now, then = (sum(w[s] for s, _, late in c if late == x) for x in (True, False))
            support = {v: round(sum(w[s] / now for s, u, late in c if u == v and late) + (survivor.EARLIER * sum(w[s] / then for s, u, late in c if u == v and not late) if then else 0), 9) for _, v, _ in c}
            out[k] = max((x, v) for v, x in support.items())[1]
        return out

    for k in range(rounds):
        best, right, all_ = winners(), defaultdict(int), defaultdict(int)
        for key, c in fought.items():
            for s, v, _ in c:
                right[s] += v == best[key]
                all_[s] += 1
        new = {s: w[s] + min(1, 0.5 ** (k - survivor.COOLING)) * (-np.log(1 - (right[s] + calm[s] + 1) / (all_[s] + calm[s] + 2)) - w[s]) for s in w}
        moved = max(abs(new[s] - w[s]) for s in w)
        w = new
        if moved <= tolerance:
            return {**{k: c[0][1] for k, c in facts.items() if k not in fought}, **winners()}, k


def test_equals_a_plain_iteration(spark):
    r = np.random.default_rng(2)
    trust = r.uniform(0.2, 0.95, 12)
    rows = [(f"o{o}", f, f"s{s}", float(o % 7) if r.random() < trust[s] else float(r.integers(0, 9)), at(int(r.integers(1, 4)))) for o in range(80) for f in "wh" for s in r.choice(12, 5, replace=False)]
    want, rounds = plain(rows)
    assert rounds >= 2
    got = {(x["object"], x["field"]): x["value"] for x in truth_discovery(spark.createDataFrame(rows, "object string, field string, source string, value double, at timestamp_ntz")).collect()}
    assert got == want
    with pytest.raises(RuntimeError):
        truth_discovery(spark.createDataFrame(rows, "object string, field string, source string, value double, at timestamp_ntz"), rounds=1)


def test_most_central_view(spark):
    rows = piece(1, [1, 2, 3, 4], centroid=[50.0, 60.0]) + piece(2, [1, 2, 3, 4], centroid=[50.0, 40.0]) + piece(3, [1, 2, 3, 4], centroid=None) + piece(4, [5, 6, 7, 8], centroid=None) + piece(5, [5, 6, 7, 8], width=None)
    sides = spark.createDataFrame(rows, SIDES)
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "piece_id long, group_id long")
    views = fused_views(sides, groups)
    assert {tuple(r) for r in most_central(views).select("group_id", "piece_id").collect()} == {(1, 1)}  # 1 and 2 tie
    got = {r["group_id"]: r for r in fused_groups(views, view_sources(sides)).collect()}
    assert {g: (r["photo_width"], r["photo_height"]) for g, r in got.items()} == {1: (100.0, 100.0), 4: (100.0, 100.0)}
    assert got[1]["photo_space_centroid"] in ([50.0, 60.0], [50.0, 40.0]) and got[4]["photo_space_centroid"] == [10.0, 10.0]
