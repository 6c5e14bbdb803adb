import os

import numpy as np
import pytest

from interlock.llm.mixing import _blocks, leaves, mix, planned, quotas
from interlock.llm.mixing import shares as report_of
from interlock.llm.tokens import VOCABULARY


def test_the_tree_splits_exactly_and_evenly():
    counts = [100, 7, 0, 53]
    got = sorted(leaves(counts, 7, 0, 6, 3), key=lambda x: x[0])
    parts = np.array([c for _, _, c in got])
    assert (parts.sum(axis=0) == counts).all() and (parts >= 0).all() and [k for k, _, _ in got] == list(range(7))
    assert parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 2
    assert (np.array([s for _, s, _ in got]) == parts.cumsum(axis=0) - parts).all()
    for k in range(7):  # each shard by itself comes out the same
        assert [(a, b.tolist(), c.tolist()) for a, b, c in leaves(counts, 7, k, k, 3)] == [(k, got[k][1].tolist(), got[k][2].tolist())]


def test_draws_keep_caps_and_shares(spark):
    r = np.random.default_rng(1)
    blocks = [(s, b, int(t)) for s, n in (("a", 300), ("b", 40), ("c", 3)) for b, t in enumerate(r.integers(50, 150, n))]
    goals = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.02, 6), ("gone", 0.18, 3)]
    table = spark.createDataFrame(blocks, "mix_source string, block long, tokens long")
    plan, sums, n = planned(table, goals, 5, 3)
    out = [(x["mix_source"], x["block"], x["copy"], x["shard"]) for x in plan.collect()]
    assert len({x[:3] for x in out}) == len(out) == n and {x[3] for x in out} == set(range(5))
    size = {(s, b): t for s, b, t in blocks}
    total = sum(size[x[:2]] for x in out)
    for s, share, most in goals[:3]:
        drawn = sum(size[x[:2]] for x in out if x[0] == s)
        assert max(x[2] for x in out if x[0] == s) < most and sums[s] == (sum(t for q, _, t in blocks if q == s), drawn)
        assert abs(drawn / total - share / 0.82) < 0.01
        # a source misses its quota by half a block at most, so by this much of all
        assert abs(drawn - quotas({k: v[0] for k, v in sums.items()}, goals)[s]) <= 75
    assert planned(table.limit(0), goals, 3, 1)[2] == 0 and planned(table, [("z", 1.0, 1)], 3, 1)[2] == 0


def test_shards_of_a_huge_corpus_are_even(spark):
    # 800 billion tokens in 8 sources: 16,000 shards of 50 million, eight blocks each
    sized = spark.range(0, 160_000, 1, 8).selectExpr("id", "concat('s', least(7, id % 11)) as mix_source", "5000000L as tokens")
    goals = [(f"s{k}", 1 / 11 if k < 7 else 4 / 11, 1) for k in range(8)]
    blocked, shards = _blocks(sized, goals, "id", None, 1, None)
    assert shards == 16_000
    plan, sums, n = planned(blocked.groupBy("mix_source", "block").sum("tokens").withColumnRenamed("sum(tokens)", "tokens"), goals, shards, 1)
    got = plan.groupBy("shard").sum("tokens").toPandas()["sum(tokens)"]
    assert len(got) == shards and abs(sum(d for _, d in sums.values()) / 8e11 - 1) < 0.01
    # blocks hold about 1.6 texts here, as many as chance will; with thousands they are even
    assert plan.groupBy("shard").count().agg({"count": "max"}).first()[0] - plan.groupBy("shard").count().agg({"count": "min"}).first()[0] <= 8


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_mix(spark):
    rows = [(i, "word " * (3 + i % 5), " Big" if i % 2 else "BIG") for i in range(200)] + [(1000 + i, "a b c d", "small ") for i in range(10)] + [(2000, None, "big"), (2001, "x", None), (2002, "", "small"), (2003, "y", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as copy", "2 as tokens")
    targets = spark.createDataFrame([("big", 0.7, 1), ("Small", 0.2, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    texts, report = mix(docs, targets, shards=3)
    got = texts.collect()
    assert {r["source"] for r in got} == {"big", "small"}
    assert max(r["copy"] for r in got if r["source"] == "small") <= 3 and max(r["copy"] for r in got if r["source"] == "big") == 0
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    assert sorted((r["shard"], r["pos"]) for r in got) == sorted((s, p + 1) for s in range(3) for p in range(sum(r["shard"] == s for r in got)))
    shares = {r["source"]: r for r in report.collect()}
    assert shares["none"]["tokens"] == 0
    for s in ("big", "small"):
        assert shares[s]["tokens"] == sum(r["tokens"] for r in got if r["source"] == s)
        assert shares[s]["share"] <= 1
    empty, zero = mix(docs.limit(0), targets)
    assert empty.count() == 0 and {r["tokens"] for r in zero.collect()} == {0}
    assert report_of(docs, targets, shards=3).sort("source").collect() == report.sort("source").collect()
