import numpy as np
import pyarrow as pa

from interlock.functions.outline import pack, side_vectors
from interlock.llm import neighbours
from interlock.llm.neighbours import learn, nearest_sides
from tests.shapes import SIDES, piece


def table():
    rows = []
    for p in range(60):
        rows += piece(p, [4 * (p // 3) + k for k in range(4)], jitter=p % 3, turn=p % 4)
    for p in range(60, 90):  # exact copies, more than a list may hold
        rows += piece(p, [900, 901, 902, 903])
    rows += piece(95, [1, 2, 3, 4], edge=True) + piece(96, [1, 2, 3, 4])[:3] + rows[:10]
    return rows


def brute(rows):
    usable = {p for p in {r[0] for r in rows} if len({r[1] for r in rows if r[0] == p}) == 4}
    sides = {(r[0], r[1]): r[2] for r in rows if r[0] in usable and not r[4]}
    keys = sorted(sides)
    v = side_vectors(pack(pa.array([sides[k] for k in keys], pa.list_(pa.list_(pa.int32())))))
    out = set()
    for i, k in enumerate(keys):
        d = np.round(np.sqrt(((v - v[i]) ** 2).sum(axis=1)), 6)
        near = sorted((d[j], *keys[j]) for j in range(len(keys)) if keys[j][0] != k[0] and d[j] <= 0.06)
        out |= {(*k, p, s) for _, p, s in near[:5]}
    return out


def test_recall_against_brute_force(spark):
    rows = table()
    got = {tuple(r) for r in nearest_sides(spark.createDataFrame(rows, SIDES)).drop("distance").collect()}
    want = brute(rows)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_recall_holds_with_the_code_of_a_huge_collection(spark):
    rows = table()
    want = brute(rows)
    for size in (1 << 22, 1 << 28):  # 164 million sides, 30 GB, make 28 bits
        got = {tuple(r) for r in nearest_sides(spark.createDataFrame(rows, SIDES), size=size).drop("distance").collect()}
        assert len(got & want) >= 0.96 * len(want) and len(got - want) <= 0.02 * len(want)


def test_hot_buckets_in_cells_lose_nothing(spark, monkeypatch):
    rows = [x for p in range(40) for x in piece(p, [1, 2, 3, 4], jitter=1 + p % 4)]
    sides = spark.createDataFrame(rows, SIDES)
    plain = {tuple(r) for r in nearest_sides(sides).drop("distance").collect()}
    monkeypatch.setattr(neighbours, "HOT", 30)  # buckets are hot, cells are not
    assert {tuple(r) for r in nearest_sides(sides).drop("distance").collect()} == plain
    assert len(plain & brute(rows)) >= 0.98 * len(plain)


def test_hot_buckets_in_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HOT", 3)
    monkeypatch.setattr(neighbours, "BLOCK", 2)
    rows = [x for p in range(40) for x in piece(p, [1, 2, 3, 4], jitter=1)]
    got = {tuple(r) for r in nearest_sides(spark.createDataFrame(rows, SIDES)).drop("distance").collect()}
    want = brute(rows)
    assert len(got & want) >= 0.98 * len(want)


def test_empty(spark):
    assert nearest_sides(spark.createDataFrame([], SIDES)).count() == 0
    assert learn(np.zeros((0, 54)), 0).encode(np.zeros((1, 54)))[1].shape == (1, 3)


def test_a_longer_code_finds_as_much():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20_000, 54)) * 0.25 * 0.9 ** np.arange(54)
    step = rng.normal(size=v.shape)
    near = v + 0.03 * step / np.linalg.norm(step, axis=1, keepdims=True)
    for bits in (16, 19, 22, 26):
        coder = learn(v, 1 << bits)
        assert coder.bits == bits and (coder.encode(v)[0] == coder.encode(near)[0]).any(axis=1).mean() >= 0.99
