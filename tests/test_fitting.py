"""The numpy search for sides that fit, against every pair worked out plainly."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from interlock.operators import alike, fitting, match
from interlock.operators.alike import normal_forms, points_of
from interlock.operators.sides import distinct_sides, normalised
from tests.shapes import SIDES, outline, piece


def sides(seeds: list[int], scale: int = 1) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lines = pa.array([[[scale * c for c in p] for p in outline(s % 40, jitter=4, jitter_seed=s)][:: (-1) ** s] for s in seeds])
    arc, chord, v, vf = normal_forms(*points_of(lines), 26)
    nested = [pa.array(a.astype(int).tolist(), pa.list_(pa.list_(pa.int64()))) for a in (v, vf)]
    t = pa.table({"piece_id": seeds, "side": pa.array([0] * len(seeds), pa.int32()), "chord": chord, "arc": arc, "turn": pa.array([[]] * len(seeds), pa.list_(pa.int64())), "line": fitting.pack(*nested)})
    return t, v, vf, arc, chord


@pytest.mark.parametrize("scale", [1, 40, 3000])
def test_no_pair_is_lost(scale):
    """Coordinates of 16 bits, beyond the sums' cut, and beyond 16 bits."""
    t, v, vf, arc, chord = sides(list(range(150)), scale)
    want = {}
    for a in range(150):
        err = fitting.error(v[[a]], vf, arc, 5.0)
        near = (np.abs(1 - chord[a] / chord) <= 0.08) & (err <= 0.8) & (np.arange(150) != a)
        want |= {(a, int(b)): err[b] for b in np.flatnonzero(near)}
    x, low, high = fitting.Sides(t, 27, 2), fitting.Sides(t.slice(0, 70), 27, 2), fitting.Sides(t.slice(70), 27, 2)
    for parts in ([(x, x, True)], [(x, x, False)], [(low, low, True), (low, high, True), (high, high, True)]):
        if not parts[0][2]:  # directed: all asked, all sought
            parts = [(x, fitting.Sides(t, 27, 2), False)]
        rows = [r for one in parts for b in fitting.fitting(*one[:2], 0.8, 5.0, 0.08, one[2]) for r in b.to_pylist()]
        assert {(r["piece_id"], r["other_piece"]): r["err"] for r in rows} == want and len(rows) == len(want) > 20


def test_fits_meet_across_blocks(spark, monkeypatch):
    rows = [x for p in range(12) for x in piece(p + 1, [5 * (p % 6) + k for k in range(4)], jitter=2)]
    n = normalised(distinct_sides(spark.createDataFrame(rows, SIDES))).cache()
    some = n.where("piece_id > 8")
    asks = [{}, {"among": some}, {"among": some, "flip": False, "turn": "piece_id"}]
    whole = [sorted(map(tuple, match.fit_errors(n, 3.5, **a).collect())) for a in asks]
    monkeypatch.setattr(match, "SIDES", 20)
    assert [sorted(map(tuple, match.fit_errors(n, 3.5, **a).collect())) for a in asks] == whole and all(whole)
    assert {r[0] for r in whole[1]} <= {9, 10, 11, 12} and all(r[0] > r[2] for r in whole[2])


def test_leaves_lose_no_alike_piece():
    """Pieces alike under some rotation are all found, and few others are held against each other."""
    r = np.random.default_rng(5)
    kinds = np.cumsum(r.normal(0, 0.05, (150, 4, 50)), axis=2)
    rows = np.concatenate([np.roll(kinds[k % 150], k // 150, axis=0)[None] + r.normal(0, 0.004 * (k % 4), (1, 4, 50)) for k in range(600)])
    edge = np.zeros((600, 4), bool)
    edge[::5, 0] = True
    t = pa.table({"piece_id": r.permutation(600), "is_edge": edge.tolist(), "chord": np.full((600, 4), 100.0).tolist(), "profile": rows.tolist()})
    p = alike.Pieces(t)
    want = {}
    for i in range(600):
        for j in range(600):
            if p.id[i] < p.id[j]:
                for rot in range(4):
                    other = (np.arange(4) + rot) % 4
                    used = ~(edge[i] & edge[j][other])
                    err = np.sqrt(((rows[i] - rows[j][other]) ** 2).mean(axis=1))[used]
                    if err.max() <= 0.025:
                        want[int(p.id[i]), int(p.id[j])] = min(want.get((int(p.id[i]), int(p.id[j])), (9.0, 0)), (float(err.sum()), rot))
    got = alike.alike(p, None, [(0.025, 0.85)])
    assert {(a, b): rot for a, b, rot in zip(got["a"].tolist(), got["b"].tolist(), got["rot"].tolist())} == {k: rot for k, (_, rot) in want.items()} and len(want) > 300
    halves = [alike.Pieces(t.slice(0, 300)), alike.Pieces(t.slice(300))]
    parts = [alike.alike(halves[0], None, [(0.025, 0.85)]), alike.alike(halves[1], None, [(0.025, 0.85)]), alike.alike(*halves, [(0.025, 0.85)])]
    assert {(a, b) for g in parts for a, b in zip(g["a"].tolist(), g["b"].tolist())} == set(want)


def test_a_leaf_leaves_out_what_is_far():
    x = np.repeat(np.linspace(0, 50, 4000), 4).reshape(4000, 4, 1).repeat(6, axis=2).astype(np.float32)
    sides = alike.leaves(x.reshape(4000, -1), 64)
    assert sorted(np.concatenate(sides)) == list(range(4000)) and max(np.ptp(x[s, 0, 0]) for s in sides) < 1
    pairs = [p for r, c in alike._near(x, x, 0.025, 50, True) for p in zip(r.tolist(), c.tolist())]
    assert len(pairs) == len(set(pairs)) and {(k, k + 1) for k in range(3999)} <= set(pairs) and len(pairs) < 4000 * 40


def test_most_sides_find_a_fit_among_neighbours():
    """``some`` names only sides that have a fit, and most of these."""
    t, *_ = sides(list(range(1500)))
    x = fitting.Sides(t, 27, 2)
    want = {r["piece_id"] for b in fitting.fitting(x, x, 0.8, 5.0, 0.08, True) for r in b.to_pylist()}
    got = set(x.id[fitting.some(x, 0.8, 5.0, 0.08)].tolist())
    assert got <= want and len(got) > 0.9 * len(want) > 500


def test_sides_without_fit_are_the_orphans(spark, monkeypatch):
    """Only sides that no neighbour settles are held against all; the answer is that of all fits, copies, edges and closed sides included."""
    rows = [(*r[:2], r[2][:: (-1) ** p], *r[3:]) for p in range(60) for r in piece(p + 1, [5 * (p // 2 % 6) + k for k in range(4)], jitter=2, edge=p % 10 == 9)]
    rows += [x for p in range(60, 66) for x in piece(p + 1, [900 + 4 * p + k for k in range(4)])]
    rows = [(*r[:2], [r[2][0], [200, 300], r[2][0]], *r[3:]) if r[:2] == (61, 0) else r for r in rows] + rows[:40]
    table = spark.createDataFrame(rows, SIDES)
    n = normalised(distinct_sides(table))
    want = sorted(map(tuple, match.orphans(n, match.fit_errors(n, 0.8)).collect()))
    lines = match.normal_lines(table).cache()
    same = sorted(map(tuple, match.fit_errors(n, 0.8).collect()))
    assert sorted(map(tuple, match.line_errors(lines, 0.8).collect())) == same and same
    asked, whole = [], match.line_errors
    monkeypatch.setattr(match, "line_errors", lambda lines, error_max, conf, among: asked.append(among.count()) or whole(lines, error_max, conf, among))
    got = sorted(map(tuple, match.without_fit(lines, 0.8).collect()))
    assert got == want and (61, 0) in got and 4 < len(got) < 100
    assert asked[0] < lines.count() / 2


def test_two_sets_meet_once_for_both_directions(spark):
    """The fits of new sides and stored ones, in either direction, from one look at each pair."""
    rows = [(*r[:2], r[2][:: (-1) ** p], *r[3:]) for p in range(20) for r in piece(p + 1, [5 * (p // 2 % 6) + k for k in range(4)], jitter=2)]
    n = normalised(distinct_sides(spark.createDataFrame(rows, SIDES))).cache()
    fresh, stored = n.where("piece_id > 13"), n.where("piece_id <= 13")
    apart = match.fit_errors(stored, 0.8, among=fresh).unionByName(match.fit_errors(fresh, 0.8, among=stored))
    once = match.line_errors(match.lines_of(stored), 0.8, among=match.lines_of(fresh), both=True)
    want = sorted(map(tuple, apart.collect()))
    assert sorted(map(tuple, once.collect())) == want and {r[0] > 13 for r in want} == {True, False}


def test_boxes_lose_no_pair(monkeypatch):
    """With a small limit, sides are held only against what is near a box around neighbours; what is found stays the same."""
    t, *_ = sides(list(range(600)))
    x, y = fitting.Sides(t, 27, 2), fitting.Sides(t, 27, 2)
    found = lambda: {(r["piece_id"], r["other_piece"]): r["err"] for b in fitting.fitting(x, y, 0.6, 5.0, 0.08, False) for r in b.to_pylist()}
    met = []
    close = fitting._close
    monkeypatch.setattr(fitting, "_close", lambda f, g, ty, rows, cols: met.append(len(rows) * len(cols)) or close(f, g, ty, rows, cols))
    monkeypatch.setattr(fitting, "BOX", 8)
    monkeypatch.setattr(fitting, "SMALL", 0)
    boxed = found()
    assert 0 < sum(met) < 600 * 600 * 0.9
    monkeypatch.setattr(fitting, "SMALL", float("inf"))
    assert found() == boxed and len(boxed) > 20


def test_hits_unfold_only_true_cells():
    mask = np.random.default_rng(3).random((64, 4096)) < 0.02
    mask[5], mask[6] = True, False
    assert all((a == b).all() for a, b in zip(alike.hits(mask), np.nonzero(mask)))
    tracemalloc.start()
    alike.hits(mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * np.count_nonzero(mask.reshape(-1, 8).any(axis=1)) + 32 * mask.sum()


def test_pairs_of_blocks_are_dealt_out_evenly(spark, monkeypatch):
    """No task holds many pairs of blocks against each other while others have none."""
    rows = [(*r[:2], r[2][:: (-1) ** p], *r[3:]) for p in range(60) for r in piece(p + 1, [5 * (p // 2 % 6) + k for k in range(4)], jitter=2)]
    lines = match.normal_lines(spark.createDataFrame(rows, SIDES)).cache()
    whole = sorted(map(tuple, match.line_errors(lines, 0.8).collect()))
    monkeypatch.setattr(match, "SIDES", 30)  # 8 blocks, 36 pairs
    fits = match.line_errors(lines, 0.8)
    assert sorted(map(tuple, fits.collect())) == whole and whole
    tasks = fits.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 18


@pytest.mark.parametrize("lines", [1, 2])
def test_packed_lines_come_back_in_few_bytes(lines):
    """Steps of 8 bits where they fit, whatever the other rows need; nothing changes on the way."""
    r = np.random.default_rng(9)
    near = np.cumsum(r.integers(-60, 60, (40, lines, 27, 2)), axis=2)
    if lines == 2:
        near[:, 1] = [560, 0] - near[:, 0, ::-1]
    mixed = near * np.array([1, 9, 3000, 10**8, 10**12])[np.arange(40) % 5][:, None, None, None]
    for given in (near, mixed, near[:0]):
        packed = fitting.pack_numbers(*[given[:, k] for k in range(lines)])
        for part in (packed, packed.slice(3, 20)):
            want = given if part is packed else given[3:23]
            assert all((a == want[:, k]).all() for k, a in enumerate(fitting.unpack(part, lines, 27)))
    assert fitting.pack_numbers(*[near[:, k] for k in range(lines)]).nbytes <= 40 * (lines * 60 + 4) + 4


def test_like_chords_leave_the_sums_to_choose_neighbours():
    """Chords that differ by rounding only were weighed up until they swamped the sums, and neighbours were any sides: an eighth of those with a fit were not found."""
    t, *_ = sides(list(range(7000, 8500)))
    x = fitting.Sides(t, 27, 2)
    assert np.ptp(x.chord) < 1e-6
    want = {r["piece_id"] for b in fitting.fitting(x, x, 0.8, 5.0, 0.08, True) for r in b.to_pylist()}
    got = set(x.id[fitting.some(x, 0.8, 5.0, 0.08)].tolist())
    assert got <= want and len(got) > 0.97 * len(want) > 500


def test_fits_across_neighbourhoods_settle_a_side_too(spark, monkeypatch):
    """In blocks of fifty sides by a key that says nothing many sides find no fit; they are held against all, and no orphans if one fits there."""
    t, *_ = sides(list(range(300)))
    x, r = fitting.Sides(t, 27, 2), np.random.default_rng(3)
    fit = {row["piece_id"] for b in fitting.fitting(x, x, 0.8, 5.0, 0.08, True) for row in b.to_pylist()}
    rows = [(*row.values(), *r.random(2).tolist()) for row in t.to_pylist()]
    lines = spark.createDataFrame(rows, f"{match.LINE}, area double, lean double").cache()
    monkeypatch.setattr(match, "SIDES", 50)
    asked, whole = [], match.line_errors
    monkeypatch.setattr(match, "line_errors", lambda lines, error_max, conf, among: asked.append(among.count()) or whole(lines, error_max, conf, among))
    got = {row["piece_id"] for row in match.without_fit(lines, 0.8).collect()}
    assert got == set(range(300)) - fit and asked[0] > len(got) > 20
