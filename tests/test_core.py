import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from interlock.conf import Conf
from interlock.functions import geom
from interlock.functions.outline import pack, side_vectors, unpack
from interlock.operators import dedup, match, stats
from interlock.operators.compact import checksum, compact, newest_file, side_records
from interlock.operators import nearby
from interlock.operators.nearby import containing_regions, near_pairs
from interlock.operators.pieces import current_values, usable_ids, usable_pieces
from interlock.operators.sides import distinct_sides, normalised, piece_rows, signatures
from interlock.pipeline import Marker, Pipeline, attempted, retry
from interlock.sources import files
from interlock.streaming.identify import Store, identified, repeating
from tests.shapes import SIDES, outline, piece


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def pt(x, y):
    return F.array(F.lit(float(x)), F.lit(float(y)))


def test_geometry_by_hand(spark):
    square = F.array(pt(0, 0), pt(10, 0), pt(10, 10), pt(0, 10))
    r = one(
        spark, geom.distance(pt(0, 0), pt(3, 4)), geom.distance_to_line(pt(5, 7), pt(0, 0), pt(10, 0)), geom.distance_to_segment(pt(13, 4), pt(0, 0), pt(10, 0)), geom.centroid(square), geom.inside(pt(5, 5), square), geom.inside(pt(15, 5), square), geom.inside(pt(10, 5), square),
        geom.crossing(pt(0, 0), pt(10, 10), pt(0, 10), pt(10, 0)), geom.crossing(pt(0, 0), pt(1, 0), pt(0, 1), pt(1, 1)), geom.polyline_length(square), geom.angle_gap(F.lit(0.1), F.lit(2 * math.pi - 0.1)), geom.mean_angle_positive(F.array(F.lit(0.1), F.lit(-0.3))),
        geom.rotated_point(pt(10, 0), pt(0, 0), F.lit(math.pi / 2)), geom.nearest_on_polyline(pt(5, 2), square)["segment"], geom.resample(F.array(pt(0, 0), pt(4, 0), pt(4, 4)), 4), geom.angle_at(pt(1, 0), pt(0, 0), pt(0, 1)), geom.angle_at(pt(1, 0), pt(1, 0), pt(0, 1)), geom.middle_vertex(square, pt(0, 0), pt(10, 0)),
        geom.whole(F.lit(2.5)), geom.distance_between_lines(pt(0, 0), pt(1, 0), pt(0, 3), pt(1, 3)), geom.midpoint(pt(0, 0), pt(4, 2)), geom.mean_point(square), geom.trend(F.array(pt(0, 0), pt(0, -1))), geom.stretched(F.array(pt(2, 3)), F.lit(2.0)), geom.mirrored(F.array(pt(2, 3))), geom.ray_end(F.lit(0.0), pt(1, 1), F.lit(4.0)),
    )
    assert r[0] == 5 and r[1] == 7 and r[2] == 5 and r[3] == [5, 5] and (r[4], r[5], r[6]) == (True, False, True)
    assert r[7] == [5, 5] and r[8] is None and r[9] == 30 and math.isclose(r[10], 0.2, abs_tol=1e-9) and math.isclose(r[11], 2 * math.pi - 0.1, abs_tol=1e-9)
    assert r[12] == [0, 10] and r[13] == 0 and [list(p) for p in r[14]] == [[0, 0], [2, 0], [4, 0], [4, 2], [4, 4]]
    assert math.isclose(r[15], 3 * math.pi / 2) and r[16] is None and list(r[17]) in ([10, 0], [0, 0]) and r[18] == 2 and r[19] == 3
    assert list(r[20]) == [2, 1] and list(r[21]) == [5, 5] and math.isclose(r[22], 1.5 * math.pi) and list(r[23][0]) == [4, 3] and list(r[24][0]) == [2, -3] and r[25] == [5, 1]


def test_lists(spark):
    a = F.array(*[F.lit(v) for v in (1, 2, 3, 4, 5)])
    r = one(spark, geom.cyclic_slice(a, F.lit(3), F.lit(1)), geom.cyclic_slice(a, F.lit(0), F.lit(4), 2), geom.rotated_list(a, F.lit(2)), geom.smallest_rotation(F.array(*[F.lit(c) for c in "TBFB"])), geom.contains_cyclic(a, F.array(F.lit(5), F.lit(1))), geom.contains_cyclic(a, F.array(F.lit(1), F.lit(3))))
    assert r[0] == [4, 5, 1, 2] and r[1] == [1, 3, 5] and r[2] == [3, 4, 5, 1, 2] and r[3] == ["B", "F", "B", "T"] and r[4] and not r[5]


def test_curves(spark):
    circle = F.array(*[pt(100 * math.cos(t / 10), 100 * math.sin(t / 10)) for t in range(24)])
    corner = F.array(*[pt(10 * i, 0) for i in range(12)], *[pt(110, 10 * i) for i in range(1, 12)])
    r = one(spark, geom.curve_score(circle), geom.curve_score(corner), geom.colinearity(F.array(pt(0, 0), pt(1, 1), pt(2, 2)), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))["mean"], geom.offset_spread(F.array(pt(0, 0), pt(5, 0), pt(9, 0))))
    assert r[0] > 0.9 and r[1] < 0.3 and math.isclose(r[2], math.pi / 4) and r[3] == 0


def test_outlines_survive_packing():
    import pyarrow as pa

    rows = [[[0, 0], [1, 2], [300, 5]], [[5, 5], [70_000, 5]], [[1, 1]], None, [[1, None], [2, 2]], [[9, 9], [8, 7]], [[0, 0], [5_000_000_000, 1]]]
    packed = pack(pa.array(rows, pa.list_(pa.list_(pa.int64()))))
    assert [p is None for p in packed] == [False, False, True, True, True, False, False]
    xy, off = unpack([p for p in packed if p])
    assert xy[: off[1]].tolist() == [[0, 0], [1, 2], [300, 5]] and xy[off[1] : off[2]].tolist() == [[0, 0], [69_995, 0]]
    v = side_vectors([p for p in packed if p])
    assert np.allclose(v[:, :2], 0) and np.allclose(v[:, -2:], [1, 0])
    assert side_vectors([]).shape == (0, 54)


def test_usable_and_current(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    rows = piece(1, [1, 2, 3, 4]) + piece(2, [1, 2, 3, 4])[:3] + piece(3, [1, 2, 3, 4], center=None) + piece(1, [1, 2, 3, 4])[:2]
    rows.append((1, 0, outline(1), [1, 1], False, "a.jpg", None, 777, None, 1, t(9)))
    rows.append((None, 0, outline(1), [1, 1], False, "a.jpg", None, 5, None, 1, t(9)))
    df = spark.createDataFrame(rows, SIDES)
    assert [r[0] for r in usable_ids(df).collect()] == [1]
    assert [r["piece_id"] for r in usable_pieces(df).collect()] == [1]
    c = {r["piece_id"]: r for r in current_values(df, ["photo_width", "photo_height", "photo_space_centroid"]).collect()}
    assert c[1]["photo_width"] == 777 and c[1]["photo_height"] == 100 and c[1]["photo_space_centroid"] == [10.0, 10.0]
    assert usable_pieces(df.limit(0)).count() == 0


def test_near_pairs_equal_brute_force(spark):
    r = np.random.default_rng(3)
    pts = [(i, int(i % 3) if i % 10 else None, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-3000, 3000, (700, 2)))]
    pts += [(1000 + i, 0, 50.0, 50.0) for i in range(40)] + [(2000, 0, None, 1.0), (None, 0, 1.0, 1.0), (2001, 1, float("nan"), 2.0), (2002, 2, 1e4, 1e4), (2003, 2, 1e4 + 100, 1e4)]
    df = spark.createDataFrame(pts, "piece_id long, batch long, x double, y double").selectExpr("*", "1 as tile", "2 as id")
    for d in (100.0, 330.0):
        ok = [p for p in pts if None not in p and not math.isnan(p[2])]
        want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] == b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) < d}
        got = [tuple(x) for x in near_pairs(df, d, by=["batch"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert near_pairs(df.limit(0), 10.0, by=["batch"]).count() == 0 and near_pairs(df, 0.0, by=["batch"]).count() == 0


def test_hot_tiles_are_split(spark, monkeypatch):
    monkeypatch.setattr(nearby, "HOT", 20)
    r = np.random.default_rng(4)
    pts = [(i, 1, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 900, (150, 2)))] + [(500 + i, 1, 5.0, 5.0) for i in range(45)]
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) < 60}
    got = [tuple(x) for x in near_pairs(spark.createDataFrame(pts, "piece_id long, batch long, x double, y double"), 60.0, by=["batch"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_regions_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    pts = [(i, int(i % 2), float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-500, 500, (400, 2)))]
    pts += [(1000 + i, 0, 10.0, 10.0) for i in range(30)] + [(None, 0, 1.0, 1.0), (2000, 0, None, 1.0), (2001, None, 0.0, 0.0), (2002, 0, 400.0, 0.0)]
    rings = [(k, int(k % 2), (c + r.uniform(20, 200) * np.array([[np.cos(a), np.sin(a)] for a in np.sort(r.uniform(0, 6.28, 7))])).tolist()) for k, c in enumerate(r.uniform(-500, 500, (40, 2)))]
    rings += [(100, 0, [[-600.0, -600.0], [600.0, -600.0], [600.0, 600.0], [-600.0, 600.0]]), (101, 0, [[0.0, 0.0], [1.0, 1.0]]), (102, 0, None), (None, 0, [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0]]), (103, 0, [[400.0, -5.0], [410.0, -5.0], [410.0, 5.0], [400.0, 5.0]])]
    want = {(p[0], k) for p in pts for k, g, ring in rings if None not in p and k is not None and ring and len(ring) > 2 and p[1] == g and nearby.within(np.array([p[2:]]), np.array(ring))[0]}
    points = spark.createDataFrame(pts, "piece_id long, batch long, x double, y double").selectExpr("*", "1 as strip", "2 as spot")
    regions = spark.createDataFrame(rings, "region_id long, batch long, ring array<array<double>>")
    assert (2002, 103) in want and (1000, 100) in want
    for hot in (50_000, 25):
        monkeypatch.setattr(nearby, "HOT", hot)
        got = [tuple(x) for x in containing_regions(points, regions, by=["batch"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert containing_regions(points.limit(0), regions, by=["batch"]).count() == 0 and containing_regions(points, regions.limit(0), by=["batch"]).count() == 0


def test_compaction(spark, tmp_path):
    rec = lambda p, s, **kw: json.dumps({"piece_id": p, "side_index": s, "vertices": [[1, 2], [3, 4]], "is_edge": False, **kw})
    t = lambda d: dt.datetime(2026, 1, d)
    rows = [
        ("a", rec(1, 0), t(1)), ("b", rec(1, 0, photo_width="x"), t(2)), ("c", rec(1, 0), t(2)), ("d", rec(2, 1) + "\n" + rec(2, 2)[:30] + "\n" + rec(2, 3) + "\n", t(1)), ("e", json.dumps(json.loads(rec(3, 0)), indent=1), t(1)), ("f", rec(4, 0)[:-9], t(1)),
        ("g", rec(5, 0, is_edge="no"), t(1)), ("h", rec("6", 0), t(1)), ("i", rec(7.0, 0), t(1)), ("j", rec(8, 0, vertices=[[1, 2]]), t(1)), ("k", None, t(1)), ("l", " \n", t(1)), ("m", "[]", t(1)), ("n", "null", None), ("o", rec(9, 1), None),
    ]
    df = spark.createDataFrame(rows, "file_path string, payload string, modified_at timestamp_ntz")
    records = side_records(df)
    assert sorted((r["file_path"], r["piece_id"], r["side_index"]) for r in records.collect()) == [("a", 1, 0), ("b", 1, 0), ("c", 1, 0), ("d", 2, 1), ("d", 2, 3), ("e", 3, 0), ("o", 9, 1)]
    out = compact(records, f"file://{tmp_path}/x/out")
    assert checksum(out) == checksum(records) and {tuple(r) for r in newest_file(out).collect()} == {(1, 0, "b"), (2, 1, "d"), (2, 3, "d"), (3, 0, "e"), (9, 1, "o")}
    assert len(list((tmp_path / "x/out").glob("*.parquet"))) <= 2
    with pytest.raises(FileExistsError):
        compact(records, f"file://{tmp_path}/x/out")
    assert compact(records.limit(0), f"file://{tmp_path}/empty").count() == 0


def test_records_in_any_layout(spark):
    one = '{"piece_id":%d,"side_index":0,"vertices":[[1,2],[3,4]],"is_edge":false'
    pretty = lambda p: json.dumps({**json.loads(one % p + "}"), "note": "a { brace", "more": {"k": [1, {"z": 2}]}}, indent=1)
    texts = {
        "inner line": one % 1 + ',\n"robot_state":\n{"a":1}\n}',
        "inner list": one % 2 + ',"extra":[\n{"k":1}\n],"z":1}',
        "two pretty": pretty(3) + "\n" + pretty(4),
        "pretty, line": pretty(5) + "\n" + one % 6 + "}",
        "line, cut off, pretty": one % 7 + "}\n" + one % 8 + ',\n"more": {\n' + pretty(9),
        "cut off pretty": pretty(10)[:-20],
        "trailing": one % 11 + "} x",
        "windows": one % 12 + "}\r\n" + one % 13 + "}\r\n",
        "long": "\n".join([one % 14] * 3000 + [one % 15 + "}"]),
        "inner braces only": "{\n{\n}\n}",
    }
    df = spark.createDataFrame([(k, v, None) for k, v in texts.items()], "file_path string, payload string, modified_at timestamp_ntz")
    got = {(r["file_path"], r["piece_id"]) for r in side_records(df).collect()}
    assert got == {
        ("inner line", 1), ("inner list", 2), ("two pretty", 3), ("two pretty", 4), ("pretty, line", 5), ("pretty, line", 6), ("line, cut off, pretty", 7), ("line, cut off, pretty", 9), ("windows", 12), ("windows", 13), ("long", 15),
    }
    assert side_records(df).count() == len(got)


def test_compacted_files_have_the_wanted_size(spark, tmp_path):
    df = spark.range(0, 400_000, 1, 16).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"), F.lit("the same in every row").alias("c"))
    for target in (1 << 20, 4 << 20):
        out = compact(df, f"file://{tmp_path}/{target}", target)
        sizes = [f.stat().st_size for f in (tmp_path / str(target)).glob("*.parquet")]
        assert len(sizes) > 2 and all(0.5 * target <= s <= 1.5 * target for s in sorted(sizes)[1:]) and checksum(out) == checksum(df)
    compact(df, f"file://{tmp_path}/one", 1 << 30)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1


def numpy_error(a, b, length):
    a, b = np.array(a, float), np.array(b, float)
    d = np.abs(a - b)
    e = (d - a + b).mean(axis=0)
    e[1] = np.clip(e[1], -5, 5)
    return min(d.sum(), np.abs(a - e - b).sum()) / length


def test_bucketed_fits_equal_the_plain_join(spark):
    rows = [x for p in range(9) for x in piece(p, [5 * p + k for k in range(4)])] + piece(50, [0, 1, 2, 3], edge=True)
    for r in piece(60, [0, 1, 2, 3]):  # what piece 0 looks like from its neighbours
        rows.append((*r[:2], r[2][::-1], *r[3:]))
    n = normalised(distinct_sides(spark.createDataFrame(rows, SIDES))).cache()
    s = [r for r in n.collect() if not r["is_edge"]]
    for limit in (0.5, 3.5):
        want = {(a["piece_id"], a["side_index"], b["piece_id"], b["side_index"]): numpy_error(a["v"], b["vf"], b["arc_len"]) for a in s for b in s if a["piece_id"] != b["piece_id"] and abs(1 - a["chord_len"] / b["chord_len"]) <= 0.08}
        want = {k: e for k, e in want.items() if e <= limit}
        got = {tuple(r)[:4]: r["err"] for r in match.fit_errors(n, limit).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    fits = match.fit_errors(n, 3.5)
    assert match.keep_best(fits, 1.0).groupBy("piece_id", "side").count().where("count > 1").count() == 0
    assert match.orphans(n, fits.where("piece_id <> 1")).where("piece_id = 1").count() == 4
    assert all(len(json.loads(r["fits_json"])) == 4 for r in match.connectivity(fits).collect())


def test_signatures_and_rotations(spark):
    rows = piece(1, [1, 2, 3, 4]) + piece(2, [1, 2, 3, 4], turn=3, jitter=1) + piece(3, [11, 12, 13, 14])
    d = distinct_sides(spark.createDataFrame(rows, SIDES))
    sig = {r["piece_id"]: (r["n_flat"], r["types"]) for r in signatures(d).collect()}
    assert sig[1] == sig[2]
    found = match.cascade(piece_rows(d)).collect()
    assert [(r["a"], r["b"], r["rot"], r["n_matching"], r["stage"]) for r in found] == [(1, 2, 1, 4, 1)]


def test_pieces_alike_meet_across_blocks(spark, monkeypatch):
    """Blocks of a few pieces find what one block finds; a copy turned by one side, and one seen from the larger id, among them."""
    rows = [r for k in range(24) for r in piece(k + 1, [10 * (k % 8) + j for j in range(4)], turn=k // 8, jitter=k % 3)]
    p = piece_rows(spark.createDataFrame(rows, SIDES))
    whole = sorted(map(tuple, match.cascade(p).collect()))
    monkeypatch.setattr(match, "PIECES", 3)
    assert sorted(map(tuple, match.cascade(p).collect())) == whole and len(whole) >= 24
    strict = sorted((r["a"], r["b"], r["rot"]) for r in match.same_shape(p, 0.025, 0.85).collect())
    assert strict == sorted((r[0], r[1], r[2]) for r in whole if r[5] == 1) and {r[2] for r in strict} >= {2, 3}


def test_groups_best_and_fusion(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    g = {r["id"]: r["group_id"] for r in dedup.linked_groups(pairs).collect()}
    assert set(g.values()) == {0, 100} and len(g) == 43
    m = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 3, None)], "group_id long, id long, s double")
    assert {(r["group_id"], r["id"]) for r in dedup.best_of_group(m, F.col("s")).collect()} == {(1, 1), (2, 3)}
    v = spark.createDataFrame([(1, [0.0, 2.0]), (1, [2.0, 2.0])], "g long, v array<double>")
    assert [tuple(r) for r in dedup.fused(v, "g", "v").collect()] == [(1, [1.0, 2.0], 1.0)]
    codes = spark.createDataFrame([(1, 0), (2, 7), (3, -1), (4, None)], "id long, c long")
    for below in (4, 20):
        assert {tuple(r) for r in match.hamming_pairs(codes, "id", "c", below).collect()} == {(1, 2, 3)}
    near = spark.createDataFrame([(1, 9, 1.0), (1, 8, 2.0), (2, 9, 0.5), (2, 8, 3.0)], "a long, b long, d double")
    assert [(r["a"], r["b"]) for r in match.mutual_nearest(near, "a", "b", "d").collect()] == [(2, 9)]


def test_scores(spark):
    h = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, match.histogram_likeness([h(1, 2, 3)], [h(2, 4, 6)]), match.histogram_likeness([h(1, 1)], [h(1, 1)]), match.continuity(h(1, 2), h(1, 2)), match.continuity(F.lit(None).cast("array<double>"), h(1.0)), match.combined_score(F.lit(0.0), F.lit(1.0)), match.combined_score(F.lit(20.0), F.lit(0.0), F.lit(0.0)))
    assert math.isclose(r[0], 1) and r[1] == 0 and r[2] == 1 and r[3] == 1 and r[4] == 1 and r[5] == 0


def test_grid_sizes(spark):
    c = spark.createDataFrame([(12, 10), (100, 36), (7, 3)], "n long, e long")
    assert {r["n"]: (r["width"], r["height"]) for r in stats.grid_by_count(spark, c.select("n"), "n").collect()}[12] == (4, 4)
    g = {r["n"]: (r["width"], r["height"]) for r in stats.grid_by_edges(spark, c, "n", "e").collect()}
    assert g[12] == (4, 3) and g[100] == (10, 10) and g[7] == (4, 2)


def test_settings(tmp_path):
    assert Conf().errors() == [] and len(Conf(block_size=4, length_gap_max=2).errors()) == 2
    f = str(tmp_path / "c.json")
    Conf(fit_error_max=2.0).save(f)
    assert Conf().with_file(f).fit_error_max == 2.0
    with pytest.raises(ValueError):
        Conf().with_values({"nope": 1})
    assert Conf().tuned(4000, 3000).block_size == Conf().tuned(4000, 3000).block_size == 103


def test_pipeline_helpers(spark, tmp_path):
    calls = []

    @retry(times=3, delay=0)
    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return 7

    assert shaky() == 7 and attempted(lambda: 1 / 0, default=5)[0] == 5
    m = Marker(spark, f"file://{tmp_path}")
    assert m.load() == (0, None)
    m.save(3, {"a": 1})
    assert m.is_done(2) and not m.is_done(4)
    m.clear()
    ran = []
    stages = [("one", lambda t: (ran.append(1), spark.range(3))[1]), ("two", lambda t: (ran.append(2), t["one"].where("id > 0"))[1])]
    p = Pipeline(spark, f"file://{tmp_path}/run", stages)
    assert p.run()["two"].count() == 2 and p.run()["two"].count() == 2 and ran == [1, 2]
    p.run(start_at="two")
    assert ran == [1, 2, 2] and set(p.run(stop_before="two")) == {"one"}


def test_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"side_5_{k}.json").write_text(json.dumps({"vertices": [[0, 0], [5, k]], "piece_center": [1, 1], "is_edge": k == 0}))
    (tmp_path / "batch.json").write_text(json.dumps({"photos": [{"file_name": "a.jpg", "position": [1, 2.5]}]}))
    (tmp_path / "connectivity.json").write_text(json.dumps({"5": [[[6, 1, 250]], [], [], []]}))
    (tmp_path / "color_features_5.json").write_text(json.dumps({"center_color": [1, 2, 3], "overall_histogram": {"h": [1], "s": [2], "v": [3]}}))
    s = files.read_sides(spark, str(tmp_path))
    assert {(r["piece_id"], r["side_index"], r["photo_width"], r["is_complete"]) for r in s.collect()} == {(5, k, 500, True) for k in range(4)}
    whole = files.whole_pieces(s)
    assert whole.count() == 1 and files.piece_svg(whole).first()["svg"].count("polyline") == 4
    assert files.read_photo_list(spark, str(tmp_path / "batch.json")).first()["position"] == [1.0, 2.5]
    f = files.read_connectivity(spark, str(tmp_path / "connectivity.json"))
    assert [tuple(r) for r in f.collect()] == [(5, 0, 6, 1, 0.25)]
    assert json.loads(files.connectivity_lines(f).first()["value"]) == {"5": [[[6, 1, 250]], [], [], []]}
    assert files.read_colors(spark, str(tmp_path)).first()["piece_id"] == 5
    cards = spark.createDataFrame([(1, "corner", "a"), (2, "corner", None)], "piece_id long, class string, photo string")
    assert files.catalog_html(cards).first()["html"].count("card") == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = piece(1, [1, 2, 3, 4]) + piece(2, [1, 2, 3, 4], jitter=1) + piece(3, [31, 32, 33, 34])
    n = normalised(distinct_sides(spark.createDataFrame(rows, SIDES))).drop("vertices", "piece_center")
    src = f"{tmp_path}/in"
    n.where("piece_id = 1").coalesce(1).write.mode("append").parquet(src)
    store = Store(spark, f"file://{tmp_path}/store", error_max=0.2)
    run = lambda: store.start(spark.readStream.schema(n.schema).parquet(src), f"{tmp_path}/ckpt").awaitTermination()
    run()
    n.where("piece_id <> 1").coalesce(1).write.mode("append").parquet(src)
    run()
    got = {r["piece_id"]: (r["status"], r["known_id"]) for r in store.table("results").collect()}
    assert got == {1: ("new_unsolved", None), 2: ("known", 1), 3: ("new_unsolved", None)}
    batch = {r["piece_id"]: (r["status"], r["known_id"]) for r in identified(n.where("piece_id <> 1"), n.where("piece_id = 1"), 0.2).collect()}
    assert batch == {k: got[k] for k in (2, 3)}
    assert store.next_id() == 4 and store.completeness(5) == (3, False) and store.remove(1).select("piece_id").distinct().count() == 1


def test_batches_of_any_size_identify_alike(spark, tmp_path):
    shapes = {5: 0, 1: 0, 4: 0, 2: 50, 7: 50, 3: 90}  # piece: first outline
    rows = [r for p, k in shapes.items() for r in piece(p, [k + i for i in range(4)], jitter=p % 3)]
    turn = {5: 1, 1: 2, 4: 2, 2: 3, 7: 3, 3: 4}  # batches against the order of ids
    n = normalised(distinct_sides(spark.createDataFrame(rows, SIDES))).drop("vertices", "piece_center", "batch_id")
    n = n.join(spark.createDataFrame(list(turn.items()), "piece_id long, batch_id long"), "piece_id").cache()
    got = []
    for cut in ([[5, 1, 4, 2, 7, 3]], [[5, 1], [4, 2, 7, 3]], [[p] for p in turn]):
        store = Store(spark, f"file://{tmp_path}/{len(cut)}", error_max=0.2, fit_max=0.5)
        for k, ids in enumerate(cut):
            store.ingest(n.where(F.col("piece_id").isin(ids)), k)
        got.append({r["piece_id"]: (r["status"], r["known_id"], round(r["confidence"], 9)) for r in store.table("results").collect()})
        assert {r["piece_id"] for r in store.table("sides").collect()} == {5, 2, 3}
    assert got[0] == got[1] == got[2] and {p: v[:2] for p, v in got[0].items()} == {5: ("new_unsolved", None), 1: ("known", 5), 4: ("known", 5), 2: ("new_unsolved", None), 7: ("known", 2), 3: ("new_unsolved", None)}


def test_who_repeats_a_repeat_only_is_new(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 3), (5, 4)], "piece_id long, other_piece long")
    assert sorted(r[0] for r in repeating(links).collect()) == [2, 4, 5]


def test_grid_sizes_of_any_number(spark):
    def plain(n):
        return min((round(w - h + 0.1 * (w * h - n), 6), w, h) for h in range(1, math.isqrt(n) + 3) for w in [max(h, -(-n // h))])[1:]

    counts = [1, 2, 12, 553, 642, 39_999, 40_000, 40_001, 50_000, 1_000_003]
    got = {r["n"]: (r["width"], r["height"]) for r in stats.grid_by_count(spark, spark.createDataFrame([(n,) for n in counts], "n long"), "n").collect()}
    assert got == {n: plain(n) for n in counts} and got[50_000] == (224, 224)
