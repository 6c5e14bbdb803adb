import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from interlock.operators.board import generated_puzzle
from interlock.pipeline import Pipeline
from interlock.plans import stages
from interlock.raster.plans import code_scores, key_codes, pages, pieces_of, read_images
from interlock.sources import files
from interlock.streaming.identify import Store, color_verified
from tests.test_features import noise
from tests.test_raster import tabbed


def png(img):
    """A gray or colour image as a PNG file's bytes."""
    a = img if img.ndim == 3 else img[..., None]
    rows = b"".join(b"\0" + r.tobytes() for r in a)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, {1: 0, 3: 2, 4: 6}[a.shape[2]], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def photo(*pieces):
    img = np.full((420, 420 * len(pieces)), 230, np.uint8)
    for k, m in enumerate(pieces):
        img[:, 420 * k : 420 * (k + 1)][m > 0] = 40
    return img


def test_a_run_from_photos_to_steps(spark, tmp_path):
    a, b = tabbed(420, 200, 30), tabbed(420, 200, 30)
    b[:110] = 0  # a corner piece: no tabs on top and to the left
    b[:, :110] = 0
    (tmp_path / "photos").mkdir()
    (tmp_path / "photos" / "one.png").write_bytes(png(photo(a, b)))
    (tmp_path / "photos" / "two.png").write_bytes(png(photo(a)))
    run = Pipeline(spark, f"file://{tmp_path}/run", stages.phone_run(spark, f"file://{tmp_path}/photos", 2, 1, method="otsu"))
    t = run.run()
    assert t["pieces"].where("reason is null").count() == 3 and t["sides"].count() == 12
    groups = t["groups"].collect()
    assert len(groups) == 2 and len({r["group_id"] for r in groups}) == 1
    assert t["kept"].select("piece_id").distinct().count() == 2 and t["normal"].count() == 8
    assert t["steps"].select("board_id").distinct().count() <= 1 and set(t) == {n for n, _ in run.stages}
    spots = stages.spot_stages(lambda _: spark.createDataFrame([(0, "one.png", [0.0, 0.0], None), (0, "two.png", [2.0, 0.0], None)], "batch_id long, file_name string, position array<double>, received_at timestamp"), 500.0, 900.0)
    robot = Pipeline(spark, f"file://{tmp_path}/robot", [("sides", lambda _: t["sides"]), *spots])
    assert robot.run()["groups"].count() == 2  # the same place in both photos


def test_image_plans(spark, tmp_path):
    page = np.full((200, 300), 230, np.uint8)
    page[30:170, 40:260] = 60
    n = noise()
    for name, img in {"page": page, "a": n, "b": np.roll(n, (3, 4), axis=(0, 1)), "c": noise(seed=9)}.items():
        (tmp_path / f"{name}.png").write_bytes(png(img))
    alpha = np.zeros((120, 240, 4), np.uint8)
    alpha[20:100, 20:100] = alpha[20:100, 130:210] = 255
    alpha[55:60, 100:130] = 255  # a bridge between the two
    (tmp_path / "touching.png").write_bytes(png(alpha))
    images = read_images(spark, f"file://{tmp_path}").cache()
    found = {r["photo_id"]: r["corners"] for r in pages(images).collect()}
    assert np.abs(np.array(found["page.png"]) - [[40, 30], [259, 30], [259, 169], [40, 169]]).max() < 8
    pairs = spark.createDataFrame([("a.png", "b.png"), ("a.png", "c.png"), ("a.png", "none")], "a string, b string")
    s = {r["b"]: r["score"] for r in code_scores(pairs, key_codes(images)).collect()}
    assert s["b.png"] > s["c.png"] and s["none"] == 0
    parts = pieces_of(images.where("photo_id = 'touching.png'"), method="alpha").where("reason is null or reason <> 'no piece'")
    assert parts.count() == 2 and {m for m in ("graded", "color") for _ in [pieces_of(images, method=m).count()]} == {"graded", "color"}


def test_store_solves_inserts_and_forgets(spark, tmp_path):
    fits, answer = generated_puzzle(3, 3, 4, noise=0)
    missing = answer[4][0]  # the piece in the middle
    store = Store(spark, f"file://{tmp_path}/store")
    listed = {(p, s) for p, s, *_ in fits}
    side = [(p, s, (p, s) not in listed) for p, *_ in answer for s in range(4)]
    spark.createDataFrame(side, "piece_id long, side_index int, is_edge boolean").write.parquet(f"{tmp_path}/store/sides/batch=0")
    spark.createDataFrame(fits, "piece_id long, side int, other_piece long, other_side int, err double").write.parquet(f"{tmp_path}/store/fits/batch=0")
    info = {r["piece_id"]: (r["is_edge"], r["is_corner"]) for r in store.edge_info().collect()}
    assert info[missing] == (False, False) and sum(c for _, c in info.values()) == 4
    assert store.position_of(missing) is None and store.place_new(missing, 3, 3) == "new_solved"
    x, y, _ = store.position_of(missing)
    assert (x, y) == (1, 1) and store.piece_at(1, 1) == missing and store.piece_at(7, 7) is None
    placed, size = store._solution()
    store.load_solution(placed.where(F.col("piece_id") != missing), *size.first())
    assert store.piece_at(1, 1) is None and store.insert(missing)[:2] == (1, 1) and store.piece_at(1, 1) == missing
    assert store.place_new(missing, 3, 3) == "new_unsolved"  # no cell left
    assert store.remove(missing).select("piece_id").distinct().count() == 8 and store.table("fits").where(F.col("other_piece") == missing).count() == 0


def test_colours_decide_on_known_pieces(spark):
    h = "struct<h:array<double>,s:array<double>,v:array<double>>"
    one, two = ([1.0, 5.0, 2.0],) * 3, ([5.0, 1.0, 4.0],) * 3
    results = spark.createDataFrame([(1, "known", 9, 0.9), (2, "known", 9, 0.8), (3, "known", 8, 0.7), (4, "new_unsolved", None, 0.5)], "piece_id long, status string, known_id long, confidence double")
    new = spark.createDataFrame([(1, one), (2, two), (3, one)], f"piece_id long, overall_histogram {h}")
    stored = spark.createDataFrame([(9, one)], f"piece_id long, overall_histogram {h}")
    got = {r["piece_id"]: (r["status"], r["known_id"], r["confidence"]) for r in color_verified(results, new, stored).collect()}
    assert got == {1: ("known", 9, 0.9), 2: ("new_unsolved", None, 0.5), 3: ("known", 8, 0.7), 4: ("new_unsolved", None, 0.5)}


def test_reports_and_writers(spark, tmp_path):
    steps = spark.createDataFrame([(1, 7, 0, 0, "corner", "as it lies", None, 8), (1, 8, 1, 0, "corner", "half a turn", 7, None), (1, 9, 0, 1, "edge", "as it lies", None, None)], "board_id long, piece_id long, x int, y int, class string, turn string, left_id long, right_id long")
    html = files.guide_html(steps.selectExpr("*", "cast(null as bigint) as top_id", "cast(null as bigint) as bottom_id")).first()["html"]
    assert html.count("<h2>") == 2 and "right #8" in html and html.index("#7") < html.index("#8") < html.index("#9")
    places = spark.createDataFrame([(1, 7, 10.0, 20.0, 0.0)], "board_id long, piece_id long, dest_x double, dest_y double, turn double")
    s = spark.createDataFrame([(7, k, [[0, 0], [4, k]], [2, 2]) for k in range(4)], "piece_id long, side_index int, vertices array<array<int>>, incenter array<int>")
    svg = files.board_svg(places, s).first()["svg"]
    assert svg.count("polyline") == 4 and 'points="8.0,18.0 12.0,18.0"' in svg
    groups = spark.createDataFrame([(1, 1), (2, 1), (5, 5)], "id long, group_id long")
    d = spark.createDataFrame([(1, 2, 1, 0.01, 0.9, True), (2, 5, 1, 0.3, None, False)], "a long, b long, stage int, total_rmse double, ncc double, confirms boolean")
    got = {r["group_id"]: r["html"] for r in files.groups_html(groups, d).collect()}
    assert "1 - 2: stage 1" in got[1] and "<li>" not in got[5]
    colors = spark.createDataFrame([(3, [1.0, 2.0, 3.0])], "piece_id long, center_color array<double>")
    files.write_colors(colors, f"file://{tmp_path}/colors")
    assert spark.read.json(f"file://{tmp_path}/colors").first()["piece_id"] == 3
