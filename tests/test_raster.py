import numpy as np

from interlock.raster import kernels as k
from interlock.raster import outlines as o
from interlock.raster.plans import hashes, orientations, pieces_of, read_images, sides_of


def tabbed(size=500, side=200, r=30):
    m = np.zeros((size, size), np.uint8)
    a, b = (size - side) // 2, (size + side) // 2
    m[a:b, a:b] = 1
    y, x = np.mgrid[:size, :size]
    for cx, cy in ((size // 2, a), (size // 2, b), (a, size // 2), (b, size // 2)):
        m[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = 1
    return m


def test_components_match_a_flood_fill():
    m = (np.random.default_rng(0).random((40, 50)) > 0.45).astype(np.uint8)
    labels, n = k.components(m)
    seen, groups = set(), []
    for y, x in zip(*np.nonzero(m)):
        if (y, x) in seen:
            continue
        todo, part = [(y, x)], set()
        while todo:
            q = todo.pop()
            if q in part or not (0 <= q[0] < 40 and 0 <= q[1] < 50) or not m[q]:
                continue
            part.add(q)
            todo += [(q[0] + 1, q[1]), (q[0] - 1, q[1]), (q[0], q[1] + 1), (q[0], q[1] - 1)]
        seen |= part
        groups.append(frozenset(part))
    assert n == len(groups)
    assert {frozenset(zip(*(v.tolist() for v in np.nonzero(labels == i + 1)))) for i in range(n)} == {frozenset((int(a), int(b)) for a, b in g) for g in groups}


def test_islands_and_stragglers():
    m = np.zeros((100, 100), np.uint8)
    m[20:40, 20:40] = m[60:80, 60:80] = 1
    assert len(k.islands(m, 100)) == 2 and k.islands(m, 100)[0][1] == (19, 19)
    m[0:20, 70:90] = 1
    assert len(k.islands(m, 100)) == 2 and len(k.islands(m, 100, ignore_border=False)) == 3
    s = np.zeros((40, 40), np.uint8)
    s[10, 10] = 1
    s[20:30, 20:30] = 1
    assert k.without_stragglers(s)[10, 10] == 0 and k.without_stragglers(s)[20:30, 20:30].sum() == 100
    ring = np.zeros((30, 30), np.uint8)
    ring[5:25, 5:25] = 1
    ring[10:15, 10:15] = 0
    assert k.filled(ring).sum() == 400


def test_light_and_files():
    img = np.full((60, 60), 200, np.uint8)
    img[20:40, 20:40] = 40
    assert k.is_light_background(img) and 40 <= k.otsu(img) < 200
    assert k.segment(img, "otsu")[30, 30] == 1 and k.segment(img, "otsu")[5, 5] == 0
    m = tabbed(101, 40, 6)
    assert (k.read_bmp(k.write_bmp(m)) == m).all()
    bgr = np.dstack([np.full((9, 9), v, np.uint8) for v in (50, 100, 150)])
    assert np.ptp(k.gray_world(bgr).reshape(-1, 3).mean(axis=0)) < 1
    assert sum(k.histogram_hsv(bgr)["h"]) == 81
    assert k.reject_reason(np.zeros((5, 5))) == "empty" and k.reject_reason(np.ones((2, 60))) == "too long" and k.reject_reason(np.ones((20, 20))) is None
    assert "low contrast" in k.quality(np.full((20, 20), 128, np.uint8))["issues"]
    assert bin((k.perceptual_hash(img) ^ k.perceptual_hash(img[:, ::-1])) & (2**64 - 1)).count("1") < 20
    src = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert np.allclose(k.homography(src, src + 5) @ [3, 4, 1], [8, 9, 1])


def test_square_with_tabs_has_four_corners_and_no_edge():
    m = tabbed()
    line = o.contour(m)
    at = o.corners(line)
    want = {(150, 150), (349, 150), (349, 349), (150, 349)}
    assert len(at) == 4 and all(min(np.hypot(*(np.array(w) - line[i])) for w in want) < 25 for i in at)
    sides = o.vectorised(m)
    assert len(sides) == 4 and not any(s["is_edge"] for s in sides)
    flat = tabbed()
    flat[:150] = 0
    assert sum(s["is_edge"] for s in o.vectorised(flat)) == 1


def test_photo_to_sides_in_spark(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(k.write_bmp(tabbed()))
    (tmp_path / "b.bmp").write_bytes(k.write_bmp(np.zeros((50, 50), np.uint8)))
    images = read_images(spark, str(tmp_path))
    found = pieces_of(images, light_is_piece=True).cache()
    assert {(r["photo_id"], r["reason"]) for r in found.collect()} == {("a.bmp", None), ("b.bmp", "no piece")}
    rows = sides_of(found).collect()
    assert sorted(r["side_index"] for r in rows) == [0, 1, 2, 3]
    assert hashes(found).count() == 1
    assert {r["orientation"] for r in orientations(spark, str(tmp_path)).collect()} == {None}


def test_whole_photos():
    img = np.full((100, 80), 220, np.uint8)
    img[30:50, 20:60] = 10
    crop = k.cropped_to_content(img, 0)
    assert crop.shape == (20, 40) and k.cropped_to_content(np.full((5, 5), 7, np.uint8)).shape == (5, 5)
    assert k.shrunk(img, 50).shape == (50, 40) and k.shrunk(img).shape == img.shape
    square = np.array([[20, 30], [59, 30], [59, 49], [20, 49]], float)
    assert (k.perspective_corrected(img, square, 20, 40) == 10).all()
    two = np.zeros((60, 120), np.uint8)
    two[10:50, 5:50] = two[10:50, 70:115] = 1
    two[28:31, 50:70] = 1
    parts = k.split_oversized(two, 45)
    assert len(parts) == 2 and all((p & two == p).all() for p in parts)
    assert len(k.split_oversized(two[:, :50], 45)) == 1
    assert k.components(k.most_parts(two, 100))[1] == 2
    assert k.white_share(img) == 0.9 and k.luminance_counts(img)[10] == 800
    assert k.mean_squared_difference(np.ones((2, 2)), np.ones((2, 3))) == 1 and k.contrast(img, img < 50) == 0


def test_undecodable_photos_get_a_reason(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(k.write_bmp(tabbed()))
    (tmp_path / "broken.bmp").write_bytes(b"BM no image")
    (tmp_path / "cut.jpg").write_bytes(b"\xff\xd8\xff")
    found = pieces_of(read_images(spark, str(tmp_path)), light_is_piece=True).collect()
    assert {(r["photo_id"], r["reason"]) for r in found} == {("a.bmp", None), ("broken.bmp", "undecodable image"), ("cut.jpg", "undecodable image")}
