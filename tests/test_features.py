import numpy as np

from interlock.raster import features as f
from interlock.raster import kernels as k
from interlock.raster import outlines as o
from tests.test_raster import tabbed


def noise(h=160, w=180, seed=0):
    r = np.random.default_rng(seed)
    return np.rint(k.blur(np.kron(r.integers(0, 256, (h // 8, w // 8)), np.ones((8, 8))), 5)).astype(np.uint8)


def test_orientation_tags_undo_each_turn():
    img = np.arange(6).reshape(2, 3)
    turned = {1: img, 2: img[:, ::-1], 3: img[::-1, ::-1], 4: img[::-1], 5: img.T, 6: np.rot90(img), 7: img[::-1, ::-1].T, 8: np.rot90(img, -1)}
    for tag, stored in turned.items():
        assert (f.upright(stored, tag) == img).all(), tag
    assert f.upright(img, None) is img


def test_alpha_and_contrast():
    rgba = np.zeros((4, 4, 4), np.uint8)
    rgba[1, 1, 3] = 200
    assert f.alpha_mask(rgba).sum() == 1 and f.alpha_mask(np.full((3, 3), 250, np.uint8)).sum() == 0
    flat = (noise() // 8 + 100).astype(np.uint8)
    out = f.clahe(flat)
    assert out.shape == flat.shape and out.std() > 1.5 * flat.std()
    assert np.ptp(f.clahe(np.full((64, 64), 7, np.uint8))) == 0
    assert f.normal_color(np.dstack([flat, flat // 2, flat])).shape == (*flat.shape, 3)


def test_edges_and_page():
    img = np.full((200, 300), 230, np.uint8)
    img[30:170, 40:260] = 60
    e = f.edges(img)
    assert e[100, 38:42].any() and not e[100, 100:200].any()
    got = f.page_corners(np.dstack([img] * 3))
    assert np.abs(got - [[40, 30], [259, 30], [259, 169], [40, 169]]).max() < 8
    assert f.page_corners(np.full((60, 60, 3), 9, np.uint8)) is None


def test_graded_segmentation():
    img = np.full((300, 400), 225, np.uint8)
    for a in (20, 160):
        for b in (20, 150, 280):
            img[a : a + 110, b : b + 100] = 50
    mask, method, q = f.segment_graded(img)
    assert method in k.SEGMENTERS and q["parts"] == 6 and not q["issues"] and q["score"] > 0.5
    color = np.dstack([img, 255 - img, np.full_like(img, 90)])
    assert 0.9 < f.segment_by_color(color)[img < 100].mean() <= 1 and f.segment_by_color(color)[img > 100].mean() < 0.1
    assert f.segment_graded(img, min_pixels=200_000)[1] == "none"
    assert f.segmentation_quality(np.zeros((5, 5), np.uint8), np.zeros((5, 5), np.uint8))["issues"] == ["nothing found"]


def test_key_points_match_a_shifted_and_a_turned_image():
    a = noise()
    b = np.roll(a, (5, 9), axis=(0, 1))
    assert len(f.key_points(a)) > 15
    found = f.matched(f.descriptors(a), f.descriptors(b))
    pa, pb = f.key_points(a), f.key_points(b)
    right = sum((pb[j] - pa[i]).tolist() == [5, 9] for i, j, _ in found)
    assert right > 10 and right >= 0.8 * len(found)
    assert f.match_score(a, a) > 0.95 > f.match_score(a, b) > f.match_score(a, noise(seed=9))
    assert f.match_score(a, np.rot90(a).copy()) > f.match_score(a, noise(seed=9))
    assert f.match_score(a[:20, :20], a) == 0


def test_corners_by_diagonals():
    line = o.contour(tabbed())
    n = len(line)
    c = line.mean(axis=0)
    far = np.hypot(*(line - c).T)
    true = [int(np.hypot(*(line - q).T).argmin()) for q in ((150, 150), (349, 150), (349, 349), (150, 349))]
    score = np.full(n, 1.0)
    score[true] = 0.1
    middle = np.arctan2(*(c - line).T[::-1])
    others = [int(i) for i in np.linspace(0, n - 1, 17)]
    got = f.corner_diagonals(line, score, middle, np.zeros(n), np.array([*true, *others]))
    assert sorted(got) == sorted(true) and far.max() > 0
    assert len(f.corner_diagonals(line, score, middle, np.zeros(n), np.array(true[:3]))) == 0
    assert f.straight_corner(line, true[0], 2, 200) < f.straight_corner(line, (true[0] + 25) % n, 2, 200)


def test_outline_helpers():
    ring = np.array([[0, 0], [1, 0], [10, 0], [10, 10], [0, 10], [0, 1]])
    assert f.without_close(ring).tolist() == [[0, 0], [10, 0], [10, 10], [0, 10]]
    s = f.stroked(np.array([[0, 0], [10, 0]]))
    assert np.abs(s[:, 1]).max() <= 1 + 1e-9 and s[:, 0].min() >= -1 - 1e-9 and s[:, 0].max() <= 11 + 1e-9 and f._area(s) > 20
    text = f.drawn([np.array([[0, 0], [9, 9]]), np.array([[9, 0], [0, 9]])], 10, 10)
    assert text.splitlines()[0][0] == "0" and text.splitlines()[0][9] == "1" and text.splitlines()[0][4] == "."
    assert "0" in f.drawn([np.array([[0, 0], [9, 0], [9, 9], [0, 9]])], 10, 10, closed=True).splitlines()[5]
