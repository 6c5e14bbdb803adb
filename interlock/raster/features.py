"""Edges, local contrast, page corners, graded segmentation, key points: numpy kernels on whole images."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from interlock.raster import kernels as k
from interlock.raster.outlines import contour, simplified

# -- orientation and transparency


def upright(img: np.ndarray, tag: int | None) -> np.ndarray:
    """An image turned and mirrored as its orientation tag (1 to 8) says; other tags change nothing."""
    if tag in (5, 6, 7, 8):
        img = img.swapaxes(0, 1)
    if tag in (2, 3, 6, 7):
        img = img[:, ::-1]
    if tag in (3, 4, 7, 8):
        img = img[::-1]
    return img


def alpha_mask(img: np.ndarray, level: int = 128, light: int = 240) -> np.ndarray:
    """Where an image is opaque; without an alpha channel, where it is darker than nearly white."""
    if img.ndim == 3 and img.shape[2] == 4:
        return (img[..., 3] > level).astype(np.uint8)
    gray = img if img.ndim == 2 else k.gray(img[..., :3])
    return (gray <= light).astype(np.uint8)


# -- local contrast


def clahe(img: np.ndarray, limit: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast equalised tile by tile: histograms clipped at ``limit`` times their mean, the tiles' maps blended between their centres."""
    h, w = img.shape
    th, tw = -(-h // grid), -(-w // grid)
    padded = np.pad(img, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    maps = np.empty((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            top = max(1.0, limit * n.sum() / 256)
            over = np.clip(n - top, 0, None).sum()
            maps[i, j] = (np.minimum(n, top) + over / 256).cumsum() * 255 / n.sum()
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(y), 0, grid - 1).astype(int), np.clip(np.floor(x), 0, grid - 1).astype(int)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None]
    at = lambda a, b: maps[a[:, None], b[None], img]
    out = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    return np.rint(out).clip(0, 255).astype(np.uint8)


def normal_color(bgr: np.ndarray) -> np.ndarray:
    """Gray-world white balance, then local contrast of the lightness alone; hue is kept by scaling all channels alike."""
    balanced = k.gray_world(bgr)
    light = balanced.max(axis=2)
    gain = clahe(light).astype(float) / np.maximum(light, 1)
    return np.clip(balanced * gain[..., None], 0, 255).astype(np.uint8)


# -- edges and pages


def edges(img: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges by gradient: ridges across the gradient's direction, weak ones only where they hang on strong ones."""
    f = np.pad(img.astype(float), 1, mode="edge")
    gx = (f[:-2, 2:] + 2 * f[1:-1, 2:] + f[2:, 2:]) - (f[:-2, :-2] + 2 * f[1:-1, :-2] + f[2:, :-2])
    gy = (f[2:, :-2] + 2 * f[2:, 1:-1] + f[2:, 2:]) - (f[:-2, :-2] + 2 * f[:-2, 1:-1] + f[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    way = np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    p = np.pad(size, 1)
    h, w = size.shape
    ridge = np.zeros(size.shape, bool)
    for d, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        fore, back = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], p[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        ridge |= (way == d) & (size > back) & (size >= fore)
    weak = (ridge & (size > low)).astype(np.uint8)
    # parts joined by corners count as one here: a pixel's square is widened before parts are told apart
    labels, n = k.components(k.dilated(weak, 3))
    keep = np.zeros(n + 1, bool)
    keep[np.unique(labels[(weak > 0) & (size > high)])] = True
    keep[0] = False
    return weak & keep[labels]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of points (n, 2), in order round it."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _area(ring: np.ndarray) -> float:
    q = np.roll(ring, -1, axis=0)
    return abs(float((ring[:, 0] * q[:, 1] - q[:, 0] * ring[:, 1]).sum())) / 2


def _closed_simplified(ring: np.ndarray, share: float) -> np.ndarray:
    """A closed outline thinned to corners that stand out by ``share`` of its length; it starts at one of its two furthest points."""
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    ring = np.roll(ring, -far, axis=0)
    length = np.hypot(*(np.roll(ring, -1, axis=0) - ring).T).sum()
    half = int(np.hypot(*(ring - ring[0]).T).argmax())
    parts = [simplified(ring[: half + 1].astype(float), share * length), simplified(np.concatenate([ring[half:], ring[:1]]).astype(float), share * length)]
    return np.concatenate([parts[0][:-1], parts[1][:-1]])


def page_corners(bgr: np.ndarray, ratio: float = 0.85) -> np.ndarray | None:
    """The four corners (top left, top right, bottom right, bottom left) of the largest four-cornered region over ``ratio`` * 0.3 of the image, or None."""
    gray = bgr if bgr.ndim == 2 else k.gray(bgr[..., :3])
    drawn = edges(np.rint(k.blur(gray, 5)).astype(np.uint8))
    drawn = k.dilated(drawn, 5)
    for _ in range(2):
        drawn = k.closed(drawn, 5)
    labels, n = k.components(k.filled(drawn))
    best, most = None, ratio * 0.3 * gray.size
    for i in range(1, n + 1):
        part = labels == i
        area = float(part.sum())
        if area < most:
            continue
        ring = hull(np.argwhere(part)[:, ::-1].astype(float))
        for _ in range(2):
            ring = _closed_simplified(ring, 0.02) if len(ring) > 4 else ring
        if len(ring) == 4:
            best, most = ring, area
    if best is None:
        return None
    total, gap = best.sum(axis=1), best[:, 1] - best[:, 0]
    return best[[total.argmin(), gap.argmin(), total.argmax(), gap.argmax()]]


# -- graded segmentation


def segmentation_quality(mask: np.ndarray, gray: np.ndarray) -> dict:
    """Share covered, number of parts, spread of their sizes and how much of their border lies on edges; a score from 0 to 1 and what is wrong."""
    labels, n = k.components(mask)
    if not n:
        return {"share": 0.0, "parts": 0, "sharpness": 0.0, "score": 0.0, "issues": ["nothing found"]}
    sizes = np.bincount(labels.ravel())[1:]
    share, spread = float(mask.mean()), float(sizes.std() / sizes.mean())
    border = (k.dilated(mask, 3, True) - k.eroded(mask, 3, True)) > 0
    sharp = float((border & (edges(gray) > 0)).sum() / max(1, border.sum()))
    rules = (
        ("too little covered", share < 0.05), ("too much covered", share > 0.95), ("too few parts", n < 3), ("too many parts", n > 500), ("sizes differ too much", spread > 2), ("blurred borders", sharp < 0.1),
    )
    score = 0.3 * min(2 * share, 1) + 0.3 * min(sharp, 1) + 0.2 * (0.1 < share < 0.8) + 0.2 * (spread < 1.5)
    return {"share": share, "parts": n, "sharpness": sharp, "score": float(score), "issues": [name for name, bad in rules if bad]}


def segment_by_color(bgr: np.ndarray, margin: float = 0.05, rounds: int = 5, colors: int = 5) -> np.ndarray:
    """Foreground by colour: everything inside a margin is taken for foreground at first, and pixels move to the nearer of two sets of mean colours in turn.

    A colour-model refinement without smoothness along borders, closed and opened at the end.
    """
    h, w = bgr.shape[:2]
    a, b = max(1, int(h * margin)), max(1, int(w * margin))
    mask = np.zeros((h, w), bool)
    mask[a : h - a, b : w - b] = True
    p = bgr.reshape(-1, 3).astype(float)
    frame = ~mask.ravel()
    inside = mask.ravel().copy()
    for _ in range(rounds):
        if not inside.any() or inside.all():
            break
        near = [np.min(((p[:, None] - _means(p[part], colors)[None]) ** 2).sum(axis=2), axis=1) for part in (inside, ~inside)]
        new = (near[0] < near[1]) & ~frame
        if (new == inside).all():
            break
        inside = new
    return k.opened(k.closed(inside.reshape(h, w).astype(np.uint8), 5, True), 5, True)


def _means(p: np.ndarray, colors: int) -> np.ndarray:
    """Mean colours of slices of equal size along the main axis of a set of pixels."""
    centred = p - p.mean(axis=0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    return np.array([c.mean(axis=0) for c in np.array_split(p[np.argsort(centred @ axis, kind="stable")], min(colors, len(p)))])


def segment_graded(gray: np.ndarray, bgr: np.ndarray | None = None, min_pixels: int = 100, min_score: float = 0.3) -> tuple[np.ndarray, str, dict]:
    """(mask, method, quality): the first threshold method without issues and with score enough; else by colour; else whichever finds enough."""
    tried = [(name, f(gray)) for name, f in k.SEGMENTERS.items()]
    graded = [(m, name, segmentation_quality(m, gray)) for name, m in tried if m.sum() >= min_pixels]
    for found in graded:
        if found[2]["score"] >= min_score and not found[2]["issues"]:
            return found
    if bgr is not None and (m := segment_by_color(bgr)).sum() >= min_pixels:
        return m, "color", segmentation_quality(m, gray)
    return graded[0] if graded else (np.zeros(gray.shape, np.uint8), "none", segmentation_quality(np.zeros(gray.shape, np.uint8), gray))


# -- key points

#: Circle of sixteen pixels round a key point, clockwise from the top, as (row, column).
_CIRCLE = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))
_RADIUS, _BITS = 15, 256
_PAIRS = np.clip(np.random.default_rng(17).normal(0, _RADIUS / 2.2, (_BITS, 2, 2)), -_RADIUS + 4, _RADIUS - 4)


def key_points(gray: np.ndarray, most: int = 500, level: int = 20, run: int = 9) -> np.ndarray:
    """(n, 2) rows and columns of corners: ``run`` pixels on end of the circle all brighter or all darker; the strongest ones, no two neighbours."""
    h, w = gray.shape
    m = _RADIUS + 3
    if h <= 2 * m or w <= 2 * m:
        return np.zeros((0, 2), int)
    f = gray.astype(int)
    ring = np.stack([f[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] for dy, dx in _CIRCLE]) - f[3 : h - 3, 3 : w - 3]
    found = np.zeros(ring.shape[1:], bool)
    for sign in (1, -1):
        on = sign * ring > level
        on = np.concatenate([on, on[: run - 1]])
        for a in range(len(_CIRCLE)):
            found |= on[a : a + run].all(axis=0)
    strength = np.where(found, np.clip(np.abs(ring) - level, 0, None).sum(axis=0), 0)
    top = np.maximum.reduce([np.pad(strength, 1)[i : i + strength.shape[0], j : j + strength.shape[1]] for i in range(3) for j in range(3)])
    at = np.argwhere((strength > 0) & (strength == top)) + 3
    at = at[((at >= m) & (at < np.array([h, w]) - m)).all(axis=1)]
    order = np.argsort(-strength[at[:, 0] - 3, at[:, 1] - 3], kind="stable")[:most]
    return at[order]


def descriptors(gray: np.ndarray, most: int = 500) -> np.ndarray:
    """(n, 4) codes of 256 bits: brightness comparisons round each key point, turned to the direction of its centre of light."""
    at = key_points(gray, most)
    if not len(at):
        return np.zeros((0, 4), np.uint64)
    y, x = np.mgrid[-_RADIUS : _RADIUS + 1, -_RADIUS : _RADIUS + 1]
    disc = x * x + y * y <= _RADIUS * _RADIUS
    f = gray.astype(float)
    patches = np.stack([f[r - _RADIUS : r + _RADIUS + 1, c - _RADIUS : c + _RADIUS + 1] for r, c in at]) * disc
    way = np.arctan2((patches * y).sum(axis=(1, 2)), (patches * x).sum(axis=(1, 2)))
    soft = k.blur(gray, 5)
    turn = np.stack([np.stack([np.cos(way), np.sin(way)], 1), np.stack([-np.sin(way), np.cos(way)], 1)], 1)  # rows: new x, new y as (row, column) parts
    spot = np.einsum("bpk,nkj->nbpj", _PAIRS, turn)
    r, c = (np.rint(at[:, None, None, i] + spot[..., 1 - i]).astype(int) for i in (0, 1))
    light = soft[np.clip(r, 0, gray.shape[0] - 1), np.clip(c, 0, gray.shape[1] - 1)]
    bits = (light[..., 0] < light[..., 1]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def matched(a: np.ndarray, b: np.ndarray, below: int = 50) -> list[tuple[int, int, int]]:
    """(index in a, index in b, bits apart) of codes that are each other's nearest, less than ``below`` apart, nearest first; none for fewer than two codes."""
    if len(a) < 2 or len(b) < 2:
        return []
    d = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2).astype(int)
    fore, back = d.argmin(axis=1), d.argmin(axis=0)
    return sorted(((i, int(j), int(d[i, j])) for i, j in enumerate(fore) if back[j] == i and d[i, j] < below), key=lambda m: (m[2], m[0]))


def match_score(one: np.ndarray, two: np.ndarray, most: int = 500) -> float:
    """Likeness of two gray images from 0 to 1: how close their matched key points are, and how many there are."""
    a, b = descriptors(one, most), descriptors(two, most)
    found = matched(a, b)
    if not found:
        return 0.0
    apart = sum(m[2] for m in found) / len(found)
    return 0.6 * max(0.0, 1 - apart / _BITS) + 0.4 * min(len(found) / max(len(a), len(b), 1), 1.0)


# -- corners of a piece by diagonals


def corner_diagonals(line: np.ndarray, score: np.ndarray, middle: np.ndarray, lean: np.ndarray, candidates: np.ndarray, side: int = 4, most: int = 30) -> np.ndarray:
    """The four of ``candidates`` (indexes along a contour) that make the best two diagonals, in order along the contour.

    ``score`` is how bad a point is as a corner, ``middle`` the direction it opens to, ``lean`` how unevenly it opens to the centre.  Of each side of the
    box the best ``side`` candidates stay (a point near two sides counts for both), the best ``most`` pairs are
    compared with each other.  A diagonal's ends lie opposite each other, equally far from the centre and open towards each other; four
    corners are a right angle apart.  Empty with fewer than four candidates.
    """
    f = line.astype(float)
    low, size = f.min(axis=0), np.maximum(np.ptp(f, axis=0), 1)
    centre = f.mean(axis=0)
    picks: dict[int, None] = {}
    ranked = sorted({int(c) for c in candidates}, key=lambda i: (score[i], i))
    near = {}
    for i in ranked:
        share = (f[i] - low) / size
        gaps = sorted(zip((share[0], 1 - share[0], share[1], 1 - share[1]), range(4)))
        near[i] = {gaps[0][1]} | ({gaps[1][1]} if gaps[1][0] < 0.35 else set())
    for s in range(4):
        picks |= dict.fromkeys([i for i in ranked if s in near[i]][:side])
    if len(picks) < 4:
        return np.zeros(0, int)
    way = {i: float(np.arctan2(*(f[i] - centre)[::-1])) for i in picks}
    far = {i: float(np.hypot(*(f[i] - centre))) for i in picks}

    def diagonal(a: int, b: int) -> float:
        opposite = abs(abs(way[a] - way[b]) - np.pi)
        uneven = abs(far[a] - far[b]) / max(far[a], far[b], 1e-9)
        facing = abs(abs(middle[a] - middle[b]) - np.pi)
        return 1.2 * (score[a] + score[b]) + 0.5 * opposite + 0.2 * uneven + 0.005 * np.degrees(facing)

    pairs = sorted((diagonal(a, b), a, b) for a, b in combinations(picks, 2))[:most]
    best, cost = None, np.inf
    for (s1, a, b), (s2, c, d) in combinations(pairs, 2):
        ways = sorted(way[i] for i in (a, b, c, d))
        gaps = [abs(float(np.angle(np.exp(1j * (v - u))))) for u, v in zip(ways, [*ways[1:], ways[0]])]
        total = s1 + s2 + sum(0.5 * min(abs(g - np.pi / 2), np.pi / 4) for g in gaps) + 0.5 * sum(lean[i] for i in (a, b, c, d))
        if (least := min(gaps)) < np.radians(10):
            total += 1 / (least + 0.01)
        if total < cost and len({a, b, c, d}) == 4:
            best, cost = sorted((a, b, c, d)), total
    return np.array(best if best is not None else [], int)


def straight_corner(line: np.ndarray, at: int, step: int, size: float, bend: float = 0.25, most: int = 200) -> float:
    """How bad a contour point is as a corner by the straight runs beside it: far from a right angle and short runs cost; lower is better."""
    n = len(line)
    ends = []
    for sign in (1, -1):
        j = (at + sign * step * np.arange(1, most + 2)) % n
        d = np.diff(line[j].astype(float), axis=0)
        ways, lengths = np.arctan2(d[:, 1], d[:, 0]), np.hypot(*d.T).cumsum()
        off = np.abs(np.angle(np.exp(1j * (ways - ways[0])))) > bend
        last = int(off.argmax()) - 1 if off.any() else len(ways) - 1
        ends.append((lengths[last], ways[0]))
    (fore, a), (back, b) = ends
    angle = np.degrees(abs(np.angle(np.exp(1j * (a - b)))))
    return abs(angle - 90) / 90 - 2 * min(fore, back) / size if size > 0 else abs(angle - 90) / 90


def without_close(ring: np.ndarray, apart: float = 2.25) -> np.ndarray:
    """A closed outline in which no two neighbours are within ``apart``: the later one is dropped, the last against the first too."""
    kept: list[np.ndarray] = []
    for p in ring:
        if not kept or np.hypot(*(p - kept[-1])) > apart:
            kept.append(p)
    while len(kept) > 1 and np.hypot(*(kept[-1] - kept[0])) <= apart:
        kept.pop()
    return np.array(kept)


def stroked(line: np.ndarray, reach: float = 1.0, arc: int = 8) -> np.ndarray:
    """The outline of everything within ``reach`` of a line of two or more points, for lines that don't turn back on themselves; round ends, bends joined."""
    p = line.astype(float)
    d = np.diff(p, axis=0)
    p, d = np.concatenate([p[:1], p[1:][np.hypot(*d.T) > 0]]), d[np.hypot(*d.T) > 0]
    if not len(d):
        return np.zeros((0, 2))
    ways = np.arctan2(d[:, 1], d[:, 0])

    def along(q: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        out = []
        for i in range(len(w)):
            side = reach * np.array([np.cos(w[i] + np.pi / 2), np.sin(w[i] + np.pi / 2)])
            out += [q[i] + side, q[i + 1] + side]
        for t in np.linspace(np.pi / 2, -np.pi / 2, arc + 1)[1:-1]:
            out.append(q[-1] + reach * np.array([np.cos(w[-1] + t), np.sin(w[-1] + t)]))
        return out

    return np.array(along(p, ways) + along(p[::-1], ways[::-1] + np.pi))


def drawn(lines: list[np.ndarray], height: int = 24, width: int = 48, closed: bool = False) -> str:
    """Lines as text, one character a cell: a digit for the line, '.' elsewhere; with ``closed`` filled outlines."""
    points = np.concatenate([v.astype(float) for v in lines])
    low, size = points.min(axis=0), np.maximum(np.ptp(points, axis=0), 1e-9)
    cells = np.full((height, width), ".")
    for n, line in enumerate(lines):
        q = (line - low) / size * np.array([width - 1, height - 1])
        mark = str(n % 10)
        if closed:
            from interlock.operators.nearby import within

            ys, xs = np.mgrid[:height, :width]
            cells[within(np.stack([xs.ravel(), ys.ravel()], axis=1).astype(float), q).reshape(height, width)] = mark
        for a, b in zip(q, q[1:] if not closed else np.roll(q, -1, axis=0)):
            for t in np.linspace(0, 1, int(np.abs(b - a).max()) * 2 + 2):
                x, y = np.rint(a + t * (b - a)).astype(int)
                cells[y, x] = mark
    return "\n".join("".join(r) for r in cells)


def contour_parts(mask: np.ndarray) -> np.ndarray:
    """A mask's outline as whole points, thinned of neighbours that lie too close."""
    return without_close(contour(mask))
