"""From a piece's mask to its four sides: contour, corners, sides, refined corners."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np

from interlock.raster.kernels import filled, largest_component

#: Eight neighbours clockwise, as (column, row) steps.
_RING = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def contour(mask: np.ndarray) -> np.ndarray:
    """The outer border of a mask's largest part, clockwise, as (n, 2) columns and rows.

    Neighbours are searched clockwise from behind the last step, until the first pixel is left the way it was first left.
    """
    m = np.pad(filled(largest_component(mask)), 1)
    ys, xs = np.nonzero(m)
    if len(ys) < 2:
        return np.stack([xs, ys], axis=1) - 1
    here = start = (int(xs[0]), int(ys[0]))
    back, out, first = 4, [], None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            x, y = here[0] + _RING[d][0], here[1] + _RING[d][1]
            if m[y, x]:
                break
        else:
            return np.array([start]) - 1
        if here == start:
            if first is None:
                first = d
            elif d == first:
                return np.array(out) - 1
        out.append(here)
        here, back = (x, y), (d + 4) % 8


def _spokes(line: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean directions of the runs before and after every point of a closed line."""
    n = len(line)
    k = np.arange(2, reach + 1)
    before = line[(np.arange(n)[:, None] - k) % n] - line[:, None]
    after = line[(np.arange(n)[:, None] + k) % n] - line[:, None]
    turn = lambda v: np.angle((np.exp(1j * np.arctan2(v[..., 1], v[..., 0]))).mean(axis=1))
    return turn(before), turn(after)


def corners(line: np.ndarray, top: int = 12, pick: Callable[..., np.ndarray] | None = None) -> np.ndarray:
    """Indexes of the four corners along a contour; empty if there are none.

    ``pick`` chooses among the candidates in place of the rule below, given the contour, each point's score, the direction it opens to, how far that is off the centre, and the candidates.

    Points whose spokes open by about a right angle towards the centre are candidates, the best of close ones
    stay, and of all fours of the best the one with the largest area, the squarest angles and the most even gaps wins.
    """
    n = len(line)
    if n < 40:
        return np.zeros(0, int)
    f = line.astype(float)
    size = np.ptp(f, axis=0).mean()
    reach = max(6, int(size * 0.09))
    a, b = _spokes(f, reach)
    opening = np.abs(np.angle(np.exp(1j * (a - b))))
    middle = np.angle(np.exp(1j * a) + np.exp(1j * b))
    to_centre = np.arctan2(*(f.mean(axis=0) - f).T[::-1])
    off = np.abs(np.angle(np.exp(1j * (middle - to_centre))))
    score = np.abs(opening - np.pi / 2) + 0.4 * off
    order = [i for i in np.argsort(score, kind="stable") if np.radians(15) < opening[i] < np.radians(150) and off[i] < 1.2]
    kept: list[int] = []
    for i in order:
        if all(np.hypot(*(f[i] - f[j])) > 0.12 * size for j in kept):
            kept.append(i)
        if len(kept) == top:
            break
    if len(kept) < 4:
        return np.zeros(0, int)
    if pick is not None:
        return pick(line, score, middle, off, np.array(kept))
    best, best_cost = None, np.inf
    for four in combinations(sorted(kept), 4):
        p = f[list(four)]
        q = np.roll(p, -1, axis=0)
        area = abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2
        ways = np.arctan2(*(q - p).T[::-1])
        bends = np.abs(np.angle(np.exp(1j * (np.roll(ways, -1) - ways))))
        chords = np.hypot(*(q - p).T)
        cost = score[list(four)].sum() + np.abs(bends - np.pi / 2).sum() + chords.std() / chords.mean() - 2 * area / size**2
        if cost < best_cost:
            best, best_cost = four, cost
    return np.array(best)


def sides(line: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The four runs of a contour between neighbouring corners, both ends included."""
    n = len(line)
    return [line[np.arange(a, b + 1 + (n if b <= a else 0)) % n] for a, b in zip(at, np.roll(at, -1))]


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Points further than ``tolerance`` from the chords of what is kept, both ends included."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        r = line[a + 1 : b] - line[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * r[:, 1] - d[1] * r[:, 0]) / length if length else np.hypot(*r.T)
        k = int(off.argmax())
        if off[k] >= tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[sorted(keep)]


def refined(runs: list[np.ndarray], near: float = 1.5, far: float = 6.0) -> list[np.ndarray]:
    """Corners moved to where straight lines through the runs beside them meet (points ``near`` to ``far`` percent of the size away)."""
    size = np.mean([np.hypot(*(r[-1] - r[0])) for r in runs]) / 100
    out = [r.astype(float).copy() for r in runs]
    for k in range(4):
        one, two = runs[k - 1][::-1].astype(float), runs[k].astype(float)
        lines = []
        for r in (one, two):
            d = np.hypot(*(r - r[0]).T)
            p = r[(d >= near * size) & (d <= far * size)]
            if len(p) < 2:
                break
            c = p.mean(axis=0)
            lines.append((c, np.linalg.svd(p - c)[2][0]))
        if len(lines) < 2:
            continue
        (c1, d1), (c2, d2) = lines
        det = d1[0] * -d2[1] + d2[0] * d1[1]
        if abs(det) < 1e-6:
            continue
        t = ((c2 - c1)[0] * -d2[1] + d2[0] * (c2 - c1)[1]) / det
        p = c1 + t * d1
        if np.hypot(*(p - two[0])) < 5 * size:
            out[k - 1][-1] = out[k][0] = p
    return out


def incenter(ring: np.ndarray, stride: int = 8) -> tuple[int, int]:
    """An inner point far from the outline, by a grid about the middle; the middle if none lies inside."""
    lo, hi = ring.min(axis=0), ring.max(axis=0)
    mid, r = ring.mean(axis=0), 0.25 * (hi[0] - lo[0])
    step = max(1, min(stride, int(r / 4)))
    xs, ys = (np.arange(int(m - r), int(m + r), step) for m in mid)
    if not len(xs) or not len(ys):
        return int(round(mid[0])), int(round(mid[1]))
    p = np.stack(np.meshgrid(xs, ys, indexing="ij"), axis=-1).reshape(-1, 2).astype(float)
    a, b = ring.astype(float), np.roll(ring, -1, axis=0).astype(float)
    cross = ((a[:, 1] > p[:, 1:]) != (b[:, 1] > p[:, 1:])) & (p[:, :1] < (b[:, 0] - a[:, 0]) * (p[:, 1:] - a[:, 1]) / np.where(b[:, 1] == a[:, 1], 1, b[:, 1] - a[:, 1]) + a[:, 0])
    far = np.where(cross.sum(axis=1) % 2 == 1, np.hypot(*(p[:, None] - a[None]).transpose(2, 0, 1)).min(axis=1), -1)
    best = p[far.argmax()] if far.max() > 0 else mid
    return int(round(best[0])), int(round(best[1]))


def vectorised(mask: np.ndarray, edge_spread: float = 1.8, pick: Callable[..., np.ndarray] | None = None) -> list[dict]:
    """The four sides of a piece as rows; raises ValueError where four corners can't be found or too many sides are flat."""
    line = contour(mask)
    at = corners(line, pick=pick)
    if len(at) != 4:
        raise ValueError("no four corners")
    size = sum(mask.shape) / 200
    runs = refined(sides(line, at))
    out = []
    centre = incenter(line)
    for k, r in enumerate(runs):
        d = r[-1] - r[0]
        off = np.abs(d[0] * (r - r[0])[:, 1] - d[1] * (r - r[0])[:, 0]) / max(1e-9, np.hypot(*d))
        out.append({"side_index": k, "vertices": np.rint(simplified(r, 0.7)).astype(int).tolist(), "is_edge": bool(off.std() < edge_spread * size), "piece_center": [int(v) for v in line.mean(axis=0).round()], "incenter": list(centre)})
    flat = [s["is_edge"] for s in out]
    if sum(flat) > 2 or (sum(flat) == 2 and (flat[0] and flat[2] or flat[1] and flat[3])):
        raise ValueError("flat sides that can't be")
    return out
