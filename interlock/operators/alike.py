"""Array work of the self-joins on shapes: resampled outlines, and pieces alike under a rotation, block against block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of one tile; the matrix of a tile stays in the processor's cache.
TILE, WIDE = 64, 2048
#: Runs of a profile whose means stand for it in the bound, and the directions of each side's that leaves are cut along.
PARTS, AXES = 6, 2


def points_of(lines: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of [x, y] as one array (rows, longest, 2), filled up with each line's last point, and the numbers of points.  No line may be empty."""
    inner = lines.flatten()
    size = np.diff(lines.offsets.to_numpy()).astype(np.int64)
    at = inner.offsets.to_numpy()[:-1].astype(np.int64)
    values = inner.values.to_numpy(zero_copy_only=False)
    xy = np.stack([values[at], values[at + 1]], axis=1).astype(float)
    start = np.cumsum(size) - size
    seat = start[:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)
    return xy[seat], size


def walked(points: np.ndarray) -> np.ndarray:
    """Way from the first point to each."""
    d = np.diff(points, axis=1)
    out = np.zeros(points.shape[:2])
    np.cumsum(np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1]), axis=1, out=out[:, 1:])
    return out


def resampled(points: np.ndarray, size: np.ndarray, way: np.ndarray, segments: int) -> np.ndarray:
    """``geom.resample`` of whole batches: the same sums in the same order."""
    goal = way[:, -1:] * np.arange(segments + 1) / segments
    until = np.where(np.arange(points.shape[1]) < size[:, None], way, np.inf)
    seat = np.stack([(until <= goal[:, k : k + 1]).sum(axis=1) for k in range(segments + 1)], axis=1)
    seat = np.clip(seat, 1, size[:, None] - 1) - 1
    row = np.arange(len(points))[:, None]
    a, b, start, end = points[row, seat], points[row, seat + 1], way[row, seat], way[row, seat + 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(end > start, np.minimum(goal - start, end - start) / (end - start), 0.0)[..., None]
    return a + t * (b - a)


def profiles(points: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chord lengths, profiles, their means) of ``sides.profile``."""
    p = resampled(points, size, walked(points), n - 1)
    a, b = points[:, 0], points[:, -1]
    dx, dy = (b - a).T[..., None]
    length = np.sqrt(dx * dx + dy * dy)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (dx * (p[..., 1] - a[:, 1:]) - dy * (p[..., 0] - a[:, :1])) / length / length
    out[length[:, 0] < 1] = 0.0
    return length[:, 0], out, np.cumsum(out, axis=1)[:, -1] / n


def normal_forms(points: np.ndarray, size: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(arc lengths, chord lengths, v, vf) of ``sides.normalised``."""
    way = walked(points)
    p = resampled(points, size, way, segments)
    p = p - p[:, :1]
    x, y = p[..., 0], p[..., 1]

    def turned(angles: list[float]) -> np.ndarray:
        cos, sin = (np.array([f(a) for a in angles])[:, None] for f in (math.cos, math.sin))
        return np.rint(np.stack([x * cos - y * sin, x * sin + y * cos], axis=2))

    angles = [math.atan2(b, a) for a, b in zip(x[:, -1].tolist(), y[:, -1].tolist())]
    v, vf = turned([-a for a in angles]), turned([math.pi - a for a in angles])[:, ::-1]
    dx, dy = (v[:, -1] - v[:, 0]).T
    return way[:, -1], np.sqrt(dx * dx + dy * dy), v, vf - np.stack([vf[..., 0].min(axis=1), np.zeros(len(vf))], axis=1)[:, None]


def types(points: np.ndarray, size: np.ndarray, center: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """``sides.side_type`` of whole batches: the same sums in the same order."""
    a, b = points[:, 0], points[:, -1]
    dx, dy = (b - a).T
    length = np.sqrt(dx * dx + dy * dy)
    at = np.arange(points.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        off = (dx[:, None] * (points[..., 1] - a[:, 1:]) - dy[:, None] * (points[..., 0] - a[:, :1])) / length[:, None]
        middle = np.cumsum(np.where((at >= size[:, None] // 4) & (at < 3 * size[:, None] // 4), off, 0.0), axis=1)[:, -1] / (3 * size // 4 - size // 4)
        own = (dx * (center[:, 1] - a[:, 1]) - dy * (center[:, 0] - a[:, 0])) / length
        return np.where(edge | (size < 3) | (length < 1), "F", np.where(own * middle < 0, "T", "B"))


def lists(values: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An array of any number of axes as nested lists."""
    out = pa.array(values.reshape(-1)) if kind is None else pa.array(values.reshape(-1), from_pandas=True).cast(kind)
    for width in values.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, width, dtype=np.int32)), out)
    return out


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matrix's few true cells, its width a multiple of eight: words first."""
    cells = mask.reshape(-1).view(np.uint64)
    words = np.flatnonzero(cells)
    at = np.flatnonzero(cells.take(words).view(bool))
    return np.divmod(words.take(at >> 3) * 8 + (at & 7), mask.shape[1])


class Pieces:
    """Pieces of one signature as arrays."""

    def __init__(self, t: pa.Table) -> None:
        t = t.combine_chunks()
        flat = lambda c: t.column(c).combine_chunks().flatten()
        self.id = t.column("piece_id").to_numpy()
        self.edge = flat("is_edge").to_numpy(zero_copy_only=False).astype(bool).reshape(-1, 4)
        self.chord = flat("chord").to_numpy().reshape(-1, 4)
        self.profile = flat("profile").flatten().to_numpy().reshape(len(t), 4, -1)
        n = self.profile.shape[2]
        cuts = np.linspace(0, n, PARTS + 1).astype(int)
        # length-preserving projection: sums over runs by the root of their sizes
        self.feature = (np.add.reduceat(self.profile, cuts[:-1], axis=2) / np.sqrt(np.diff(cuts))).astype(np.float32)
        self.mask = self.edge @ (1 << np.arange(4))


def leaves(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers cut in halves along the key (column) that varies most, until at most ``size`` are together."""
    todo, out = [np.arange(len(keys))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        order = np.argpartition(keys[at, keys[at].std(axis=0).argmax()], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _axes(x: np.ndarray) -> np.ndarray:
    """The directions (sides, AXES, parts) in which each side's features vary most."""
    d = x - x.mean(axis=0)
    return np.linalg.eigh(np.einsum("nsi,nsj->sij", d, d))[1].transpose(0, 2, 1)[:, : -AXES - 1 : -1]


def _near(x: np.ndarray, y: np.ndarray, rmse: float, points: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of x and y (later ones only, if they are the same) whose features (rows, sides, parts) may be within the error, and some more.

    Neighbours in x form leaves; only what is within the error of a leaf's box, side by side, is held against it.
    """
    axes = _axes(y)
    p, q = (np.einsum("nsi,sai->nsa", v, axes).reshape(len(v), -1) for v in (x, y))
    reach = math.sqrt(points) * rmse * 1.001 + 1e-4 * (1 + max(np.abs(p).max(), np.abs(q).max()))
    limit = x.shape[1] * points * rmse * rmse
    x, y = x.reshape(len(x), -1), y.reshape(len(y), -1)
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    limit = np.float32(limit * 1.001 + 1e-5 * (1 + xx.max() + yy.max()))
    columns = np.ascontiguousarray(q.T)
    for rows in leaves(p, TILE):
        low, high = p[rows].min(axis=0) - reach, p[rows].max(axis=0) + reach
        met = None
        for k in np.argsort(high - low):
            c = columns[k] if met is None else columns[k][met]
            inside = np.flatnonzero((c >= low[k]) & (c <= high[k]))
            met = inside if met is None else met[inside]
        if same:
            met = met[met > rows.min()]
        left = -2 * x[rows]
        for j in range(0, len(met), WIDE):
            c = met[j : j + WIDE]
            d = left @ y[c].T
            d += yy[c]
            near = np.zeros((d.shape[0], -(-d.shape[1] // 8) * 8), bool)
            np.less_equal(d, (limit - xx[rows])[:, None], out=near[:, : d.shape[1]])
            r, c_ = hits(near)
            r, c = rows[r], c[c_]
            if same:
                r, c = r[c > r], c[c > r]
            if len(r):
                yield r, c


def alike(x: Pieces, y: Pieces | None, limits: list[tuple[float, float]]) -> dict[str, np.ndarray]:
    """(a, b, stage, rot, total_rmse, n_matching) of pieces of x and y (of x, without y) within the first of some (rmse, ratio) that fits.

    Which pairs are worked out is decided by means over runs of their profiles, which differ by no more than the profiles do.
    """
    same = y is None
    y = x if y is None else y
    rmse, ratio, points = max(m for m, _ in limits), min(r for _, r in limits), x.profile.shape[2]
    rows = []
    for one in np.unique(x.mask):
        for two in np.unique(y.mask):
            if same and one > two:
                continue
            p, q = np.flatnonzero(x.mask == one), np.flatnonzero(y.mask == two)
            for rot in range(4):
                used = [k for k in range(4) if not (one >> k & 1 and two >> (k + rot) % 4 & 1)]
                if not used:
                    continue
                other = [(k + rot) % 4 for k in used]
                for r, c in _near(x.feature[p][:, used], y.feature[q][:, other], rmse, points, same and one == two):
                    for k in range(0, len(r), 4096):
                        rows.append(_worked_out(x, y, p[r[k : k + 4096]], q[c[k : k + 4096]], rot, rmse, ratio))
    if not rows:
        return {c: np.empty(0, t) for c, t in (("a", "i8"), ("b", "i8"), ("stage", "i4"), ("rot", "i4"), ("total_rmse", "f8"), ("n_matching", "i4"))}
    a, b, rot, total, n, worst, low = (np.concatenate(v) for v in zip(*rows))
    stage = np.full(len(a), len(limits) + 1)
    for k, (m, share) in reversed(list(enumerate(limits, 1))):
        stage[(worst <= m) & (low >= share)] = k
    order = np.lexsort((n, rot, total, stage, b, a))
    order = order[stage[order] <= len(limits)]
    first = np.ones(len(order), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    keep = order[first]
    return {"a": a[keep], "b": b[keep], "stage": stage[keep].astype("i4"), "rot": rot[keep].astype("i4"), "total_rmse": total[keep], "n_matching": n[keep].astype("i4")}


def _worked_out(x: Pieces, y: Pieces, i: np.ndarray, j: np.ndarray, rot: int, rmse: float, ratio: float) -> tuple[np.ndarray, ...]:
    """(a, b, rot, total, sides, worst error, least ratio) of pairs within the limits, seen from the smaller id."""
    out = []
    for back in (False, True):
        pick = x.id[i] > y.id[j] if back else x.id[i] < y.id[j]
        s, t, u, v, turn = (y, x, j[pick], i[pick], -rot % 4) if back else (x, y, i[pick], j[pick], rot)
        other = (np.arange(4) + turn) % 4
        skip = s.edge[u] & t.edge[v][:, other]
        e, f = s.chord[u], t.chord[v][:, other]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(skip | (e <= 0) | (f <= 0), 1.0, np.minimum(e, f) / np.maximum(e, f))
        ok = share.min(axis=1) >= ratio
        u, v, skip, share = u[ok], v[ok], skip[ok], share[ok]
        d = s.profile[u] - t.profile[v][:, other]
        err = np.sqrt(np.cumsum(d * d, axis=2)[..., -1] / d.shape[2])
        err[skip] = 0.0
        ok = err.max(axis=1, initial=0.0) <= rmse
        err = err[ok]
        out.append((s.id[u][ok], t.id[v][ok], np.full(len(err), turn), ((err[:, 0] + err[:, 1]) + err[:, 2]) + err[:, 3], (~skip[ok]).sum(axis=1), err.max(axis=1, initial=0.0), share[ok].min(axis=1, initial=1.0)))
    return tuple(np.concatenate(c) for c in zip(*out))
