"""Array work of ``match.fit_errors``: sides that fit within an error, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from interlock.operators.alike import hits, leaves

#: Rows and columns of one tile; the matrices of a tile stay in the processor's cache.
TILE, WIDE = 32, 16384
#: Sides in a box, and in one around many boxes; boxes serve limits so many times smaller than what the sums spread over.
BOX, GROUP, SMALL = 64, 1024, 4
#: Points of a side are summed in this many runs for the bound; differences of these pairs of x sums don't change with a shift.
RUNS, PAIRS = 9, ((0, 4), (1, 5), (2, 6), (3, 8))
#: Sums are cut off here, so that the differences of all of them add up within 16 bits; that lowers the bound only.
CUT = 32767 // (2 * (RUNS + len(PAIRS)))
#: Pairs that are worked out at once.
PART = 8192
#: ``some`` cuts sides into neighbourhoods of at most this many, along this many turned directions, so many times.
NEIGHBOURS, TURNS, ROUNDS = 1024, 8, 5


def pack(*lines: pa.Array) -> pa.Array:
    """Lists of as many [x, y] each, several a row, as bytes: each list's first point and the steps from there in 8 bits a number, where a row's steps fit, else all numbers in 16 bits or 64."""
    n = len(lines[0])
    return pack_numbers(*[c.flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in lines])


def pack_numbers(*lines: np.ndarray) -> pa.Array:
    """``pack`` of arrays, a row a list."""
    n = len(lines[0])
    if not n:
        return pa.array([], pa.binary())
    values = np.stack([c.reshape(n, -1, 2) for c in lines], axis=1).astype("<i8")
    if len(lines) == 2:  # nearly all zeros or one number, which the shuffle packs well
        values[:, 1] += values[:, 0, ::-1]
    steps, first = np.diff(values, axis=2), values[:, :, 0]
    most = np.abs(values).reshape(n, -1).max(axis=1)
    short = (np.abs(steps).reshape(n, -1).max(axis=1, initial=0) <= 127) & (most <= 1 << 30)
    size, numbers = steps[0].size + 4 * first[0].size, values[0].size
    width = np.where(short, size, np.where(most <= 32767, 2 * numbers, 8 * numbers))
    ends = np.concatenate([[0], np.cumsum(width)])
    data = np.empty(ends[-1], np.uint8)
    for which, parts in ((short, [(first, "<i4"), (steps, "i1")]), (~short & (most <= 32767), [(values, "<i2")]), (~short & (most > 32767), [(values, "<i8")])):
        at = np.flatnonzero(which)
        if len(at):
            rows = np.concatenate([np.ascontiguousarray(a[at].astype(kind)).reshape(len(at), -1).view(np.uint8) for a, kind in parts], axis=1)
            if len(at) == n:
                data = rows.reshape(-1)
            else:
                data[ends[at][:, None] + np.arange(rows.shape[1])] = rows
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def unpack(packed: pa.Array, lines: int, points: int) -> list[np.ndarray]:
    """The arrays (rows, points, 2) of ``pack``."""
    if not len(packed):
        return [np.empty((0, points, 2), np.int64)] * lines
    numbers, ends = lines * points * 2, np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :][: len(packed) + 1]
    data, width = np.frombuffer(packed.buffers()[2], np.uint8), np.diff(ends)
    out = np.empty((len(packed), lines, points, 2), np.int64)
    heads = 8 * lines  # bytes of the first points
    for size in {heads + numbers - 2 * lines, 2 * numbers, 8 * numbers}:
        at = np.flatnonzero(width == size)
        if not len(at):
            continue
        rows = data[ends[0] : ends[-1]].reshape(-1, size) if len(at) == len(packed) else data[ends[at][:, None] + np.arange(size)]
        if size >= 2 * numbers:
            out[at] = np.ascontiguousarray(rows).view("<i2" if size == 2 * numbers else "<i8").reshape(len(at), lines, points, 2)
        else:
            first = np.ascontiguousarray(rows[:, :heads]).view("<i4").reshape(len(at), lines, 1, 2)
            steps = np.ascontiguousarray(rows[:, heads:]).view("i1").reshape(len(at), lines, points - 1, 2)
            out[at] = np.cumsum(np.concatenate([first, steps], axis=2, dtype=np.int64), axis=2)
    if lines == 2:
        out[:, 1] -= out[:, 0, ::-1]
    return [out[:, k] for k in range(lines)]


class Sides:
    """Sides of one block in order of their chords: ``v`` is held against others' ``w``."""

    def __init__(self, t: pa.Table, points: int, lines: int) -> None:
        t = t.combine_chunks().sort_by("chord")
        column = lambda c: t.column(c).to_numpy()
        self.id, self.side, self.chord, self.arc = (column(c) for c in ("piece_id", "side", "chord", "arc"))
        both = unpack(t.column("line").combine_chunks(), lines, points)
        self.v, self.w = both[0].astype(float), both[-1].astype(float)
        turn = t.column("turn").combine_chunks()
        self.turn = turn.flatten().to_numpy().reshape(len(t), -1) if len(t) else np.empty((0, 0), np.int64)
        self.vx, self.vy, self.wx, self.wy = (np.ascontiguousarray(a[..., k], np.float32) for a in (self.v, self.w) for k in (0, 1))


def _sums(lines: np.ndarray) -> np.ndarray:
    """The sums of the bound, one row each: y over runs, and differences of x over runs of the same length."""
    cuts = np.linspace(0, lines.shape[1], RUNS + 1).astype(int)
    x, y = np.add.reduceat(lines, cuts[:-1], axis=1).transpose(2, 1, 0)
    n = np.diff(cuts)
    return np.concatenate([y, [np.minimum(n[a], n[b]) * (x[a] / n[a] - x[b] / n[b]) for a, b in PAIRS]])


def _whole(sums: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(sums - middle), -CUT, CUT).astype(np.int16)


def _asymmetry(s: Sides) -> float:
    """How far a side seen from the other piece is from the same turned half round, by rounding."""
    d = s.w[:, ::-1] + s.v
    d[..., 0] -= np.median(d[..., 0], axis=1)[:, None]
    return float(np.abs(d).sum(axis=(1, 2)).max(initial=0.0))


def near(x: Sides, y: Sides, error_max: float, y_max: float, gap: float, mutual: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all sides of x and y that may fit, and some more; with ``mutual`` either way round, and for x = y later rows of y only.

    An error within the limit means that coordinates differ by no more than the limit times the arc in all, but for a shift of x and one of
    y between 0 and ``y_max``.  Sums over runs differ by no more than their coordinates.
    """
    if not len(x.id) or not len(y.id):
        return
    f, g, tx, ty = _bounds(x, y, error_max, y_max, mutual)
    if not mutual and ty.mean() * SMALL < f.std(axis=1).sum():
        yield from _boxed(f, g, ty, x, y, gap)
        return
    one, total = np.empty(TILE * WIDE, np.int16), np.empty(TILE * WIDE, np.int16)
    low = np.searchsorted(y.chord, x.chord * (1 - gap - 1e-9))
    high = np.searchsorted(y.chord, x.chord / (1 - gap - 1e-9), "right") if gap < 1 else np.full(len(x.id), len(y.id))
    for i in range(0, len(x.id), TILE):
        n = min(TILE, len(x.id) - i)
        start, end = max(low[i], i) if x is y else low[i], high[i + n - 1]
        for j in range(start, end, WIDE):
            m = min(WIDE, end - j)
            d, s = (a[: n * m].reshape(n, m) for a in (one, total))
            for r in range(len(f)):
                into = d if r else s
                np.subtract(f[r, i : i + n, None], g[r, j : j + m], out=into)
                np.abs(into, out=into)
                if r:
                    np.add(s, d, out=s)
            close = np.zeros((n, -(-m // 8) * 8), bool)
            np.less_equal(s, ty[j : j + m], out=close[:, :m])
            if mutual:
                close[:, :m] |= s <= tx[i : i + n, None]
            r, c = hits(close)
            r, c = r + i, c + j
            keep = x.id[r] != y.id[c]
            if x is y:
                keep &= c > r
            yield r[keep], c[keep]


def _bounds(x: Sides, y: Sides, error_max: float, y_max: float, mutual: bool) -> tuple[np.ndarray, ...]:
    """The sums of x and y, a row each, and by how much they may differ in all."""
    points, slip = x.v.shape[1], y_max // 2
    slack = points * max(slip, y_max - slip) + RUNS + len(PAIRS)
    f, g = _sums(x.v), _sums(y.w)
    middle = np.rint(g.mean(axis=1, keepdims=True))
    f[:RUNS] -= slip * np.diff(np.linspace(0, points, RUNS + 1).astype(int))[:, None]
    slack += _asymmetry(x) + _asymmetry(y) if mutual else 0.0
    return _whole(f, middle), _whole(g, middle), *(np.minimum(error_max * s.arc + slack, 32767).astype(np.int16) for s in (x, y))


def _boxed(f: np.ndarray, g: np.ndarray, ty: np.ndarray, x: Sides, y: Sides, gap: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``near`` one way, for a limit that is small against the sums: neighbours in x are held only against what is near a box around them."""
    keys = _keys(f, x.chord)
    for group in leaves(keys, GROUP):
        some = _met(f, g, ty, x, y, group, np.arange(len(y.id)), gap)
        for rows in leaves(keys[group], BOX):
            rows = group[rows]
            for r, c in _close(f, g, ty, rows, _met(f, g, ty, x, y, rows, some, gap)):
                keep = x.id[r] != y.id[c]
                yield r[keep], c[keep]


def _keys(sums: np.ndarray, chord: np.ndarray) -> np.ndarray:
    """What neighbours are chosen by, a row a side: the sums, and the chord weighed so that it is cut a few times."""
    by = 2 * sums.std(axis=1).max() / max(chord.std(), 1e-9)
    return np.concatenate([sums, by * chord[None]]).T.astype(np.float32)


def _met(f: np.ndarray, g: np.ndarray, ty: np.ndarray, x: Sides, y: Sides, rows: np.ndarray, cols: np.ndarray, gap: float) -> np.ndarray:
    """Those of ``cols`` that may fit any of ``rows`` by the box around the rows' sums and chords."""
    chord, least, most = y.chord[cols], x.chord[rows].min(), x.chord[rows].max()
    inside = chord >= least * (1 - gap - 1e-9)
    if gap < 1:
        inside &= chord <= most / (1 - gap - 1e-9)
    cols = cols[inside]
    if not len(cols):
        return cols
    here, total = g.take(cols, axis=1), np.zeros(len(cols), np.int16)
    for k in range(len(f)):
        d = np.minimum(np.maximum(here[k], f[k, rows].min()), f[k, rows].max())
        np.subtract(here[k], d, out=d)
        total += np.abs(d, out=d)
    return cols[total <= ty[cols]]


def _close(f: np.ndarray, g: np.ndarray, ty: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``rows`` and ``cols`` whose sums differ by no more than they may."""
    own, wide = f.take(rows, axis=1), max(TILE * WIDE // len(rows), 1)
    room = np.empty((2, len(rows) * min(wide, len(cols))), np.int16)
    for j in range(0, len(cols), wide):
        at = cols[j : j + wide]
        n, m = len(rows), len(at)
        other = g.take(at, axis=1)
        s, d = (a[: n * m].reshape(n, m) for a in room)
        for k in range(len(f)):
            into = d if k else s
            np.subtract(own[k, :, None], other[k], out=into)
            np.abs(into, out=into)
            if k:
                np.add(s, d, out=s)
        close = np.zeros((n, -(-m // 8) * 8), bool)
        np.less_equal(s, ty[at], out=close[:, :m])
        r, c = hits(close)
        if len(r):
            yield rows[r], at[c]


def error(v: np.ndarray, w: np.ndarray, arc: np.ndarray, y_max: float) -> np.ndarray:
    """The error of pairs; the same as ``match.polyline_error``."""
    d = v - w
    size = np.abs(d)
    shift = (size - d).mean(axis=1)
    shift[:, 1] = np.clip(shift[:, 1], -y_max, y_max)
    return np.minimum(size.sum(axis=(1, 2)), np.abs(d - shift[:, None]).sum(axis=(1, 2))) / arc


def _closer(x: Sides, y: Sides, i: np.ndarray, j: np.ndarray, error_max: float, y_max: float, uneven: float | None) -> np.ndarray:
    """Of pairs those that stay within the limit by all points: y but for its shift, and differences of x half a side apart, which a shift leaves."""
    d = x.vy.take(i, axis=0)  # several times as fast as x.vy[i]
    d -= y.wy.take(j, axis=0)
    d -= np.float32(y_max / 2)
    np.abs(d, out=d)
    n = d.shape[1]
    low = d @ np.ones(n, np.float32)
    arc = y.arc[j] if uneven is None else np.maximum(x.arc[i], y.arc[j])
    limit = error_max * arc * 1.001 + n * (y_max / 2 + 0.01) + (uneven or 0.0)
    at = np.flatnonzero(low <= limit)
    d = x.vx.take(i[at], axis=0)
    d -= y.wx.take(j[at], axis=0)
    half = n // 2
    e = d[:, :half] - d[:, n - half :]
    np.abs(e, out=e)
    return at[low[at] + e @ np.ones(half, np.float32) <= limit[at]]


def _about(s: Sides, t: Sides, a: np.ndarray, b: np.ndarray, y_max: float) -> np.ndarray:
    """The error of pairs times the arc, in 32-bit floats."""
    ones = np.ones(s.vx.shape[1], np.float32)
    plain, moved = np.float32(0), np.float32(0)
    for v, w, most in ((s.vx, t.wx, np.inf), (s.vy, t.wy, y_max)):
        d = v.take(a, axis=0)
        d -= w.take(b, axis=0)
        size = np.abs(d) @ ones
        plain = plain + size
        d -= np.minimum((size - d @ ones) / len(ones), np.float32(most))[:, None]
        moved = moved + np.abs(d, out=d) @ ones
    return np.minimum(plain, moved)


def fitting(x: Sides, y: Sides, error_max: float, y_max: float, gap: float, mutual: bool) -> Iterator[pa.RecordBatch]:
    """(piece_id, side, other_piece, other_side, err): sides of x that fit sides of y, with ``mutual`` also those of y that fit x."""
    uneven = _asymmetry(x) + _asymmetry(y) if mutual else None
    big = max(float(np.abs(a).max(initial=0.0)) for s in (x, y) for a in (s.v, s.w)) > 1e5  # too large for 32-bit floats
    kept, waiting = [], 0

    def worked_out() -> Iterator[pa.RecordBatch]:
        i, j = (np.concatenate(c) for c in zip(*kept))
        kept.clear()
        for s, t, a, b in ((x, y, i, j), (y, x, j, i))[: 1 + mutual]:
            ok = np.abs(1 - s.chord[a] / t.chord[b]) <= gap
            if s.turn.shape[1]:
                differ = s.turn[a] != t.turn[b]
                first, row = differ.argmax(axis=1), np.arange(len(a))
                ok &= s.turn[a][row, first] > t.turn[b][row, first]
            if not big:
                ok &= _about(s, t, a, b, y_max) <= error_max * t.arc[b] * 1.001 + 1
            a, b = a[ok], b[ok]
            err = error(s.v.take(a, axis=0), t.w.take(b, axis=0), t.arc[b], y_max)
            ok = err <= error_max
            a, b = a[ok], b[ok]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s.id[a], s.side[a], t.id[b], t.side[b], err[ok])], names=["piece_id", "side", "other_piece", "other_side", "err"])

    for i, j in near(x, y, error_max, y_max, gap, mutual):
        if not big and len(i):
            at = _closer(x, y, i, j, error_max, y_max, uneven)
            i, j = i[at], j[at]
        for k in range(0, len(i), PART):
            kept.append((i[k : k + PART], j[k : k + PART]))
            waiting += len(kept[-1][0])
            if waiting >= PART:
                yield from worked_out()
                waiting = 0
    if waiting:
        yield from worked_out()


def some(x: Sides, error_max: float, y_max: float, gap: float) -> np.ndarray:
    """Which sides of x are found to fit another: only ones that do, most of them, sought among neighbours only."""
    found = np.zeros(len(x.id), bool)
    if not len(x.id):
        return found
    f, g, _, ty = _bounds(x, x, error_max, y_max, False)
    big, random = max(float(np.abs(a).max()) for a in (x.v, x.w)) > 1e5, np.random.default_rng(len(x.id))
    chord = x.chord - x.chord.mean()  # so that like chords, weighed up, don't swamp the sums in 32 bits
    by = f.std(axis=1).max() / max(chord.std(), 1e-9) / 2
    every = np.concatenate([np.concatenate([s, by * chord[None]]) for s in (f, g)], axis=1).astype(np.float32)
    for _ in range(ROUNDS):
        asked = np.flatnonzero(~found)
        keys = random.normal(size=(TURNS, len(every))).astype(np.float32) @ every[:, np.concatenate([asked, len(x.id) + np.arange(len(x.id))])]
        todo = [(np.arange(keys.shape[1]), 0)]
        while todo:
            at, depth = todo.pop()
            if len(at) > NEIGHBOURS:
                order = np.argpartition(keys[depth % TURNS, at], len(at) // 2)
                todo += [(at[order[: len(at) // 2]], depth + 1), (at[order[len(at) // 2 :]], depth + 1)]
                continue
            rows, cols = asked[at[at < len(asked)]], at[at >= len(asked)] - len(asked)
            s, close = np.zeros((len(rows), len(cols)), np.int16), np.zeros((len(rows), -(-len(cols) // 8) * 8), bool)
            d = np.empty_like(s)
            for a, b in zip(f.take(rows, axis=1), g.take(cols, axis=1)):
                np.subtract(a[:, None], b, out=d)
                np.abs(d, out=d)
                np.add(s, d, out=s)
            np.less_equal(s, ty[cols], out=close[:, : len(cols)])
            i, j = hits(close) if close.size else (np.empty(0, int), np.empty(0, int))
            i, j = rows[i], cols[j]
            ok = (x.id[i] != x.id[j]) & (np.abs(1 - x.chord[i] / x.chord[j]) <= gap)
            i, j = i[ok], j[ok]
            if not big and len(i):
                ok = _closer(x, x, i, j, error_max, y_max, None)
                i, j = i[ok], j[ok]
                ok = _about(x, x, i, j, y_max) <= error_max * x.arc[j] * 1.001 + 1
                i, j = i[ok], j[ok]
            found[i[error(x.v.take(i, axis=0), x.w.take(j, axis=0), x.arc[j], y_max) <= error_max]] = True
    return found
