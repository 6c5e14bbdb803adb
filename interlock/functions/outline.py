"""Packed outlines and side vectors.

An outline is a list of integer vertices.  For a shuffle it is packed into a marker
byte and the steps between successive vertices, in the narrowest of one, two, four or
eight bytes a coordinate that holds them all; that also removes its place in the photo.

``side_vectors`` gives the 54 numbers of a side: 27 points at equal arc length,
the first at the origin, the last at (1, 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

POINTS = 27
DIMS = 2 * POINTS
#: Array elements in flight at once; bounds the memory of one call.
_CHUNK = 2_000_000
#: Marker bytes and the widths they stand for.
_MARKS = (b"b", b"h", b"i", b"q")
_TYPES = ("<i1", "<i2", "<i4", "<i8")
_LIMITS = np.array([127, 32767, 2**31 - 1])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates (n, 2), row offsets, and which rows are whole outlines.

    A row counts as whole if it has at least two vertices, each of two
    non-null integers.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    filled = column.fill_null([]) if column.null_count else column
    lengths = np.asarray(filled.value_lengths())
    inner = filled.flatten()
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    row_of = np.repeat(np.arange(rows), lengths)
    ok = lengths >= 2
    if len(inner) == 0:
        return np.zeros((0, 2), np.int64), offsets, ok
    width = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    good = width == 2
    values = inner.flatten()
    if values.null_count or not good.all():
        nulls = np.asarray(values.is_null())
        starts = np.concatenate([[0], np.cumsum(width)[:-1]]).astype(np.int64)
        numbers = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(numbers) == 0:
            numbers, nulls = np.zeros(2, np.int64), np.zeros(2, bool)
        at = np.where(good, starts, 0)
        xy = np.stack([numbers[at], numbers[np.minimum(at + 1, len(numbers) - 1)]], axis=1)
        good &= ~(nulls[at] | nulls[np.minimum(at + 1, len(nulls) - 1)])
        ok[row_of[~good]] = False
        xy[~good] = 0
    else:
        xy = values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)
    return xy, offsets, ok


def pack(column: pa.Array) -> list[bytes | None]:
    """One packed outline per row, null where the row is no whole outline."""
    xy, offsets, ok = _flat(column)
    steps = np.diff(xy, axis=0) if len(xy) else xy
    size = np.abs(steps).max(axis=1) if len(steps) else np.zeros(0, np.int64)
    kind_of = np.searchsorted(_LIMITS, size)
    data = [steps.astype(t).tobytes() for t in _TYPES]
    out: list[bytes | None] = []
    for i, fine in enumerate(ok):
        if not fine:
            out.append(None)
            continue
        a, b = offsets[i], offsets[i + 1] - 1
        k = int(kind_of[a:b].max())
        w = 2 << k
        out.append(_MARKS[k] + data[k][a * w : b * w])
    return out


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (n, 2) with every first vertex at the origin, and offsets."""
    lengths = np.array([(len(p) - 1) // (2 << _MARKS.index(p[:1])) for p in packed], np.int64)
    ends = np.cumsum(lengths)
    steps = np.empty((ends[-1] if len(ends) else 0, 2), np.int64)
    marks = np.array([_MARKS.index(p[:1]) for p in packed])
    for k, t in enumerate(_TYPES):
        rows = np.flatnonzero(marks == k)
        if len(rows):
            here = np.frombuffer(b"".join(packed[i][1:] for i in rows), t).reshape(-1, 2)
            if len(rows) == len(packed):
                steps[:] = here
            else:
                n = lengths[rows]
                steps[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[rows] - n, n)] = here
    total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(steps, axis=0)])
    starts = ends - lengths
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
    row_of = np.repeat(np.arange(len(packed)), lengths + 1)
    within = np.arange(offsets[-1]) - offsets[row_of]
    return total[starts[row_of] + within] - total[starts[row_of]], offsets


def side_vectors(packed: list[bytes]) -> np.ndarray:
    """Side vectors (n, 54); a row of NaN where first and last vertex coincide."""
    out = np.full((len(packed), DIMS), np.nan)
    if not len(packed):
        return out
    xy, offsets = unpack(packed)
    counts = np.diff(offsets)
    order = np.argsort(counts, kind="stable")
    at = 0
    while at < len(order):
        longest = counts[order[min(at + 4095, len(order) - 1)]]
        size = max(1, min(4096, _CHUNK // max(1, int(longest))))
        rows = order[at : at + size]
        at += size
        out[rows] = _chunk(xy, offsets[rows], counts[rows])
    return out


def _chunk(xy: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    width = int(counts.max())
    index = np.minimum(np.arange(width)[None, :], counts[:, None] - 1) + starts[:, None]
    x, y = xy[index, 0].astype(float), xy[index, 1].astype(float)
    lengths = np.hypot(np.diff(x, axis=1), np.diff(y, axis=1))
    along = np.concatenate([np.zeros((len(x), 1)), np.cumsum(lengths, axis=1)], axis=1)
    total = along[:, -1]
    targets = total[:, None] * np.arange(POINTS)[None, :] / (POINTS - 1)
    rows = np.arange(len(x))[:, None]
    seg = np.empty(targets.shape, np.int64)
    for k in range(POINTS):
        seg[:, k] = (along <= targets[:, k : k + 1]).sum(axis=1) - 1
    seg = np.clip(seg, 0, np.maximum(counts[:, None] - 2, 0))
    base, span = along[rows, seg], lengths[rows, np.minimum(seg, width - 2)]
    share = np.where(span > 0, (targets - base) / np.where(span > 0, span, 1), 0)
    share = np.clip(share, 0, 1)
    nxt = np.minimum(seg + 1, width - 1)
    px = x[rows, seg] + share * (x[rows, nxt] - x[rows, seg])
    py = y[rows, seg] + share * (y[rows, nxt] - y[rows, seg])
    last = np.arange(len(x)), counts - 1
    px[:, -1], py[:, -1] = x[last], y[last]
    px, py = px - px[:, :1], py - py[:, :1]
    chord = px[:, -1] ** 2 + py[:, -1] ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        c, s = px[:, -1:] / chord[:, None], py[:, -1:] / chord[:, None]
        u, v = px * c + py * s, py * c - px * s
    vec = np.stack([u, v], axis=2).reshape(len(x), DIMS)
    vec[chord == 0] = np.nan
    return vec


def side_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of vectors in the last axis, to six decimals."""
    d = a - b
    return np.round(np.sqrt(np.einsum("...i,...i->...", d, d)), 6)
