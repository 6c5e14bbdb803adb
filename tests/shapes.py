"""Generated outlines for the tests."""

from __future__ import annotations

import datetime as dt
import math
import random

SIDES = "piece_id long, side_index int, vertices array<array<int>>, piece_center array<int>, is_edge boolean, original_photo_name string, photo_space_centroid array<double>, photo_width int, photo_height int, batch_id long, ingested_at timestamp_ntz"


def outline(seed: int, points: int = 40, jitter: int = 0, jitter_seed: int = 0) -> list[list[int]]:
    """A smooth random outline from (100, 100) to (500, 100); jitter moves its inner vertices."""
    r, q = random.Random(seed), random.Random(jitter_seed)
    waves = [(r.uniform(-60, 60), r.uniform(0, 6), k) for k in range(1, 5)]
    out = []
    for i in range(points):
        u = i / (points - 1)
        y = sum(a * math.sin(math.pi * k * u + p) for a, p, k in waves) * math.sin(math.pi * u)
        move = 0 < i < points - 1
        out.append([round(100 + 400 * u) + (q.randint(-jitter, jitter) if move else 0), round(100 + y) + (q.randint(-jitter, jitter) if move else 0)])
    return out


def piece(pid: int, seeds: list[int], batch: int = 1, turn: int = 0, jitter: int = 0, **more) -> list[tuple]:
    """Four side rows of a piece; ``turn`` shifts which outline has which index."""
    at = dt.datetime(2026, 1, 1)
    rows = []
    for k in range(4):
        s = seeds[(k + turn) % 4]
        v = outline(s, jitter=jitter, jitter_seed=pid * 7 + k)
        rows.append((pid, k, v, more.get("center", [300, 300]), more.get("edge", False), more.get("photo", "a.jpg"), more.get("centroid", [10.0, 10.0]), more.get("width", 100), more.get("height", 100), batch, at))
    return rows
