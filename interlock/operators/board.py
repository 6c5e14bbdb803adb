"""Placing pieces on a board: best-first search along a spiral, greedy partial boards, filling gaps.

The search is ordered and single-threaded by nature: each board is one task, its start corners by turns until
one succeeds, so it scales across boards, not within one.  A state is one placement and a link to the
state it grew from; the cells follow a fixed spiral, so a state's depth gives its cell.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Board sides clockwise from the top, with their steps.
STEPS = ((0, -1), (1, 0), (0, 1), (-1, 0))
Fits = dict[int, tuple[list[tuple[int, int, float]], ...]]
Placed = dict[tuple[int, int], tuple[int, int]]


def spiral(width: int, height: int) -> list[tuple[int, int]]:
    """All cells clockwise from the top left, inwards."""
    out, seen, x, y, d = [], set(), 0, 0, 1
    for _ in range(width * height):
        out.append((x, y))
        seen.add((x, y))
        nx, ny = x + STEPS[d][0], y + STEPS[d][1]
        if not (0 <= nx < width and 0 <= ny < height) or (nx, ny) in seen:
            d = (d + 1) % 4
            nx, ny = x + STEPS[d][0], y + STEPS[d][1]
        x, y = nx, ny
    return out


def border_sides(x: int, y: int, width: int, height: int) -> set[int]:
    return {s for s, on in enumerate((y == 0, x == width - 1, y == height - 1, x == 0)) if on}


def side_of(board_side: int, orientation: int) -> int:
    """Which side of a piece looks to a side of the board."""
    return (board_side - orientation) % 4


def fits_cell(fits: Fits, placed: Placed, piece: int, x: int, y: int, turn: int, width: int, height: int, relaxed: bool = False) -> bool:
    """Flat sides on the border and (unless relaxed) only there, and every placed neighbour among the fits of the side facing it."""
    if not (0 <= x < width and 0 <= y < height) or (x, y) in placed:
        return False
    flat = border_sides(x, y, width, height)
    for s, (dx, dy) in enumerate(STEPS):
        listed = fits[piece][side_of(s, turn)]
        if s in flat:
            if listed:
                return False
            continue
        if not listed and not relaxed:
            return False
        neighbour = placed.get((x + dx, y + dy))
        if neighbour is not None and neighbour[0] not in {f[0] for f in listed}:
            return False
    return True


def corner_turn(fits: tuple[list, ...]) -> int:
    """The orientation that puts two adjacent flat sides to the left and the top."""
    for turn in (0, 1, 2, 3):
        if not fits[side_of(3, turn)] and not fits[side_of(0, turn)]:
            return turn
    raise ValueError("not a corner piece")


def corners_and_edges(fits: Fits) -> tuple[list[int], list[int]]:
    """Corners by number of fits, most first, then id; and all pieces with a flat side."""
    flat = {p: sum(not s for s in f) for p, f in fits.items()}
    corners = sorted((p for p, n in flat.items() if n > 1), key=lambda p: (-sum(map(len, fits[p])), p))
    return corners, sorted(p for p, n in flat.items() if n)


def _search(fits: Fits, start: int, width: int, height: int) -> Iterator[Placed | None]:
    """The steps of a best-first search from a corner: None for each state that is expanded, at last the full board, if there is one.

    The state whose last fit is best comes first; ties: fewer placed first, then the state made first.  It ends when all states are
    expanded.  A cell takes only pieces with as many flat sides as it has on the border, so without enough of them there is no board.
    """
    cells = spiral(width, height)
    flat = Counter(sum(not s for s in f) for p, f in fits.items() if p != start)
    if Counter(len(border_sides(x, y, width, height)) for x, y in cells[1:]) - flat:
        return
    states: list[tuple[int, int, int]] = [(-1, start, corner_turn(fits[start]))]
    heap = [(0.0, 1, 0)]
    line: list[int] = []  # the states of the board as it lies, by depth
    placed: Placed = {}
    used: set[int] = set()
    while heap:
        _, depth, k = heapq.heappop(heap)
        fresh, at, d = [], k, depth
        while d > len(line) or (d and line[d - 1] != at):
            fresh.append(at)
            at, d = states[at][0], d - 1
        for gone in range(len(line) - 1, d - 1, -1):  # only what differs from the last board is laid again
            used.remove(placed.pop(cells[gone])[0])
        del line[d:]
        for at in reversed(fresh):
            placed[cells[len(line)]] = states[at][1:]
            used.add(states[at][1])
            line.append(at)
        if depth == width * height:
            yield placed
            return
        piece, turn = states[k][1:]
        (x, y), (px, py) = cells[depth], cells[depth - 1]
        way = STEPS.index((x - px, y - py))
        for other, side, err in fits[piece][side_of(way, turn)]:
            t = (way + 2 - side) % 4
            if other in fits and other not in used and fits_cell(fits, placed, other, x, y, t, width, height):
                states.append((k, other, t))
                heapq.heappush(heap, (err, depth + 1, len(states) - 1))
        yield None


def solve(fits: Fits, starts: list[int], width: int, height: int) -> Placed | None:
    """A full board from one of some corners; None only if there is none from any of them.

    The corners take turns: at first each as many steps as the board has cells, then twice as many each round, going on where it stopped.
    So no search is given up, and one that runs long keeps no other from its turn.
    """
    searches, steps = [_search(fits, start, width, height) for start in starts], width * height
    while searches:
        going = []
        for search in searches:
            taken = 0
            for placed in islice(search, steps):
                if placed is not None:
                    return placed
                taken += 1
            if taken == steps:
                going.append(search)
        searches, steps = going, 2 * steps
    return None


def solve_from(fits: Fits, start: int, width: int, height: int) -> Placed | None:
    """A full board from a corner; None if there is none."""
    return solve(fits, [start], width, height)


def fill(fits: Fits, placed: Placed, width: int, height: int) -> Placed:
    """Empty cells filled row by row, again until nothing changes: the unused piece all placed neighbours list, with the least total error."""
    placed = dict(placed)
    used = {p for p, _ in placed.values()}
    changed = True
    while changed:
        changed = False
        for y in range(height):
            for x in range(width):
                if (x, y) in placed:
                    continue
                votes: dict[tuple[int, int], list[float]] = defaultdict(list)
                asked = 0
                for s, (dx, dy) in enumerate(STEPS):
                    if (n := placed.get((x + dx, y + dy))) is None or not (listed := fits[n[0]][side_of((s + 2) % 4, n[1])]):
                        continue
                    asked += 1
                    best: dict[tuple[int, int], float] = {}
                    for other, side, err in listed:
                        key = other, (s - side) % 4
                        best[key] = min(err, best.get(key, err))
                    for key, err in best.items():
                        votes[key].append(err)
                ok = sorted((sum(e), p, t) for (p, t), e in votes.items() if len(e) == asked and p in fits and p not in used)
                for _, p, t in ok:
                    if fits_cell(fits, placed, p, x, y, t, width, height, relaxed=True):
                        placed[x, y] = (p, t)
                        used.add(p)
                        changed = True
                        break
    return placed


def solve_partial(fits: Fits, width: int, height: int, starts: int = 2) -> Placed:
    """The larger of greedy boards from the best corners: the border walked with the best fit at each step, the inside filled."""
    corners, edges = corners_and_edges(fits)
    best: Placed = {}
    for start in (corners or edges or sorted(fits))[:starts]:
        try:
            turn = corner_turn(fits[start])
        except ValueError:
            turn = 0
        placed: Placed = {(0, 0): (start, turn)}
        cells = spiral(width, height)[: max(1, 2 * (width + height) - 4)]
        for (px, py), (x, y) in zip(cells, cells[1:]):
            if (px, py) not in placed:
                break
            piece, t = placed[px, py]
            way = STEPS.index((x - px, y - py))
            used = {p for p, _ in placed.values()}
            for other, side, _ in sorted(fits[piece][side_of(way, t)], key=lambda f: (f[2], f[0], f[1])):
                o = (way + 2 - side) % 4
                if other in fits and other not in used and fits_cell(fits, placed, other, x, y, o, width, height):
                    placed[x, y] = (other, o)
                    break
        placed = fill(fits, placed, width, height)
        if len(placed) > len(best):
            best = placed
    return best


def spread(df: DataFrame, by: str) -> DataFrame:
    """Rows dealt out by a key to a stated number of tasks: the planner would put groups of few rows into one task, however long the work on each."""
    return df.repartition(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by)


_SCHEMA = "board_id long, piece_id long, x int, y int, orientation int, complete boolean"


def solve_boards(pieces: DataFrame, fits: DataFrame, sizes: DataFrame) -> DataFrame:
    """(board_id, piece_id, x, y, orientation, complete) of each board.

    ``pieces`` (board_id, piece_id), ``fits`` (board_id, piece_id, side, other_piece, other_side, err), ``sizes`` (board_id, width,
    height).  A board with four corners and all its pieces is tried from its corners by turns, that of most fits first, until one
    succeeds or no state of any is left, however long that takes.  Else the partial board is given.
    """
    edges = fits.select("board_id", "piece_id", "side", "other_piece", "other_side", F.col("err").cast("double").alias("err"))
    alone = pieces.select("board_id", "piece_id", F.lit(None).cast("int").alias("side"), F.lit(None).cast("long").alias("other_piece"), F.lit(None).cast("int").alias("other_side"), F.lit(None).cast("double").alias("err"))
    rows = edges.unionByName(alone).join(sizes, "board_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph: dict[int, tuple[list, ...]] = {int(p): ([], [], [], []) for p in pdf["piece_id"].unique()}
        for p, s, o, t, e in pdf[["piece_id", "side", "other_piece", "other_side", "err"]].dropna().itertuples(index=False):
            graph[int(p)][int(s)].append((int(o), int(t), float(e)))
        for listed in graph.values():
            for side in listed:
                side.sort(key=lambda f: (f[2], f[0], f[1]))
        board, width, height = (int(pdf[c].iloc[0]) for c in ("board_id", "width", "height"))
        corners, _ = corners_and_edges(graph)
        whole = len(corners) == 4 and len(graph) >= width * height
        beside = lambda f: any(not f[s] and not f[s - 1] for s in range(4))
        placed = solve(graph, [c for c in corners if beside(graph[c])], width, height) if whole else None
        complete = placed is not None
        if placed is None:
            placed = solve_partial(graph, width, height)
        out = [(board, p, x, y, t, complete) for (x, y), (p, t) in placed.items()]
        return pd.DataFrame(out, columns=["board_id", "piece_id", "x", "y", "orientation", "complete"])

    return spread(rows, "board_id").groupBy("board_id").applyInPandas(run, _SCHEMA)


def first_open_cell(placed: Placed, fits: Fits, piece: int, width: int, height: int) -> tuple[int, int, int] | None:
    """The first empty cell, row by row, and turn in which a new piece can lie."""
    for y in range(height):
        for x in range(width):
            for turn in range(4):
                if (x, y) not in placed and fits_cell(fits, placed, piece, x, y, turn, width, height):
                    return x, y, turn
    return None


def generated_puzzle(width: int, height: int, seed: int = 0, noise: int = 2) -> tuple[list[tuple], list[tuple]]:
    """A puzzle with a known answer: (piece, side, other, other side, err) of true and some false fits, and (piece, x, y, turn)."""
    import random

    r = random.Random(seed)
    ids = r.sample(range(1, 10 * width * height), width * height)
    at = {(x, y): (ids[y * width + x], r.randrange(4)) for y in range(height) for x in range(width)}
    first, turn = at[0, 0]
    fits = []
    inner = [(p, side_of(s, t)) for (x, y), (p, t) in at.items() for s in range(4) if s not in border_sides(x, y, width, height)]
    for (x, y), (p, t) in at.items():
        for s, (dx, dy) in enumerate(STEPS):
            if (x + dx, y + dy) in at:
                q, u = at[x + dx, y + dy]
                fits.append((p, side_of(s, t), q, side_of((s + 2) % 4, u), 0.1 + 0.1 * r.random()))
                fits += [(p, side_of(s, t), o, os, 0.5 + r.random()) for o, os in r.sample(inner, min(noise, len(inner))) if o != p]
    return fits, [(p, x, y, t) for (x, y), (p, t) in at.items()]
