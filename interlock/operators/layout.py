"""Moving solved pieces into place: turn and shift each so that its sides meet those already placed.

A board is an ordered fold (each piece leans on earlier ones), so one group is one task; boards
are independent of each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from interlock.operators.board import STEPS, side_of, spiral

_SCHEMA = "board_id long, piece_id long, x int, y int, dest_x double, dest_y double, turn double"


def _chord(points: np.ndarray) -> float:
    return float(np.arctan2(*(points[-1] - points[0])[::-1]))


def laid_out(cells: dict[tuple[int, int], tuple[int, int]], sides: dict[int, list[np.ndarray]], centres: dict[int, np.ndarray], width: int, height: int) -> dict[int, tuple[float, float, float]]:
    """Per piece where its centre goes and its turn in radians; empty cells are passed over.

    Walls stand in for neighbours at the top and left border.  A piece's turn is the circular mean of
    what each placed neighbour asks for, its shift the mean over their side ends.
    """
    done: dict[tuple[int, int], list[np.ndarray]] = {}
    out: dict[int, tuple[float, float, float]] = {}
    for x, y in spiral(width, height):
        if (x, y) not in cells:
            continue
        piece, o = cells[x, y]
        own = [sides[piece][side_of(s, o)].astype(float) for s in range(4)]
        asks = []
        for s, (dx, dy) in enumerate(STEPS):
            if (x + dx, y + dy) in done:
                asks.append((s, done[x + dx, y + dy][(s + 2) % 4][::-1]))
        walls = [(s, line) for s, on, line in ((0, y == 0, np.array([[0.0, 0.0], [1.0, 0.0]])), (3, x == 0, np.array([[0.0, 1.0], [0.0, 0.0]]))) if on]
        ways = [_chord(line) - _chord(own[s]) for s, line in asks + walls]
        turn = float(np.angle(np.exp(1j * np.array(ways)).mean())) if ways else 0.0
        c, k = np.cos(turn), np.sin(turn)
        centre = centres[piece].astype(float)
        turned = [(p - centre) @ np.array([[c, k], [-k, c]]) for p in own]
        moves = [np.array([line[0] - turned[s][0], line[-1] - turned[s][-1]]).mean(axis=0) for s, line in asks]
        at = np.mean(moves, axis=0) if moves else np.zeros(2)
        if x == 0:
            at[0] = np.mean([*[m[0] for m in moves], -turned[3][:, 0].mean()]) if y else -turned[3][[0, -1], 0].mean()
        if y == 0:
            at[1] = np.mean([*[m[1] for m in moves], -turned[0][[0, -1], 1].mean()]) if x else -turned[0][[0, -1], 1].mean()
        done[x, y] = [p + at for p in turned]
        out[piece] = (float(at[0]), float(at[1]), turn)
    return out


def layout(placed: DataFrame, sides: DataFrame, sizes: DataFrame) -> DataFrame:
    """(board_id, piece_id, x, y, dest_x, dest_y, turn) of every placed piece with four sides."""
    s = sides.select("piece_id", "side_index", "vertices", "incenter")
    rows = placed.select("board_id", "piece_id", "x", "y", "orientation").join(s, "piece_id").join(sizes, "board_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        line, centre, cells = {}, {}, {}
        for p, g in pdf.groupby("piece_id"):
            if len(g) != 4:
                continue
            g = g.sort_values("side_index")
            line[p] = [np.array([list(v) for v in vs]) for vs in g["vertices"]]
            centre[p] = np.array(list(g["incenter"].iloc[0]))
            cells[int(g["x"].iloc[0]), int(g["y"].iloc[0])] = (p, int(g["orientation"].iloc[0]))
        where = {p: c for c, (p, _) in cells.items()}
        got = laid_out(cells, line, centre, int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0]))
        return pd.DataFrame([(int(pdf["board_id"].iloc[0]), p, *where[p], *v) for p, v in got.items()], columns=["board_id", "piece_id", "x", "y", "dest_x", "dest_y", "turn"])

    return rows.groupBy("board_id").applyInPandas(run, _SCHEMA)
