"""Matching pieces to the cells of a target picture by colour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlock.operators.match import correlation, top_matches
from interlock.raster.kernels import histogram_hsv

_CELL = "photo_id string, col int, row int, center_color array<double>, h array<double>, top array<double>, right array<double>, bottom array<double>, left array<double>"


def cells(images: DataFrame, width: int, height: int, band: int = 5) -> DataFrame:
    """One row a cell of each picture cut into ``width`` x ``height``: mean of its middle, hue histogram, means of its four borders."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)
                a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]
                for y in range(height):
                    for x in range(width):
                        c = a[y * r.height // height : (y + 1) * r.height // height, x * r.width // width : (x + 1) * r.width // width]
                        if not c.size:
                            continue
                        h, w = c.shape[:2]
                        m = lambda q: q.reshape(-1, 3).mean(axis=0).tolist()
                        out.append((r.photo_id, x, y, m(c[h // 4 : max(h // 4 + 1, 3 * h // 4), w // 4 : max(w // 4 + 1, 3 * w // 4)]), histogram_hsv(c)["h"], m(c[:band]), m(c[:, -band:]), m(c[-band:]), m(c[:, :band])))
            yield pd.DataFrame(out, columns=["photo_id", "col", "row", "center_color", "h", "top", "right", "bottom", "left"])

    return images.mapInPandas(run, _CELL)


def cell_score(color: Column, hist: Column, cell_color: Column, cell_hist: Column) -> Column:
    """Four tenths from the colour distance, six from the hue correlation; a half for what is missing."""
    d = F.aggregate(F.zip_with(color, cell_color, lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda acc, v: acc + v)
    near = F.when(color.isNull() | cell_color.isNull(), F.lit(0.5)).otherwise(1 / (1 + d / 1000))
    alike = F.when(hist.isNull() | cell_hist.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.coalesce(correlation(hist, cell_hist), F.lit(0.0))))
    return 0.4 * near + 0.6 * alike


def best_cells(pieces: DataFrame, grid: DataFrame, n: int = 5) -> DataFrame:
    """(piece_id, cell, score, rank_no): each piece's best cells; a picture's grid is small by definition."""
    t = grid.select(F.struct("row", "col").alias("cell"), F.col("center_color").alias("cc"), F.col("h").alias("ch"))
    return top_matches(pieces.select("piece_id", "center_color", "h"), t, cell_score(F.col("center_color"), F.col("h"), F.col("cc"), F.col("ch")), "piece_id", "cell", n)
