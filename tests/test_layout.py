import numpy as np
from pyspark.sql import functions as F

from interlock.operators.layout import laid_out
from interlock.operators.target import best_cells, cells


def test_squares_lie_edge_to_edge():
    square = [np.array(p) for p in ([[0, 0], [10, 0]], [[10, 0], [10, 10]], [[10, 10], [0, 10]], [[0, 10], [0, 0]])]
    cells_, sides, centres = {}, {}, {}
    for k, (x, y) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        turn = k
        cells_[x, y] = (k, turn)
        a = np.pi / 2 * turn
        rot = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        # seen turned back, its side 0 no longer the upper one
        sides[k] = [square[(s + turn) % 4] @ rot.T + 7 * k for s in range(4)]
        centres[k] = np.array([5, 5]) @ rot.T + 7 * k
    got = laid_out(cells_, sides, centres, 2, 2)
    for k, want in ((0, (5, 5)), (1, (15, 5)), (2, (5, 15)), (3, (15, 15))):
        assert np.allclose(got[k][:2], want, atol=1e-6), (k, got[k])


def test_cells_of_a_picture(spark):
    img = np.zeros((40, 60, 3), np.uint8)
    img[:20, :30] = (255, 0, 0)
    img[20:, 30:] = (0, 0, 255)
    df = spark.createDataFrame([("p", 40, 60, 3, bytearray(img.tobytes()))], "photo_id string, height int, width int, n_channels int, data binary")
    grid = cells(df, 2, 2).cache()
    assert grid.count() == 4
    pieces = grid.where("row = 1 and col = 1").select(F.lit(9).alias("piece_id"), "center_color", "h").unionByName(spark.createDataFrame([(8, None, None)], "piece_id int, center_color array<double>, h array<double>"))
    best = {r["piece_id"]: r for r in best_cells(pieces, grid, 1).collect()}
    assert (best[9]["cell"]["row"], best[9]["cell"]["col"]) == (1, 1) and abs(best[9]["score"] - 1) < 1e-9
    assert abs(best[8]["score"] - 0.5) < 1e-9
